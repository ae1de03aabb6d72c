"""Whitening of embedding vectors by their greatest principal components.

Entries become integers, floor(64 c) + 1000000, so counts and sums are exact. Three passes
over the table: sums, the covariance of the centred vectors, and the covariance of the
whitened ones, which says how far it is from the identity; each task reduces its rows to
one small matrix, and Spark adds the matrices up. A fourth gives the result. What meets on
the driver is as large as a vector squared, whatever the number of rows.

Eigenpairs come from contour integration (``feast``): inertia cuts the spectrum into
intervals, each is a task of its own, and as many pairs must be found in each as inertia
counts. If not, the cuts are moved, and after a few tries the fit fails loudly.

Left out are rows whose vector is null or empty, holds a null, a non-finite entry or one of
2^46 or more (no exact integer), or is not as long as most of those that remain (the longest
of the commonest lengths). Components whose eigenvalue is zero to rounding have no whitened
values and are left out, so a table of equal vectors, like an empty one, has no rows.
Repeated rows and ties count like others; a null id is kept; extra columns take no part. A
deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.llm import feast
from netlumen.llm.common import plain

OFFSET, SCALE, LARGEST = 1_000_000, 64.0, float(1 << 46)
COMPONENTS, SLICE = 32, 8
ROWS = 4096                      # vectors whose products are formed at once
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


@dataclass(frozen=True)
class Whitening:
    """A fit: row count, integer sums, eigenvalues and unit vectors (columns), trace and
    the largest entry by which the whitened covariance misses the identity."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def integers(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the usable vectors, a pair for each length."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=0).astype(np.int64)
    flat = column.flatten()
    entry = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    first = np.cumsum(sizes) - sizes
    usable = np.abs(entry) < LARGEST                        # false for nulls and NaN too
    bad = np.zeros(len(entry) + 1, np.int64)
    np.cumsum(~usable, out=bad[1:])
    good = (sizes > 0) & (bad[first + sizes] == bad[first])
    for size in np.unique(sizes[good]).tolist() if length is None else [length]:
        rows = np.flatnonzero(good & (sizes == size))
        for i in range(0, len(rows), ROWS):
            part = rows[i:i + ROWS]
            spot = first[part][:, None] + np.arange(size)
            yield part, np.floor(SCALE * entry[spot]).astype(np.int64) + OFFSET


def _vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return df.select(plain(df, vec_id).cast("long").alias("vec_id"), plain(df, vector).cast("array<double>").alias("v"))


def _sums(rows: DataFrame) -> tuple[int, np.ndarray] | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, x in integers(batch.column(0)):
                total = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                total[0] += len(part)
                total[1] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.int64()))], names=["size", "n", "sums"])

    parts = rows.select("v").mapInArrow(run, "size long, n long, sums array<long>")
    each = parts.select("size", "n", F.posexplode("sums").alias("i", "s")).groupBy("size", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    # As many rows as a vector has entries reach the driver.
    best = each.groupBy("size").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))
    got = best.orderBy(F.desc("n"), F.desc("size")).first()
    return (got.n, np.array([s for _, s in got.sums], np.int64)) if got else None


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    # n x - S is exact in 64 bits up to some 10^12 rows; the quotient is rounded once.
    return (n * x - sums) / n


def _added(rows: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum over all vectors of their centred outer products, in ``basis`` if given; the last
    row holds the plain sums."""
    d = len(sums)
    k = d if basis is None else basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in integers(batch.column(0), d):
                y = _centred(x, n, sums)
                y = y if basis is None else y @ basis
                total[:k] += y.T @ y
                total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    def add(key, table):
        row = np.array(table["row"].to_pylist()).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([row.tolist()], pa.list_(pa.float64()))})

    parts = rows.select("v").mapInArrow(run, "i int, row array<double>")
    summed = parts.groupBy("i").applyInArrow(add, "i int, row array<double>")
    return np.array([r.row for r in sorted(summed.collect(), key=lambda r: r.i)])


def eigenpairs(spark: SparkSession, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and unit vectors: each interval is a task."""
    for attempt in range(5):
        parts = feast.intervals(matrix, k, SLICE, 0.037 * attempt)
        if not parts:
            return np.zeros(0), np.zeros((len(matrix), 0))
        todo = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "i int, low double, high double, n int")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for p in batch.itertuples(index=False):
                    values, vectors = feast.solve(matrix, p.low, p.high, p.n)
                    yield pd.DataFrame({"i": p.i, "value": values, "vector": list(vectors.T)})

        found = todo.repartition(len(parts), "i").mapInPandas(run, "i int, value double, vector array<double>").collect()
        held = np.bincount([r.i for r in found], minlength=len(parts))
        if (held == [p[2] for p in parts]).all():
            break
    else:
        raise RuntimeError("contours did not find as many eigenvalues as inertia counts")
    # Rayleigh-Ritz over all intervals together makes the vectors orthogonal to rounding.
    q, _ = np.linalg.qr(np.array([r.vector for r in found]).T)
    values, y = np.linalg.eigh(q.T @ matrix @ q)
    order = np.argsort(values)[::-1][:k]
    vectors = q @ y[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * sign


def fit(df: DataFrame, k: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """The whitening of a table's usable vectors; None if there is none."""
    rows = _vectors(df, vec_id, vector)
    got = _sums(rows)
    if got is None:
        return None
    n, sums = got
    matrix = _added(rows, n, sums)[:-1] / n
    matrix = (matrix + matrix.T) / 2
    trace = float(np.trace(matrix))
    values, vectors = eigenpairs(df.sparkSession, matrix, min(k, len(sums)))
    kept = values > max(1e-12 * trace, 0.0)
    values, vectors = values[kept], vectors[:, kept]
    if not len(values):
        return Whitening(n, sums, values, vectors, trace, 0.0)
    total = _added(rows, n, sums, vectors / np.sqrt(values))
    mean = total[-1] / n
    error = np.abs(total[:-1] / n - np.outer(mean, mean) - np.eye(len(values))).max()
    return Whitening(n, sums, values, vectors, trace, float(error))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Per row the exact sum of (n x - S)^2, null beyond 64 bits."""
    apart = n * x - sums
    if float(np.abs(apart).max(initial=0)) ** 2 * len(sums) < 2 ** 62:
        return pa.array((apart * apart).sum(axis=1))
    exact = (apart.astype(object) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row its id, deviation and whitened values (an array, greatest component
    first)."""
    schema = "vec_id long, deviation long, whitened array<double>"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    n, sums, k = model.n, model.sums, len(model.values)
    basis = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in integers(batch.column(1), len(sums)):
                w = _centred(x, n, sums) @ basis
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), deviations(x, n, sums), lists],
                                                 names=["vec_id", "deviation", "whitened"])

    return _vectors(df, vec_id, vector).mapInArrow(run, schema)


def components(df: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row and component, numbered from 1 by falling eigenvalue."""
    rows = whiten(df, model, vec_id, vector)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], RESULT)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("i") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
