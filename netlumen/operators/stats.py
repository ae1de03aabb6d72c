"""Summary statistics, resampling and parameter grids over any numeric column."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from netlumen.operators.scan import exact_quantiles, histogram_quantiles, values_at_ranks
from netlumen.session import materialize


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """median, mean, sample deviation (0 below two rows) and max per group."""
    by = list(by)
    facts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.max(value).alias("max"))
    med = exact_quantiles(df, value, (0.5,), by)
    if by:
        return facts.join(med.select(*by, F.col("value").alias("median")), by, "left")
    return facts.withColumn("median", med.agg(F.max("value")).scalar())


def nearest_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """The element at position ``floor(n * q)`` of the ascending values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return histogram_quantiles(counts, value, {"value": ("_n", q)}, nearest=True).filter("value IS NOT NULL")


def _median_ranks(seed: int):
    """Rows (arm, n, b) -> the two row ranks whose mean is the median of resample b."""
    def draw(arm: pd.Series, n: pd.Series, b: pd.Series) -> pd.DataFrame:
        low, high = [], []
        for name, size, i in zip(arm, n, b):
            rng = np.random.default_rng([seed, int(i), zlib.crc32(name.encode())])
            k = (size + 1) // 2                         # smallest of the middle draws
            u = rng.beta(k, size - k + 1)
            v = u if size % 2 else 1 - (1 - u) * rng.random() ** (1 / (size - k))
            low.append(min(int(u * size), size - 1))
            high.append(min(int(v * size), size - 1))
        return pd.DataFrame({"low": low, "high": high})

    return pandas_udf(draw, T.StructType([T.StructField("low", T.LongType()),
                                          T.StructField("high", T.LongType())]))


def bootstrap_medians_ci(df: DataFrame, arm: str, value: str, baseline: str, treatment: str,
                         resamples: int = 2000, seed: int = 12345,
                         level: float = 0.95) -> DataFrame:
    """Percentile bootstrap interval of ``1 - median(treatment) / median(baseline)``.

    The median of n draws with replacement is the value at a random rank, and that
    rank is a Beta order statistic of n uniform draws. So a resample costs one seeded
    draw and two rank look-ups instead of n draws.
    """
    arms = df.filter(F.col(arm).isin(baseline, treatment)).select(
        F.col(arm).alias("arm"), F.col(value).cast("double").alias("v"))
    sizes = arms.filter(F.col("v").isNotNull()).groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    drawn = sizes.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    drawn = drawn.withColumn("r", _median_ranks(seed)("arm", "n", "b"))
    ranks = drawn.select("arm", "b", F.explode(F.array("r.low", "r.high")).alias("rank"))
    found = values_at_ranks(arms, "v", ranks, ["arm"])
    medians = found.groupBy("arm", "b").agg(F.avg("value").alias("median"))
    pair = medians.groupBy("b").agg(
        F.max(F.when(F.col("arm") == baseline, F.col("median"))).alias("base"),
        F.max(F.when(F.col("arm") == treatment, F.col("median"))).alias("treat"))
    gain = F.when(F.col("base") > 0, (F.col("base") - F.col("treat")) / F.col("base")).otherwise(0.0)
    # One number per resample.
    ordered = pair.agg(F.array_sort(F.collect_list(gain)).alias("g"))
    tail = (1 - level) / 2
    at = lambda q: F.element_at("g", F.floor(F.size("g") * q).cast("int") + 1)
    return ordered.select(at(tail).alias("lower"), at(1 - tail).alias("upper"),
                          F.size("g").alias("resamples"))


def grid_sensitivity(df: DataFrame, metric: Callable[[dict[str, Column]], tuple[Column, Column]],
                     grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Relative change between two per-row metrics at every point of a parameter grid.

    ``metric`` turns one set of parameter Columns into (baseline, treatment). The grid
    is a literal list, so each row is expanded by its fixed size and no more.
    """
    names = list(grid)
    points = F.array(*[
        F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, values)])
        for values in product(*grid.values())])
    rows = df.withColumn("_p", F.explode(points))
    baseline, treatment = metric({n: F.col(f"_p.{n}") for n in names})
    rows = rows.select(*[F.col(f"_p.{n}").alias(n) for n in names],
                       baseline.alias("_b"), treatment.alias("_t"))
    med = lambda c: exact_quantiles(rows, c, (0.5,), names).select(
        *names, F.col("value").alias(f"{c}_median"))
    both = med("_b").join(med("_t"), names)
    b, t = F.col("_b_median"), F.col("_t_median")
    return both.select(*names, b.alias("baseline_median"), t.alias("treatment_median"),
                       F.when(b > 0, (b - t) / b).otherwise(0.0).alias("improvement"))


def grid_summary(cells: DataFrame, target: float = 0.40) -> DataFrame:
    cells = materialize(cells, "grid")          # one row per point, read several times
    med = exact_quantiles(cells, "improvement", (0.5,)).agg(F.max("value")).scalar()
    return cells.agg(
        F.min("improvement").alias("min"), F.max("improvement").alias("max"),
        F.avg((F.col("improvement") >= target).cast("double")).alias("share_above"),
        F.count(F.lit(1)).alias("cells")).withColumn("median", med)


def bucket_histogram(df: DataFrame, value: str, bounds: Sequence[float],
                     by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of values at or below each bound, the last bound infinite."""
    edges = [*[float(b) for b in bounds], float("inf")]
    counts = df.groupBy(*by).agg(
        *[F.sum((F.col(value) <= b).cast("long")).alias(f"c{i}") for i, b in enumerate(edges)],
        F.sum(value).alias("sum"))
    return counts.select(*by, F.explode(F.array(*[
        F.struct(F.lit(b).alias("le"), F.col(f"c{i}").alias("count")) for i, b in enumerate(edges)
    ])).alias("h"), "sum").select(*by, "h.le", "h.count", "sum")
