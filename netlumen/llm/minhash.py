"""Near-duplicate texts by one-permutation MinHash.

A text is its set of distinct word shingles; equal sets are one vertex. One hash of each
shingle gives both a bin and a value, and a set keeps the least value of each of its bins.
An empty bin borrows from the first bin in an order of its own that the set fills: the order
is a random permutation for each bin, the same in all sets, so what is borrowed is a uniform
choice of the filled bins (optimal densification), and two sets agree in a bin with a chance
of their similarity.

Bins are cut into ``BANDS`` bands of ``ROWS``. Sets whose sizes allow a link and that agree
in all bins of a band meet in its bucket; there a star of edges ties each to the least of
them, so a bucket of m sets gives at most m - 1 pairs, and a set leaves a bucket with one.
A pair of similarity s shares no band with a chance of (1 - s^8)^64: 1.4e-9 at 0.85. That is
the only way to lose a link; sets too small for a partner other than themselves give no band.

Candidates decide nothing. Sets tied together form clusters, and inside a cluster links are
confirmed on the full sets, in tiles of bounded size (``tiles``): all pairs that are not yet
connected, not only the edges of stars, so a hub that links with nobody loses no link.

Null and empty texts have the empty set, link with nothing and are kept. A text of fewer
than n words is one shingle. Equal rows fall into one component. A null id takes no part in
the smallest id of its component; a row is known by its id and a hash of its text. Extra
columns stay in ``keep_one``, whatever their names, and take no part otherwise. Texts are
hashed whole, some 50 bytes of memory a byte of a batch or of one longer text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlumen.llm import tiles
from netlumen.llm.common import components, materialize, release
from netlumen.llm.shingles import (
    buckets_for, candidates, classes, grams_of, keep_rows, name_sets, one_row_each, rows_of)
from netlumen.llm.textscan import mix

BANDS, ROWS = 64, 8
SETS = 2048                      # sets whose bins are held at once
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_SALT = _U(0xD6E8FEB86659FD93)


def borrowing(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled one: a row per bin."""
    order = np.random.default_rng(20240917).random((bins, bins), dtype=np.float32)
    return np.argsort(order, axis=1).astype(np.int16)


def signatures(gram: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The least value of each bin of each (non-empty) set, empty bins filled."""
    bins, m = len(order), len(at) - 1
    value = mix(gram ^ _SALT)
    owner = np.repeat(np.arange(m), np.diff(at))
    own = np.full(m * bins, _EMPTY, np.uint64)
    np.minimum.at(own, owner * bins + (value % _U(bins)).astype(np.int64), value)
    own = own.reshape(m, bins)
    out = own.copy()
    who, where = np.nonzero(own == _EMPTY)
    for step in range(bins):
        if not len(who):
            break
        found = own[who, order[where, step]]
        out[who, where] = found
        still = found == _EMPTY
        who, where = who[still], where[still]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each set."""
    m, bins = signature.shape
    bands = bins // rows
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (m, 1))
    cells = signature.reshape(m, bands, rows)
    for i in range(rows):
        key = mix(key ^ mix(cells[:, :, i] + _U(i)))
    return key


def star_keys(bands: int, rows: int):
    """What ``shingles.candidates`` asks for: places of sets and their band keys."""
    order = borrowing(bands * rows)

    def keys(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [np.zeros(0, np.uint64)]
        for i in range(0, len(at) - 1, SETS):
            part = at[i:i + SETS + 1]
            out.append(band_keys(signatures(gram[part[0]:part[-1]], part - part[0], order), rows).ravel())
        return np.repeat(np.arange(len(at) - 1), bands), np.concatenate(out)

    return keys


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text",
         bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (the smallest id reachable by links) and
    kept: whether that is its own."""
    names, one, labels = _linked(docs, n, num, den, doc_id, text, bands, rows)
    best = materialize(classes(one, labels).select("name", F.col("best.doc_id").alias("component_id")), "minhash-classes")
    full = names.filter("n > 0").join(best, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = full.union(names.filter("n = 0").select("doc_id", "n", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text",
             bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each component: the one of the smallest id, nulls last, and of these the
    one of the least text hash."""
    names, one, labels = _linked(df, n, num, den, doc_id, text, bands, rows)
    best = materialize(classes(one, labels).select("name", "best"), "minhash-classes")
    return keep_rows(df, names, best, doc_id, text)


def _linked(docs: DataFrame, n: int, num: int, den: int, doc_id: str, text: str, bands: int, rows: int
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set's name, sets, and (name, c) of the sets with candidates."""
    spark = docs.sparkSession
    own = rows_of(docs, doc_id, text)
    names = materialize(name_sets(own, n, False), "minhash-names").select("doc_id", "key", "n", "name")
    pairs = candidates(own, n, num, den, buckets_for(names.count() * bands), star_keys(bands, rows))
    pairs = materialize(pairs, "minhash-stars")
    release(spark)
    cluster = components(pairs, "minhash-clusters").select(F.col("v").alias("name"), F.col("c").alias("cluster"))
    one = materialize(one_row_each(names), "minhash-sets")
    members = materialize(tiles.fitting(cluster.join(one, "name")), "minhash-members")
    members = materialize(grams_of(own, members, n), "minhash-grams")
    release(spark)
    return names, one, materialize(tiles.solve(members, num, den, False), "minhash-labels")
