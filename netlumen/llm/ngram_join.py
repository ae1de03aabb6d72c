"""Exact self join of texts by the Jaccard similarity of their word n-grams.

A text is its set of distinct n-gram hashes; equal sets are one vertex, named by a digest
of the set. Two different sets x and y link when den * |x & y| >= num * |x | y|.

Candidates. A set of n-grams is cut into bins by hash, about two n-grams a bin, as many bins
for all sets of a band of sizes. An n-gram that one of two linking sets has alone spoils one
bin, and there are at most (|x| + |y|) (den - num) / (den + num) of these, so if a set has d
of them with any partner, two linking sets agree in the whole of one of the first d + 1 bins of
each, in any one order of bins. A set gives those, for its own band and the one before: bins
of several n-grams before bins of one, rare n-grams before common ones. So neither a passage or
line of many texts makes a candidate (its n-grams come last) nor one n-gram that long texts
happen to share, of which there are more the larger the corpus. Sets of few n-grams, and sets with
fewer bins than that, give single n-grams: the first |x| - ceil(num |x| / den) + 1 from rare to
common, of which two linking sets share one as well.
How common an n-gram is comes from hashed counts over all texts, a byte for each of 2^22
counters, broadcast at that fixed size; a shared counter only moves an n-gram in the order,
which may be any as long as it is the same everywhere. Sets of one key whose sizes allow
a link are tied to the least of them (``shingles.candidates``).

Clusters of tied sets hold every link between their sets. They are compared in size-banded
tiles by hashed bitmaps, whose bit counts bound the overlap from above, and then by exact
intersection of sorted arrays (``tiles``). ``link`` tests every pair that sizes allow and
counts links; ``keep_one``, which needs components alone, leaves out pairs that are already
connected. Nothing is sampled or capped.

Null and empty texts have the empty set and link with nothing. A text of fewer than n
words is one n-gram. Equal rows fall into one component; a null id takes no part in the
smallest id of its component. A row is known by its id and a hash of its text, so rows of
null or repeated ids are compared like others. Extra columns stay in ``keep_one``, whatever
their names, and take no part otherwise. Texts are hashed whole, some 50 bytes of memory a
byte of a batch of ``SCAN_BYTES``, or of one text where that is longer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlumen.llm import tiles
from netlumen.llm.common import components, materialize, release
from netlumen.llm.shingles import (
    buckets_for, candidates, classes, commonness, grams_of, keep_rows, name_sets, one_row_each, rows_of)
from netlumen.llm.textscan import mix

SMALL, BINS = 16, 0.5            # sets of fewer n-grams have no bins; bins per n-gram of a band's least set
_U = np.uint64
_SALT = _U(0x9E3779B97F4A7C15)


def rare_keys(gram: np.ndarray, at: np.ndarray, common: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the keys that each set must give: two linking sets share one."""
    size, held = np.diff(at), common[(gram & _U(len(common) - 1)).astype(np.int64)]
    owner, key, covered = _bin_keys(gram, at, held, num, den)
    # The others, and those that may link with one of the small ones.
    lone = np.flatnonzero(~covered | (size * num < SMALL * den))
    spot, lone_at = _of(at, lone)
    of = np.repeat(np.arange(len(lone)), size[lone])
    rank = (held[spot].astype(np.uint64) << _U(56)) | (gram[spot] >> _U(8))
    order = np.lexsort((rank, of))
    most = size[lone] - -(-size[lone] * num // den) + 1
    first = order[(np.arange(len(spot)) - lone_at[of]) < most[of]]
    return np.concatenate([owner, lone[of[first]]]), np.concatenate([key, gram[spot[first]]])


def _of(at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of ``some`` sets, and bounds among these."""
    size = np.diff(at)[some]
    bounds = np.append(0, np.cumsum(size))
    return np.arange(bounds[-1]) + np.repeat(at[some] - bounds[:-1], size), bounds


def _bin_keys(gram: np.ndarray, at: np.ndarray, held: np.ndarray, num: int, den: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key) of whole bins, and which sets these cover: all but the small ones and those
    with no more bins than a partner may spoil."""
    covered = np.diff(at) >= SMALL if num < den else np.zeros(len(at) - 1, bool)
    some = np.flatnonzero(covered)
    spot, at = _of(at, some)
    gram, held, size, ratio = gram[spot], held[spot], np.diff(at), den / num
    value, of = mix(gram ^ _SALT), np.repeat(np.arange(len(some)), size)
    band = np.floor(np.log(size) / np.log(ratio) + 1e-9) if num < den else size
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    # With sets of its own band and the next, and of the one before.
    for low, largest in ((band, size * den // num), (band - 1, np.minimum(size, ratio ** band + 1).astype(np.int64))):
        if not len(some):
            break
        spoilt = (size + largest) * (den - num) // (den + num)
        bins = np.maximum(BINS * ratio ** low, 1).astype(np.uint64)
        # N-grams ascend in a set, so those of a bin are neighbours.
        place = ((gram >> _U(32)) * bins[of]) >> _U(32)
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (of[1:] != of[:-1])))
        mine, one = of[first], np.diff(np.append(first, len(gram))) == 1
        with np.errstate(over="ignore"):
            key = mix(np.add.reduceat(value, first) + mix(low.astype(np.int64).astype(np.uint64) + _SALT)[mine])
        rank = (one.astype(np.uint64) << _U(63)) | (np.minimum.reduceat(held, first).astype(np.uint64) << _U(55)) | (key >> _U(9))
        order, n = np.lexsort((rank, mine)), np.bincount(mine, minlength=len(some))
        given = order[(np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)) <= spoilt[mine]]
        covered[some[n <= spoilt]] = False
        owners.append(some[mine[given]])
        keys.append(key[given])
    return np.concatenate(owners), np.concatenate(keys), covered


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text"
         ) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (the smallest id reachable by links) and
    n_links: with how many other rows it links, equal sets included."""
    names, one, labels = _linked(docs, n, num, den, doc_id, text, True)
    best = classes(one, labels).join(labels.select("name", "links"), "name", "left")
    best = materialize(best.select("name", F.col("best.doc_id").alias("component_id"),
                                   (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "ngram-classes")
    # Rows of one set may be any share of all: the join of rows with sets is the last step.
    full = names.filter("n > 0").join(best, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return full.union(names.filter("n = 0").select("doc_id", "n", "doc_id", F.lit(0).cast("long")))


def keep_one(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text"
             ) -> DataFrame:
    """One row of each group of linked texts: the one of the smallest id, nulls last, and of
    these the one of the least text hash. Rows without words stay; of rows with equal id and
    text any one stays."""
    names, one, labels = _linked(df, n, num, den, doc_id, text, False)
    best = materialize(classes(one, labels).select("name", "best"), "ngram-classes")
    return keep_rows(df, names, best, doc_id, text)


def _linked(docs: DataFrame, n: int, num: int, den: int, doc_id: str, text: str, counted: bool
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set's name, sets, and (name, c[, links]) of the sets with candidates."""
    spark = docs.sparkSession
    rows = rows_of(docs, doc_id, text)
    named = materialize(name_sets(rows, n, True), "ngram-names")
    common = spark.sparkContext.broadcast(commonness(named))
    names = named.filter("block IS NULL").select("doc_id", "key", "n", "name")
    total, count = names.agg(F.sum("n"), F.count(F.lit(1))).first()
    keys = (total or 0) * (3 + den / num) * (den - num) / (den + num) + 2 * count
    pairs = candidates(rows, n, num, den, buckets_for(keys), lambda g, at: rare_keys(g, at, common.value, num, den))
    pairs = materialize(pairs, "ngram-pairs")
    common.destroy()
    release(spark)
    cluster = components(pairs, "ngram-clusters").select(F.col("v").alias("name"), F.col("c").alias("cluster"))
    one = materialize(one_row_each(names), "ngram-sets")
    members = materialize(tiles.fitting(cluster.join(one, "name")), "ngram-members")
    members = materialize(grams_of(rows, members, n), "ngram-grams")
    release(spark)
    return names, one, materialize(tiles.solve(members, num, den, counted), "ngram-labels")
