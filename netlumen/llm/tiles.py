"""Exact links inside clusters of candidate sets, compared in size-banded tiles.

In a tile a hashed bitmap of each set bounds the overlap of two from above by bit counts;
only pairs that pass are intersected, as sorted arrays. A cluster that fits a tile is one;
a larger one is cut into blocks of neighbouring sizes, compared pair of blocks by pair of
blocks. Sets move as arrays of n-gram hashes. Where links are to be counted, every pair
that sizes allow is tested and summed up in its tile, so pairs are never rows; where only
components are wanted, sets already connected are not compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.llm.common import components, materialize

TILE, TILE_GRAMS = 2048, 4 << 20     # sets, and their n-grams, that are compared at once
PIVOTS = 16
_U = np.uint64


def bitmaps(gram: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """A hashed bitmap of each set, as 64-bit words; ``bits`` is a power of two."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bit = (gram & _U(bits - 1)).astype(np.int64)
    out = np.zeros((len(at) - 1, bits // 64), np.uint64)
    np.bitwise_or.at(out, (owner, bit >> 6), _U(1) << (bit & 63).astype(np.uint64))
    return out


def _maps(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = 1 << max(6, int(4 * max(1, np.diff(at).mean())).bit_length())
    return bitmaps(gram, at, min(bits, 1 << 15))


def _passing(i: int, others: np.ndarray, maps: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``others`` whose overlap with i may be large enough: |x & y| is at most half
    of what the bits do not set apart."""
    differ = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
    both = size[others] + size[i]
    return others[(num + den) * ((both - differ) // 2) >= num * both]


def tile_links(gram: np.ndarray, at: np.ndarray, groups: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links of a tile that connect what ``groups`` (equal numbers: connected) does not."""
    size, maps = np.diff(at), _maps(gram, at)
    group, links = groups.copy(), []
    for i in np.argsort(size, kind="stable")[::-1].tolist():
        # Partners no larger than i, not yet connected to it, and not too small.
        others = np.flatnonzero((group != group[i]) & (size <= size[i]) & (size * den >= size[i] * num))
        for j in _passing(i, others, maps, size, num, den).tolist() if len(others) else ():
            if group[i] == group[j]:
                continue
            shared = len(np.intersect1d(gram[at[i]:at[i + 1]], gram[at[j]:at[j + 1]], assume_unique=True))
            if den * shared >= num * (size[i] + size[j] - shared):
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def tile_counts(gram: np.ndarray, at: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which sets of a tile link, every pair tested, as a symmetric matrix; pairs of one
    ``side`` are left out. What passes the bitmaps' bound is intersected with i together."""
    size, maps = np.diff(at), _maps(gram, at)
    m = len(size)
    words, place = np.unique(gram, return_inverse=True)
    linked = np.zeros((m, m), bool)
    held = np.zeros(len(words), bool)
    order = np.argsort(size, kind="stable")
    rising = size[order]
    for k in range(m - 1, 0, -1):
        i = int(order[k])
        others = order[np.searchsorted(rising, -(-size[i] * num // den)):k]
        if side is not None:
            others = others[side[others] != side[i]]
        others = _passing(i, others, maps, size, num, den)
        if not len(others):
            continue
        own = place[at[i]:at[i + 1]]
        held[own] = True
        n = size[others]
        start = np.cumsum(n) - n
        spot = np.repeat(at[others] - start, n) + np.arange(n.sum())
        shared = np.add.reduceat(held[place[spot]].astype(np.int64), start)
        held[own] = False
        ok = others[den * shared >= num * (size[i] + n - shared)]
        linked[i, ok] = linked[ok, i] = True
    return linked


def least_linked(linked: np.ndarray) -> np.ndarray:
    """For each set the least number in its component."""
    label, m = np.arange(len(linked)), len(linked)
    while m:
        now = np.minimum(label, np.where(linked, label, m).min(axis=1))
        now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["gram"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), at - (at[0] if len(at) else 0)


def fitting(members: DataFrame) -> DataFrame:
    """``members`` (cluster, n, ...) with ``fits``: whether the whole cluster is one tile.
    To be asked while members are narrow, before they carry their sets."""
    load = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_g"))
    load = load.select("cluster", ((F.col("_m") <= TILE) & (F.col("_g") <= TILE_GRAMS)).alias("fits"))
    return members.join(load, "cluster")


def solve(members: DataFrame, num: int, den: int, counted: bool) -> DataFrame:
    """(name, c) of the sets in ``members`` (cluster, fits, name, n, copies, gram); if
    ``counted`` also with how many rows of other sets each links."""
    labels = small_links(members.filter("fits"), num, den, counted)
    large = members.filter("NOT fits")
    if not large.isEmpty():
        labels = labels.union((large_counts if counted else large_links)(large, num, den))
    return labels


def small_links(rows: DataFrame, num: int, den: int, counted: bool) -> DataFrame:
    """(name, c) of every set in clusters that fit a tile, whole clusters in one task; if
    ``counted``, with the rows of other sets that it links with."""
    rows = rows.select("cluster", "name", "copies", "gram").repartition("cluster").sortWithinPartitions("cluster")
    names = ["name", "c", "links"] if counted else ["name", "c"]

    def inside(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        gram, at = _arrays(table)
        name, cluster, copies = (table[c].to_numpy() for c in ("name", "cluster", "copies"))
        c, links = name.copy(), np.zeros(len(name), np.int64)
        edges = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])) if len(cluster) else np.zeros(0, int)
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(cluster)]):
            if hi - lo > 1:
                tile = gram[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
                group = np.arange(hi - lo)
                if counted:
                    linked = tile_counts(*tile, num, den)
                    group, links[lo:hi] = least_linked(linked), linked @ copies[lo:hi]
                else:
                    for i, j in tile_links(*tile, group, num, den):
                        group[group == group[j]] = group[i]
                for g in np.unique(group):
                    c[lo + np.flatnonzero(group == g)] = name[lo + np.flatnonzero(group == g)].min()
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(c), pa.array(links)][:len(names)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # Rows of a batch's last cluster wait for the next batch.
            cluster = batch.column(0).to_numpy()
            last = int(np.searchsorted(cluster, cluster[-1])) if len(cluster) else 0
            if last or not held:
                if held or last:
                    yield inside(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif held[-1].column(0)[0].as_py() != batch.column(0)[0].as_py():
                yield inside(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield inside(pa.Table.from_batches(held))

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _banded(members: DataFrame, num: int, den: int, *columns: str) -> DataFrame:
    """``columns`` with ``band``: sets that link are a band apart at most."""
    ratio = math.log(den / num) if num < den else 1.0
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio) + F.lit(1e-9)).cast("long")
    return members.select("cluster", band.alias("band"), "name", "n", *columns, "gram")


def large_counts(members: DataFrame, num: int, den: int) -> DataFrame:
    """(name, c, links) of every set in clusters beyond one tile: blocks of about TILE / 2
    sets of one size band, every pair of blocks that sizes allow in a tile of its own."""
    rows = materialize(_banded(members, num, den, "copies"), "tiles-large")
    count = materialize(rows.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / (TILE // 2), F.sum("n") / (TILE_GRAMS // 2))).alias("q")), "tiles-blocks")
    above = count.select("cluster", (F.col("band") - 1).alias("band"), F.col("q").alias("up"))
    below = count.select("cluster", (F.col("band") + 1).alias("band"), F.col("q").alias("down"))
    count = materialize(count.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left"), "tiles-near")
    placed = rows.join(count, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("name"), F.col("q")))

    def tiles(other: Column, low: Column, high: Column, x: Column, y: Column, side: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0).cast("long"), other - 1), lambda o: F.struct(
            low.alias("low"), high.alias("high"), F.coalesce(x, o).alias("x"), F.coalesce(y, o).alias("y"),
            side.cast("int").alias("side")))
        return F.when(other > 0, made).otherwise(F.array().cast(
            "array<struct<low:bigint,high:bigint,x:bigint,y:bigint,side:int>>"))

    band, block, none = F.col("band"), F.col("block"), F.lit(None).cast("long")
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), lambda o: F.struct(
        band.alias("low"), band.alias("high"), F.least(o, block).alias("x"), F.greatest(o, block).alias("y"),
        (block > o).cast("int").alias("side")))
    sides = F.concat(own, tiles(F.col("up"), band, band + 1, block, none, F.lit(0)),
                     tiles(F.col("down"), band - 1, band, none, block, F.lit(1)))
    dealt = placed.select("cluster", "name", "copies", "gram", F.explode(sides).alias("t")).select(
        "cluster", "t.*", "name", "copies", "gram")

    def tile(key, table):
        gram, at = _arrays(table)
        name, side, copies = (table[c].to_numpy() for c in ("name", "side", "copies"))
        # Pairs of one block have a tile of their own.
        apart = (key[1].as_py(), key[3].as_py()) != (key[2].as_py(), key[4].as_py())
        linked = tile_counts(gram, at, num, den, side if apart else None)
        return pa.table({"name": name, "c": name[least_linked(linked)], "links": linked @ copies})

    found = materialize(dealt.groupBy("cluster", "low", "high", "x", "y").applyInArrow(
        tile, "name long, c long, links long"), "tiles-counts")
    joined = components(found.filter("name <> c").select(F.col("name").alias("a"), F.col("c").alias("b")), "tiles-final")
    total = found.groupBy("name").agg(F.sum("links").alias("links"))
    return total.join(joined.withColumnRenamed("v", "name"), "name", "left").select(
        "name", F.coalesce("c", "name").alias("c"), "links")


def large_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """(name, c) of every set in clusters beyond one tile.

    First each block of about TILE sets of one size band is solved alone, together with
    PIVOTS sets of the band that are the same in all its blocks, which ties most copies of
    one text together. Then blocks of what is not yet connected are compared pairwise,
    where sizes allow a link. Blocks hold sets of one component where there are enough, and
    pairs of such blocks are skipped."""
    rows = materialize(_banded(members, num, den), "tiles-large")
    schema = "a long, b long"

    def tile(key, table):
        gram, at = _arrays(table)
        name = table["name"].to_numpy()
        group = np.unique(table["c"].to_numpy(), return_inverse=True)[1] if "c" in table.column_names else np.arange(len(name))
        links = tile_links(gram, at, group, num, den)
        return pa.table({"a": pa.array([int(name[i]) for i, _ in links], pa.int64()),
                         "b": pa.array([int(name[j]) for _, j in links], pa.int64())})

    count = rows.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_GRAMS)).alias("q"))
    bin_of = F.pmod(F.xxhash64("name", F.lit("pivot")), F.lit(PIVOTS))
    pivots = rows.groupBy("cluster", "band", bin_of.alias("bin")).agg(F.min("name").alias("name")).drop("bin")
    pivots = pivots.join(rows.select("name", "n", "gram"), "name").join(count.filter("q > 1"), ["cluster", "band"])
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    alone = rows.join(count, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("name"), F.col("q")))
    alone = alone.unionByName(pivots).select("cluster", "band", "block", "name", "gram")
    links = materialize(alone.groupBy("cluster", "band", "block").applyInArrow(tile, schema), "tiles-links")
    named = components(links, "tiles-large").withColumnRenamed("v", "name")
    now = materialize(rows.select("cluster", "band", "name", "n").join(named, "name", "left")
                      .withColumn("c", F.coalesce("c", "name")), "tiles-now")
    # Components of a block or more have blocks of their own, the rest share blocks.
    c_size = now.groupBy("cluster", "band", "c").agg(F.greatest(
        F.count(F.lit(1)).cast("double"), F.sum("n") * (TILE / TILE_GRAMS)).alias("k"))
    c_size = c_size.withColumn("own", F.when(F.col("k") >= TILE // 2, F.col("c")))
    q = c_size.groupBy("cluster", "band", "own").agg(F.ceil(F.sum("k") / (TILE // 2)).alias("q"))
    now = now.join(c_size, ["cluster", "band", "c"]).alias("l").join(
        q.alias("r"), (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.band") == F.col("r.band"))
        & F.col("l.own").eqNullSafe(F.col("r.own"))).select("l.cluster", "l.band", "l.name", "l.c", "l.own", "r.q")
    now = now.withColumn("block", F.concat_ws(":", F.coalesce(F.col("own").cast("string"), F.lit("-")),
                                              F.pmod(F.xxhash64("name"), F.col("q")).cast("string")))
    now = materialize(now, "tiles-blocks")
    blocks = now.select("cluster", "band", "block", "own").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    # Sizes a band apart at most can link; the block list is small, rows / TILE.
    near = x.withColumn("other", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("x")
    pair = near.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.other") == F.col("y.band"))).filter(
        ((F.col("x.band") < F.col("y.band")) | (F.col("x.block") <= F.col("y.block")))
        & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    pair = pair.select("x.cluster", F.col("x.band").alias("b1"), F.col("x.block").alias("k1"),
                       F.col("y.band").alias("b2"), F.col("y.block").alias("k2"))
    pair = pair.withColumn("tile", F.xxhash64("b1", "k1", "b2", "k2"))
    sides = pair.select("cluster", "tile", F.explode(F.array_distinct(F.array(
        F.struct(F.col("b1").alias("band"), F.col("k1").alias("block")),
        F.struct(F.col("b2").alias("band"), F.col("k2").alias("block"))))).alias("s")).select("cluster", "tile", "s.*")
    tiles = now.select("cluster", "band", "block", "name", "c").join(sides, ["cluster", "band", "block"]).join(
        rows.select("name", "gram"), "name")
    cross = tiles.select("cluster", "tile", "name", "gram", "c").groupBy("cluster", "tile").applyInArrow(tile, schema)
    final = components(links.union(materialize(cross, "tiles-cross")), "tiles-final")
    return rows.select("name").distinct().join(final.withColumnRenamed("v", "name"), "name", "left").select(
        "name", F.coalesce("c", "name").alias("c"))
