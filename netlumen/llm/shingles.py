"""Texts as sets of n-gram hashes, candidates from equal keys, and classes of linked sets.

Equal sets are one vertex, named by a digest of the set, so copies of a text are one row in
all that follows but the last join. Keys of candidates meet in buckets; what is sent there
is packed, combined within a batch of texts first, and leaves as a spanning forest: at most
one tie a set and bucket, whatever the size of a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlumen.llm.common import fresh, materialize, plain
from netlumen.llm.textscan import LOWER, SPACED, gathered, hashes, mix, runs, shingles, slices, utf8

SCAN_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20          # of packed keys that one task puts together
CLASSES = 64                     # size classes per factor e
SLOTS_LOG2, BLOCK_LOG2 = 22, 16  # counters of n-grams, and how many of them make a row
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct n-gram hashes, ascending within a text, and each text's first.

    Hashing needs some fifty bytes a byte of text, so long columns are taken in parts."""
    parts, first = [], [np.zeros(1, np.int64)]
    for batch in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
        gram, at = _sets_of(batch.column(0), n)
        parts.append(gram)
        first.append(at[1:] + first[-1][-1])
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(first)


def _sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    start, end, bounds = runs(data, offsets, SPACED, LOWER)
    gram, at = shingles(hashes(data, start, end, LOWER), bounds, n)
    text = np.repeat(np.arange(len(column)), np.diff(at))
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    gram, text = gram[new], text[new]
    return gram, np.searchsorted(text, np.arange(len(column) + 1))


def digests(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(gram) + 1, np.uint64)
        np.cumsum(mix(gram ^ _U(_GOLD)), out=total[1:])
        size = np.diff(at).astype(np.uint64)
        return mix(total[at[1:]] - total[at[:-1]] + size * _U(_GOLD)).view(np.int64)


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, key): a row is known by its id and a hash of its text, as ids may be
    null or repeated."""
    rows = docs.select(plain(docs, doc_id).cast("long").alias("doc_id"), plain(docs, text).alias("text"))
    return rows.withColumn("key", F.xxhash64("text"))


def name_sets(rows: DataFrame, n: int, counted: bool) -> DataFrame:
    """Per row (doc_id, text, key) its set's size and name, from one reading of the texts.

    With ``counted``, each task also leaves its counts of n-grams by hash, some rows of
    (part, block, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS_LOG2 if counted else 0, np.uint32)
        for batch in gathered(batches, 1, SCAN_BYTES):
            gram, at = sets_of(batch.column(1), n)
            if counted:
                slot, count = np.unique(gram & _U(len(total) - 1), return_counts=True)
                total[slot] += count.astype(np.uint32)
            yield _named([batch.column(0), batch.column(2), pa.array(np.diff(at)), pa.array(digests(gram, at)),
                          *[pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]])
        part, blocks = TaskContext.get().partitionId(), total.reshape(-1, 1 << BLOCK_LOG2)
        held = np.flatnonzero(blocks.any(axis=1)).tolist()
        if held:
            yield _named([*[pa.nulls(len(held), pa.int64())] * 4, pa.array([part] * len(held), pa.int32()), pa.array(held, pa.int32()),
                          pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in held], pa.binary())])

    return rows.mapInArrow(run, "doc_id long, key long, n long, name long, part int, block int, counts binary")


def _named(arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n", "name", "part", "block", "counts"])


def commonness(named: DataFrame) -> np.ndarray:
    """A class per counter, higher for n-grams of more sets: one byte each, 4 MB whatever
    the number of texts. Two rounds of sums keep a counter block of all tasks off one task."""
    def add(key, table):
        total = np.zeros(1 << BLOCK_LOG2, np.uint64)
        for counts in table["counts"].to_pylist():
            part = zlib.decompress(counts)
            total += np.frombuffer(part, np.uint32 if len(part) == total.nbytes // 2 else np.uint64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = named.filter("block IS NOT NULL").select("block", (F.col("part") % 256).alias("part"), "counts")
    schema = "block int, counts binary"
    rows = rows.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    total = np.zeros((1 << (SLOTS_LOG2 - BLOCK_LOG2), 1 << BLOCK_LOG2), np.uint64)
    for r in rows.toLocalIterator():
        total[r.block] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint64)
    return (np.log2(total.ravel() + 1.0) * 4).astype(np.uint8)


def may_link(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets that can link with a different one at all."""
    return size * den >= num * (size + 1)


def size_class(size: np.ndarray) -> np.ndarray:
    return (np.log(np.maximum(size, 1)) * CLASSES).astype(np.uint16)


def reach(num: int, den: int) -> int:
    """Linking sets are at most so many size classes apart."""
    return int(np.log(den / num) * CLASSES) + 1


def combine(key: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray, far: int) -> tuple[np.ndarray, ...]:
    """Entries of equal keys put together where their size classes, low to high, are at
    most ``far`` apart: (key, least name, low, high), and the (hub, name) that this ties."""
    if not len(key):
        return key, name, low, high, name, name
    order = np.lexsort((low, key))
    key, name, low, high = key[order], name[order], low[order].astype(np.int64), high[order].astype(np.int64)
    new = np.append(True, key[1:] != key[:-1])
    lift = np.cumsum(new) << 20                              # keeps one key's classes off the next's
    top = np.maximum.accumulate(high + lift)
    new[1:] |= (low + lift)[1:] > top[:-1] + far
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    hub = np.minimum.reduceat(name, first)
    tied = hub[run] != name
    return (key[first], hub, low[first].astype(np.uint16), np.maximum.reduceat(high, first).astype(np.uint16),
            hub[run][tied], name[tied])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least of its component, name) for every name that pairs tie to a lesser one."""
    if not len(a):
        return a, b
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = place[:len(a)], place[len(a):], np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x].copy(), low)
        np.minimum.at(label, label[y].copy(), low)
        while (label[label] != label).any():
            label = label[label]
        if (label[x] == label[y]).all():
            break
    tied = label != np.arange(len(names))
    return names[label[tied]], names[tied]


BLOCKS = "bucket int, keys binary, places binary, sizes binary, names binary"


def _packed(key: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row per bucket: its keys, size classes, and places in a short list of names."""
    bucket = (key >> _U(33)) % _U(buckets)
    order = np.argsort(bucket, kind="stable")
    key, name, bucket = key[order], name[order], bucket[order]
    sizes = np.stack([low, high], axis=1).astype("<u2")[order]
    cut = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist(), len(key)] if len(key) else [0]
    out = []
    for i, j in zip(cut[:-1], cut[1:]):
        names, place = np.unique(name[i:j], return_inverse=True)
        out.append((int(bucket[i]), key[i:j].tobytes(), place.astype("<u4" if len(names) > 65536 else "<u2").tobytes(),
                    sizes[i:j].tobytes(), names.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(
        (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "keys", "places", "sizes", "names"])


def candidates(rows: DataFrame, n: int, num: int, den: int, buckets: int,
               keys_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Ties (a, b), a star per key, that connect all sets to which ``keys_of`` (n-grams and
    bounds of sets to places and keys) gives an equal key and whose sizes allow a link."""
    far = reach(num, den)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 0, SCAN_BYTES):
            gram, at = sets_of(batch.column(0), n)
            name, size = digests(gram, at), np.diff(at)
            once = np.unique(name, return_index=True)[1]
            once = np.sort(once[may_link(size[once], num, den) & (size[once] > 0)])
            new_at = np.zeros(len(once) + 1, np.int64)
            np.cumsum(size[once], out=new_at[1:])
            spot = np.arange(new_at[-1]) - np.repeat(new_at[:-1] - at[once], size[once])
            owner, key = keys_of(gram[spot], new_at)
            of = size_class(size[once])[owner]
            key, hub, low, high, a, b = combine(key, name[once][owner], of, of, far)
            a, b = forest(a, b)
            with np.errstate(over="ignore"):
                tie = mix(mix(a.view(np.uint64)) + b.view(np.uint64))
            # A tie goes along as a key of its own that both names give, at every size.
            yield _packed(np.concatenate([key, tie, tie]), np.concatenate([hub, a, b]),
                          np.concatenate([low, np.zeros(2 * len(tie), np.uint16)]),
                          np.concatenate([high, np.full(2 * len(tie), 65535, np.uint16)]), buckets)

    def tie(table):
        key, name, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint16)]
        for k, p, s, m in zip(*(table[c].to_pylist() for c in ("keys", "places", "sizes", "names"))):
            key.append(np.frombuffer(k, np.uint64))
            name.append(np.frombuffer(m, np.int64)[np.frombuffer(p, "<u4" if len(m) > 8 * 65536 else "<u2")])
            size.append(np.frombuffer(s, "<u2").reshape(-1, 2))
        classes = np.concatenate(size)
        a, b = forest(*combine(np.concatenate(key), np.concatenate(name), classes[:, 0], classes[:, 1], far)[4:])
        return pa.table({"a": a, "b": b})

    return rows.select("text").mapInArrow(pack, BLOCKS).groupBy("bucket").applyInArrow(tie, "a long, b long")


def buckets_for(keys: float) -> int:
    return max(8, -(-int(keys * 14) // BUCKET_BYTES))


def one_row_each(names: DataFrame) -> DataFrame:
    """A row per set: its size, its rows' number (``copies``), and the row that stands for it,
    of the smallest id, nulls last, with the number k of equal rows."""
    equal = names.groupBy("name", "doc_id", "key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    one = equal.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "k")).alias("o"),
                                    F.max("n").alias("n"), F.sum("k").alias("copies"))
    return one.select("name", "o.doc_id", "o.key", "o.k", "n", "copies")


def grams_of(rows: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``members`` (name, doc_id, key, k, ...) with their sets, ascending, as ``gram``."""
    keep = [c for c in members.columns if c not in ("doc_id", "key", "k")]
    w = members.alias("w")
    # Dealt out by id and text at every size: how many texts have a candidate grows with the
    # corpus. An id may be null, or stand with several texts.
    texts = rows.alias("r").join(w.hint("merge"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.key") == F.col("w.key")))
    texts = texts.select(*[f"w.{c}" for c in keep], "w.k", "r.text")
    if not members.filter("k > 1").isEmpty():            # rows of equal id and text
        some = texts.filter("k > 1").groupBy(*keep, "k").agg(F.first("text").alias("text"))
        texts = texts.filter("k = 1").union(some)
    texts = texts.select(*keep, "text")
    schema = texts.drop("text").schema.add("gram", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, len(keep), SCAN_BYTES):
            gram, at = sets_of(batch.column(len(keep)), n)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], lists], names=[*keep, "gram"])

    return texts.mapInArrow(run, schema)


def classes(one: DataFrame, labels: DataFrame) -> DataFrame:
    """Per set of a component: the row that stands for the component (best: none, doc_id, key)."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    held = one.select("name", rank.alias("own")).join(labels.select("name", "c"), "name")
    least = held.groupBy("c").agg(F.min("own").alias("best"))
    joined = held.join(least, "c").select("name", "best")
    return one.select("name", "copies", rank.alias("own")).join(joined, "name", "left").select(
        "name", "copies", F.coalesce("best", "own").alias("best"))


def keep_rows(df: DataFrame, names: DataFrame, best: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with one row of each component; rows without words stay; of rows with equal id
    and text any one stays."""
    rows = names.filter("n > 0").groupBy("name", "doc_id", "key").agg(F.count(F.lit(1)).alias("k")).join(best, "name")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # Rows to drop, and those that stay but stand more than once.
    found = rows.withColumn("gone", rank != F.col("best")).filter("gone OR k > 1")
    found = materialize(found.select(F.col("doc_id").alias("id"), "key", "gone"), "sets-gone")
    at = [fresh(df, "__id"), fresh(df, "__key")]
    own = df.withColumns({at[0]: plain(df, doc_id).cast("long"), at[1]: F.xxhash64(plain(df, text))})

    def same(of: DataFrame) -> Column:
        return own[at[0]].eqNullSafe(of["id"]) & (own[at[1]] == of["key"])

    kept = own.join(found, same(found), "left_anti")
    repeated = found.filter("NOT gone")
    if not repeated.isEmpty():
        kept = kept.union(own.join(repeated, same(repeated), "left_semi").dropDuplicates(at))
    return kept.select(*[plain(kept, c) for c in df.columns])
