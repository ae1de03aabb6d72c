"""Benchmark passages in training texts: an FM-index per shard of documents.

Each task streams its documents in shards of about ``SHARD_BYTES``. A shard's words become
numbers (those no test phrase has become separators, a run of them one), its FM-index is
built, every phrase of the benchmark is searched backwards in it at once, and the places
found become word spans, which are merged per document. Documents are not shuffled.

A phrase is ``window`` consecutive words of an item; a shorter item, if it has words, is
one phrase. Words are runs of ASCII letters and digits and of non-ASCII characters, with
A-Z lower-cased. The phrases are the broadcast side: the benchmark is dealt into blocks of
about ``block_bytes`` of text, and documents are scanned once per block.

Null and empty texts have no words and no hits, null and empty items no phrases; an item
without an id counts under the empty name. Rows are judged each, also repeated ones.
Columns of the input named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlumen.llm.common import attach, fresh, map_arrow, materialize, plain
from netlumen.llm.fm_index import FMIndex
from netlumen.llm.textscan import ALNUM, gathered, hashes, runs, utf8

SHARD_BYTES = 4 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Phrases:
    """The distinct phrases of a block of items, as numbers."""

    words: np.ndarray            # hashes of all words, ascending; word i is symbol i + 1
    phrases: np.ndarray          # symbols, right-aligned
    lengths: np.ndarray
    items: list[list[str]]       # by phrase


def phrases_of(items: Sequence[tuple[str | None, str | None]], window: int) -> Phrases | None:
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    start, end, bounds = runs(data, offsets, ALNUM)
    word = hashes(data, start, end)
    if not len(word):
        return None
    known, symbol = np.unique(word, return_inverse=True)
    found: dict[tuple, set[str]] = {}
    for (name, _), a, b in zip(items, bounds[:-1].tolist(), bounds[1:].tolist()):
        for i in range(a, max(b - window, a) + 1 if b > a else a):
            found.setdefault(tuple((symbol[i:min(i + window, b)] + 1).tolist()), set()).add(name or "")
    grid = np.zeros((len(found), window), np.int64)
    for row, phrase in enumerate(found):
        grid[row, window - len(phrase):] = phrase
    return Phrases(known, grid, np.array([len(p) for p in found]), [sorted(v) for v in found.values()])


def search(column: pa.Array, p: Phrases) -> tuple[np.ndarray, ...]:
    """Per text the first word (one more entry than texts); the words' byte ranges; and per
    hit the text, its first word in the text, and the phrase."""
    data, offsets = utf8(column)
    start, end, bounds = runs(data, offsets, ALNUM)
    word = hashes(data, start, end)
    place = np.minimum(np.searchsorted(p.words, word), len(p.words) - 1)
    symbol = np.where(p.words[place] == word, place + 1, 0)
    # A separator after each text, then runs of separators become one.
    n = np.diff(bounds)
    spot = np.arange(len(word)) + np.repeat(np.arange(len(n)), n)
    line = np.zeros(len(word) + len(n), np.int64)
    line[spot] = symbol
    origin = np.full(len(line), -1, np.int64)
    origin[spot] = np.arange(len(word))
    keep = (line != 0) | np.append(True, line[:-1] != 0)
    line, origin = line[keep], origin[keep]
    empty = np.zeros(0, np.int64)
    if not line.any():
        return bounds, start, end, empty, empty, empty
    line, origin = (line, origin) if line[-1] == 0 else (np.append(line, 0), np.append(origin, -1))
    index = FMIndex(line, len(p.words) + 1)
    which, low, high = index.search(p.phrases, p.lengths)
    position, hit = index.locate(low, high)
    at = origin[position]
    text = np.searchsorted(bounds, at, "right") - 1
    return bounds, start, end, text, at - bounds[text], which[hit]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as disjoint spans, ascending."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def by_text(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(text, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(text[order])) + 1) if len(order) else []:
        yield int(text[part[0]]), part


def blocks(benchmark: DataFrame, window: int, item_id: str, text: str, block_bytes: int):
    """Broadcast phrases, one block of items after another."""
    rows = benchmark.select(plain(benchmark, item_id).cast("string").alias("item"), plain(benchmark, text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else rows
        phrases = phrases_of([tuple(r) for r in part.collect()], window)
        if phrases is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(phrases)


def contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, keep: Sequence[str] = ("doc_id",),
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  block_bytes: int = 8 << 20) -> DataFrame:
    """The ``keep`` columns of every row with ``n_words``, merged hit ``spans`` (words, end
    exclusive) and the ``items`` found, as strings in order."""
    names = [c for c in keep if c.lower() not in ("n_words", "spans", "items")]
    rows = df.select(*[plain(df, c) for c in names], plain(df, text).alias("__text"),
                     F.lit(None).cast("long").alias("__n"), F.lit(None).cast(SPANS).alias("__spans"),
                     F.lit(None).cast("array<string>").alias("__items"))
    at, schema = len(names), rows.schema
    found = list(blocks(benchmark, window, item_id, item_text, block_bytes))

    def scan(phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = phrases.value if phrases is not None else None
            for batch in gathered(batches, at, SHARD_BYTES):
                if p is None:
                    bounds = runs(*utf8(batch.column(at)), ALNUM)[2]
                    doc = first = which = np.zeros(0, np.int64)
                else:
                    bounds, _, _, doc, first, which = search(batch.column(at), p)
                spans = [x or [] for x in batch.column(at + 2).to_pylist()]
                items = [x or [] for x in batch.column(at + 3).to_pylist()]
                for d, part in by_text(doc):
                    w = which[part]
                    a = np.concatenate([first[part], [s["start"] for s in spans[d]]]).astype(np.int64)
                    b = np.concatenate([first[part] + p.lengths[w], [s["end"] for s in spans[d]]]).astype(np.int64)
                    spans[d] = [{"start": x, "end": y} for x, y in zip(*(v.tolist() for v in merged(a, b)))]
                    items[d] = sorted({*items[d], *(i for k in np.unique(w).tolist() for i in p.items[k])})
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:at + 1], pa.array(np.diff(bounds), pa.int64()),
                     pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))],
                    names=[*names, "__text", "__n", "__spans", "__items"])
        return run

    for phrases in found or [None]:
        rows = map_arrow(rows, scan(phrases), schema)
    return rows.select(*[plain(rows, c) for c in names], F.col("__n").alias("n_words"),
                       F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of hit words and items in place of the spans and names."""
    return attach(found, {
        "n_hit": F.aggregate(found["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]),
        "n_items": F.size(found["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(found["items"]), ",").cast("binary"), 256),
        "contaminated": F.size(found["spans"]) > 0,
    }).drop("spans", "items")


def remove(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", length: str | None = "n_chars",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with every hit span cut out of its text, a blank in its place, until no phrase
    is left; ``length``, if the table has it, is the new length of a changed text."""
    names, flag = df.columns, fresh(df, "__cut")
    at = names.index(text)
    size = names.index(length) if length in names else None
    found = list(blocks(benchmark, window, item_id, item_text, block_bytes))
    rows = df.withColumn(flag, F.lit(False))
    schema = rows.schema

    def cut(phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = phrases.value
            for batch in gathered(batches, at, SHARD_BYTES):
                columns = list(batch.columns)
                changed, todo = {}, np.arange(batch.num_rows)
                while len(todo):
                    column = (columns[at] if not changed else
                              pa.array([changed[i] for i in todo.tolist()], columns[at].type))
                    _, offsets = utf8(column)
                    bounds, start, end, doc, first, which = search(column, p)
                    raw, again = utf8(column)[0], []
                    for d, part in by_text(doc):
                        a, b = merged(first[part], first[part] + p.lengths[which[part]])
                        left = np.concatenate([[offsets[d]], end[bounds[d] + b - 1]])
                        right = np.concatenate([start[bounds[d] + a], [offsets[d + 1]]])
                        changed[int(todo[d])] = b" ".join(raw[x:y].tobytes() for x, y in zip(left, right)).decode()
                        again.append(int(todo[d]))
                    todo = np.array(again, np.int64)
                if changed:
                    texts = columns[at].to_pylist()
                    lengths = columns[size].to_pylist() if size is not None else None
                    for i, t in changed.items():
                        texts[i] = t
                        if lengths is not None:
                            lengths[i] = len(t)
                    columns[at] = pa.array(texts, columns[at].type)
                    if lengths is not None:
                        columns[size] = pa.array(lengths, columns[size].type)
                    mark = np.array(columns[-1].to_pylist(), bool)
                    mark[list(changed)] = True
                    columns[-1] = pa.array(mark)
                yield pa.RecordBatch.from_arrays(columns, names=[*names, flag])
        return run

    while True:
        for phrases in found:
            rows = map_arrow(rows, cut(phrases), schema)
        if len(found) < 2:
            return rows.drop(flag)
        # A cut for one block may join words into a phrase of another: go round again.
        rows = materialize(rows, "decontaminate")
        if rows.filter(F.col(flag)).isEmpty():
            return rows.drop(flag)
        rows = rows.withColumn(flag, F.lit(False))
