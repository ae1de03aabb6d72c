"""Packing into fixed windows by order-preserving dynamic programming.

A partition's documents, in their order, are one stream of ids. Windows are cut at the
ends of documents (free), at the ends of sentences (a small penalty) or, where a sentence
is longer than a window, inside it (a larger one). With p the position of a cut,

    f(j) = penalty(j) + min over cuts i with p(j) - p(i) <= size of f(i) + padding(p(j) - p(i))

Padding falls by one per id, so f(i) + p(i) is all that matters of i and a monotone queue
gives the minimum in constant time; a window whose length is a power of two is not padded
and has its own few candidates. The stream is solved in chunks of whole documents, so
memory is bounded by ``chunk_ids`` plus one document.

There is no shuffle: rows stay where they are and windows never span partitions. Window
numbers are the partition's number and a count. Nulls and empty texts are one end id.
Repeated rows are packed each; an empty table packs to none.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from netlumen.llm.common import plain
from netlumen.llm.encoding import byte_letters, encoder
from netlumen.llm.textscan import gathered

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
SENTENCE, INSIDE = 4, 32          # penalties, in ids of padding
GRID = 32                         # ids between places for cuts inside a sentence
SEQUENCE_BITS = 36                # of sequence_id; the partition's number is above them


def sentence_ends(tokenizer) -> np.ndarray:
    """Per id: whether its text ends a sentence or a line."""
    # Byte-level vocabularies spell a line feed and the stops of other scripts as bytes.
    spelling = byte_letters()
    stops = (".", "!", "?", *("".join(spelling[b] for b in c.encode()) for c in "\n。！？"))
    out = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.endswith(stops)
    return out


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may be cut, with penalties. A stretch without a sentence's
    end is given a place every ``GRID`` ids, so little is padded there too."""
    where = np.flatnonzero(ends[ids]) + 1
    where = np.union1d(np.concatenate([[0], doc_ends]), where)
    step = min(GRID, size)
    gap = np.diff(where)
    more = np.where(gap >= 2 * step, (gap - 1) // step, 0)
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    inside = np.repeat(where[:-1], more) + nth * step
    where = np.union1d(where, inside)
    penalty = np.full(len(where), SENTENCE, np.int64)
    penalty[np.searchsorted(where, inside)] = INSIDE
    penalty[np.searchsorted(where, doc_ends)] = 0
    penalty[0] = 0
    return where, penalty


def cut(where: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """Positions of the best cuts, first and last included."""
    n = len(where)
    exact_j, exact_i = [], []
    for k in range(size.bit_length() - 1):
        i = np.searchsorted(where, where - (1 << k))
        ok = np.flatnonzero(where[np.minimum(i, n - 1)] == where - (1 << k))
        exact_j.append(ok)
        exact_i.append(i[ok])
    order = np.argsort(js := np.concatenate(exact_j), kind="stable") if exact_j else np.zeros(0, int)
    js = [*js[order].tolist(), n] if exact_j else [n]
    sources = np.concatenate(exact_i)[order].tolist() if exact_i else []
    p, pen = where.tolist(), penalty.tolist()
    f, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(p[0], 0)])       # (f + p, index), least first
    at = 0
    for j in range(1, n):
        here = p[j]
        while p[queue[0][1]] < here - size:
            queue.popleft()
        best, i = queue[0]
        best += size - here
        while js[at] == j:
            s = sources[at]
            if f[s] < best:
                best, i = f[s], s
            at += 1
        best += pen[j]
        f[j], back[j] = best, i
        best += here
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return where[cuts[::-1]]


def pieces(ids: np.ndarray, doc_at: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document index, start and end in the stream, and window of every piece."""
    starts = np.union1d(doc_at[:-1], cuts[:-1])
    ends = np.append(starts[1:], len(ids))
    return (np.searchsorted(doc_at, starts, "right") - 1, starts, ends,
            np.searchsorted(cuts, starts, "right") - 1)


def pack(df: DataFrame, path: str, end_id: int, size: int = 1024, text: str = "text",
         doc_id: str = "doc_id", chunk_ids: int = 1 << 20, max_pieces: int = 1_000_000) -> DataFrame:
    """One row per piece: see ``SCHEMA``. ``doc_tokens`` counts the end id. A worker
    remembers the ids of up to ``max_pieces`` pieces of text, some 200 bytes each."""
    rows = df.select(plain(df, doc_id).cast("long").alias("doc_id"), plain(df, text).alias("text"))

    def solve(docs: list, codes: list[bytes], ends: np.ndarray, first: int):
        stop = np.array([end_id], "<u4").tobytes()
        raw = stop.join(codes) + stop
        ids = np.frombuffer(raw, "<u4")
        doc_at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum([len(c) // 4 + 1 for c in codes], out=doc_at[1:])
        where, penalty = candidates(ids, doc_at[1:], ends, size)
        cuts = cut(where, penalty, size)
        doc, start, end, window = pieces(ids, doc_at, cuts)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((start * 4).tolist(), (end * 4).tolist())]
        batch = pa.RecordBatch.from_arrays([
            pa.array(docs, pa.int64()).take(pa.array(doc)), pa.array(start - doc_at[doc]),
            pa.array(end - start), pa.array(crc, pa.int64()), pa.array(np.diff(doc_at)[doc]),
            pa.array(window + first), pa.array(start - cuts[window])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return batch, first + len(cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = encoder(path, max_pieces)
        ends = sentence_ends(pieces_of.tokenizer)
        ends = np.append(ends, np.zeros(max(0, end_id + 1 - len(ends)), bool))
        first = TaskContext.get().partitionId() << SEQUENCE_BITS
        docs, codes, held = [], [], 0
        for batch in gathered(batches, 1, 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            docs += batch.column(0).to_pylist()
            codes += [pieces_of.encode_long(texts[0])] if len(texts) == 1 else pieces_of.encode(texts)
            held += sum(len(c) // 4 + 1 for c in codes[-len(texts):])
            if held >= chunk_ids:
                out, first = solve(docs, codes, ends, first)
                yield out
                docs, codes, held = [], [], 0
        if docs:
            yield solve(docs, codes, ends, first)[0]

    return rows.mapInArrow(run, SCHEMA)
