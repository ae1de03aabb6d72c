"""Words of whole texts as arrays: one pass over an Arrow batch's bytes, no Python per word.

A text is its UTF-8 bytes. Every class of word used here is a set of bytes, in which all
bytes of a non-ASCII letter count as letters, so cutting bytes cuts characters rightly.
A word is known by a 64-bit hash that is the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _table(outside: set[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


# [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; the second after lower-casing A-Z.
SPACED = _table({0x20, *range(0x09, 0x0E)})
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
NOT_FEED = _table({0x0A})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
_LETTERS = np.random.default_rng(20240521).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next batch."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray = LOWER
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of ``inside`` bytes, and the index of
    each text's first run (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[fold[data]]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, mask[1:]
    ends = np.flatnonzero(mask & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[fold[data]] * up[1:], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, text by text, and each text's first window.

    A text of fewer than k words, but not none, is one window."""
    n = np.diff(bounds)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=at[1:])
    with np.errstate(over="ignore"):
        text = np.repeat(np.arange(len(n)), per)
        start = np.arange(at[-1]) - at[text] + bounds[text]
        length = np.minimum(k, n)[text]
        out = length.astype(np.uint64) * _U(_BASE)
        for i in range(k):
            step = mix(out + words[np.minimum(start + i, len(words) - 1)]) if len(words) else out
            out = np.where(i < length, step, out)
    return out, at


def slices(batch: pa.RecordBatch, column: int | str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is alone."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], column: int | str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text, whatever sizes Spark deals."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            n = int(utf8(part.column(column))[1][-1])
            if held and size + n > most:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
