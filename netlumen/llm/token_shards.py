"""Token ids as patched frame-of-reference files, in ascending document order.

A table of segments is written with Spark's own Parquet writer, so a lost task is written
again and never twice. A segment holds whole documents, about ``SEGMENT_IDS`` ids, as one
byte string:

    "PFR1", number of ids, block length, number of blocks          4 x uint32
    start of each block in the body, in bytes                      uint32 each
    body; a block is   minimum uint32, width uint8, exceptions uint8 x 2 (low, high)
                       ids less the minimum, ``width`` bits each, lowest bit first
                       exceptions: positions uint8 each, then values less the minimum uint32 each

The width of a block is what the ``PERCENTILE`` of its values need; larger values are
exceptions. Block starts make any id reachable without unpacking what is before it.
Beside the bytes a row has the documents' ids and lengths, the partition (ascending in
document order) and the segment's first id in it.

Documents are dealt and sorted by (id, text hash), so a null or repeated id, however
frequent, spans partitions; null ids come first, equal rows are each written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlumen.llm.common import plain
from netlumen.llm.encoding import encoder
from netlumen.llm.textscan import gathered

MAGIC = b"PFR1"
BLOCK, PERCENTILE, SEGMENT_IDS = 256, 90, 1 << 18
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("low", "u1"), ("high", "u1")])
SEGMENTS = ("part int, seq long, first long, n_ids long, docs array<long>, lengths array<long>, "
            "segment binary")
DOCUMENTS = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"


def bits_of(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """``ids`` (uint32) as one segment."""
    n, n_blocks = len(ids), -(-len(ids) // block)
    head = MAGIC + np.array([n, block, n_blocks], "<u4").tobytes()
    if not n:
        return head
    grid = np.append(ids, np.full(n_blocks * block - n, ids[-1], "<u4")).astype(np.uint32).reshape(n_blocks, block)
    least = grid.min(axis=1)
    rest = grid - least[:, None]
    k = min(block - 1, int(block * percentile / 100))
    width = bits_of(np.partition(rest, k, axis=1)[:, k])
    over = rest.astype(np.uint64) >> width.astype(np.uint64)[:, None] != 0 if width.max() > 31 else rest >> width.astype(np.uint32)[:, None] != 0
    exceptions = over.sum(axis=1)
    payload: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        whole = rest[rows].astype("<u2" if w <= 16 else "<u4")
        bits = np.unpackbits(whole.view(np.uint8), axis=1, bitorder="little").reshape(len(rows), block, -1)
        packed = np.packbits(bits[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
        for row, data in zip(rows.tolist(), packed):
            payload[row] = data.tobytes()
    tops = np.zeros(n_blocks, HEAD)
    tops["least"], tops["width"] = least, width
    tops["low"], tops["high"] = exceptions & 255, exceptions >> 8
    body = []
    for i in range(n_blocks):
        where = np.flatnonzero(over[i])
        body.append(tops[i].tobytes() + payload[i] + where.astype(np.uint8).tobytes()
                    + rest[i, where].astype("<u4").tobytes())
    starts = np.zeros(n_blocks, np.int64)
    np.cumsum([len(b) for b in body[:-1]], out=starts[1:])
    return head + starts.astype("<u4").tobytes() + b"".join(body)


def decode_segment(segment: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a segment; only their blocks are unpacked."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment")
    n, block, n_blocks = np.frombuffer(segment, "<u4", 3, 4).tolist()
    stop = n if count is None else min(n, start + count)
    if start >= stop:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(segment, "<u4", n_blocks, 16).astype(np.int64) + 16 + 4 * n_blocks
    first, last = start // block, (stop - 1) // block
    at = starts[first:last + 1]
    data = np.frombuffer(segment, np.uint8)
    tops = data[at[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0]
    out = np.zeros((len(at), block), np.uint32)
    for w in np.unique(tops["width"]).tolist():
        rows = np.flatnonzero(tops["width"] == w)
        if w:
            packed = data[(at[rows] + HEAD.itemsize)[:, None] + np.arange(block * w // 8)]
            wide = np.zeros((len(rows), block, 16 if w <= 16 else 32), np.uint8)
            wide[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), block, w)
            out[rows] = np.packbits(wide.reshape(len(rows), -1), axis=1, bitorder="little").view(
                "<u2" if w <= 16 else "<u4")
    exceptions = tops["low"].astype(np.int64) + 256 * tops["high"].astype(np.int64)
    for i in np.flatnonzero(exceptions).tolist():
        m = int(exceptions[i])
        begin = int(at[i]) + HEAD.itemsize + block * int(tops["width"][i]) // 8
        where = data[begin:begin + m]
        out[i, where] = np.frombuffer(segment, "<u4", m, begin + m)
    out += tops["least"][:, None]
    return out.reshape(-1)[start - first * block:stop - first * block]


def write(df: DataFrame, out: str, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes every text, appends ``end_id`` and writes segments to the folder ``out``."""
    rows = df.select(plain(df, doc_id).cast("long").alias("doc_id"), plain(df, text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        stop = np.array([end_id], "<u4").tobytes()
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs, codes, held = [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(stop.join(codes) + stop, "<u4")
            lengths = [len(c) // 4 + 1 for c in codes]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq]), pa.array([first]), pa.array([len(ids)]),
                pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([encode_segment(ids)], pa.binary())],
                names=["part", "seq", "first", "n_ids", "docs", "lengths", "segment"])

        for batch in gathered(batches, 1, 1 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            docs += batch.column(0).to_pylist()
            codes += [pieces.encode_long(texts[0])] if len(texts) == 1 else pieces.encode(texts)
            held += sum(len(c) // 4 + 1 for c in codes[-len(texts):])
            if held >= SEGMENT_IDS:
                yield segment()
                first, seq, docs, codes, held = first + held, seq + 1, [], [], 0
        if docs:
            yield segment()

    rows.mapInArrow(run, SEGMENTS).write.parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start (ids of all documents before
    it), n_tokens with the end id, and the CRC-32 of its ids as little-endian uint32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = decode_segment(row["segment"]).astype("<u4").tobytes()
                at = np.zeros(len(row["docs"]) + 1, np.int64)
                np.cumsum(row["lengths"], out=at[1:])
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["docs"], pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()),
                    pa.array(at[:-1] + row["first"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    docs = segments.select("part", "seq", "first", "n_ids", "docs", "lengths", "segment").mapInArrow(run, DOCUMENTS)
    # One row per partition of the files, not per document, is put in order here.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(totals, "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
