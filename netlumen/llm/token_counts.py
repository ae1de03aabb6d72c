"""Token counts: batches of equal bytes are encoded and only lengths come back.

Rows stream through an Arrow function without a shuffle. Whatever batches Spark deals are
re-cut to about ``batch_bytes`` of text, so that a run of long texts does not make one
batch heavy; a text longer than a batch is encoded part by part, cut only where no token
can cross (before a space that follows a non-space).

Nulls and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Input
columns named like an output column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlumen.llm.common import map_arrow, plain
from netlumen.llm.encoding import encoder
from netlumen.llm.textscan import gathered, utf8

COUNTS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


def counter(path: str, long_chars: int):
    """texts -> numbers of ids, by the library that the file's suffix names."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    pieces = encoder(path)

    def count(texts: list[str]) -> list[int]:
        if len(texts) == 1 and len(texts[0]) > long_chars:
            return [len(pieces.encode_long(texts[0], long_chars)) // 4]
        return [len(ids) // 4 for ids in pieces.encode(texts)]

    return count


def token_counts(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
                 batch_bytes: int = 4 << 20) -> DataFrame:
    """The ``keep`` columns of every row with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    kept = [c for c in keep if c.lower() not in ("n_bytes", "n_tokens")]
    rows = df.select(*[plain(df, c) for c in kept], plain(df, text).alias("__text"))
    schema = T.StructType([*[rows.schema[i] for i in range(len(kept))], *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, batch_bytes)
        for batch in gathered(batches, len(kept), batch_bytes):
            column = batch.column(len(kept))
            _, offsets = utf8(column)
            tokens = count([t or "" for t in column.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(kept))],
                 pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(tokens, pa.int64())],
                names=[*kept, "n_bytes", "n_tokens"])

    return map_arrow(rows, run, schema)


def over_limit(counted: DataFrame, limit: int = 2048) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
