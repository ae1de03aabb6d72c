"""Shards by extendible hashing: a bucket splits on its next hash bit only while too large.

A row's key is 60 bits of an MD5 over its id and text. Rows are first summed by the leading
bits of the key (one small row per cell, combined before the shuffle); every prefix of a
cell is a possible bucket, and a cell belongs to its shortest prefix that fits the limit.
That is the directory: cell -> bucket. Cells that are too large alone are cut finer, in
further rounds that look at their rows only. A bucket of one single key is not split: one
text beyond the limit is a shard of its own, and equal rows beyond it are dealt to
overflow pages.

Shards are written as folders of Parquet files, each dealt to up to ``FILES`` tasks by the
following hash bits, so that no task holds more than a part of the limit. A null id or
text counts as empty (0 bytes). Equal rows are each kept; an empty table has no shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.llm.common import attach, materialize, plain, scratch

BITS, STEP, FILES = 60, 6, 8


def key_of(doc_id: Column, text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def _cell(depth: int) -> Column:
    return F.shiftright(F.col("h"), BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Per round its depth and table (cell, depth, prefix, pages) of the cells it settles.

    ``keys`` has h and n_bytes. The driver sees one total and one flag per round."""
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    rounds, shallow, left = [], 0, keys
    while True:
        cells = left.groupBy(_cell(depth).alias("cell")).agg(
            F.sum("n_bytes").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        up = F.sequence(F.lit(shallow), F.lit(depth))
        prefixes = cells.select("*", F.explode(up).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sizes = prefixes.groupBy("depth", "prefix").agg(
            F.sum("n").alias("size"), (F.min("lo") == F.max("hi")).alias("one"))
        fits = sizes.filter((F.col("size") <= limit) | F.col("one") | (F.col("depth") == BITS))
        pages = F.greatest(F.lit(1), F.ceil(F.col("size") / limit)).cast("int")
        settled = prefixes.join(fits, ["depth", "prefix"]).groupBy("cell").agg(
            F.min_by(F.struct("depth", "prefix", pages.alias("pages")), "depth").alias("b"))
        settled = materialize(settled.select("cell", "b.*"), "directory")
        rounds.append((depth, settled))
        if depth == BITS:
            return rounds
        left = left.withColumn("cell", _cell(depth)).join(settled, "cell", "left_anti").drop("cell")
        left = materialize(left, "directory-rest")
        if left.isEmpty():
            return rounds
        shallow, depth = depth + 1, min(BITS, depth + STEP)


def assign(df: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with n_bytes and shard: "b" and the prefix bits, and "-page" where one key's
    equal rows overflow. ``__h`` is the row's key."""
    rows = attach(df, {"__row": F.monotonically_increasing_id(), "__h": key_of(plain(df, doc_id), plain(df, text)),
                       "n_bytes": F.coalesce(F.octet_length(plain(df, text)), F.lit(0)).cast("long")})
    keys = materialize(rows.select(F.col("__h").alias("h"), "n_bytes"), "shard-keys")
    found = None
    for i, (depth, settled) in enumerate(directory(keys, limit)):
        cell = F.shiftright(F.col("__h"), BITS - depth)
        bucket = settled.select(F.col("cell").alias(f"__c{i}"), F.struct("depth", "prefix", "pages").alias(f"__b{i}"))
        rows = rows.join(bucket, cell == F.col(f"__c{i}"), "left").drop(f"__c{i}")
        found = F.col(f"__b{i}") if found is None else F.coalesce(found, F.col(f"__b{i}"))
    page = F.when(F.col("__f.pages") > 1, F.concat(F.lit("-"), F.pmod(F.xxhash64("__row"), F.col("__f.pages"))))
    rows = rows.withColumn("__f", found)
    bits = F.when(F.col("__f.depth") == 0, "").otherwise(F.expr("lpad(bin(__f.prefix), __f.depth, '0')"))
    rows = attach(rows, {"shard": F.concat(F.lit("b"), bits, F.coalesce(page, F.lit("")))})
    return rows.drop("__row", "__f", *[c for c in rows.columns if c.startswith("__b")])


def write(df: DataFrame, out: str, limit: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes ``df`` into folder ``out``, one subfolder per shard."""
    rows = assign(df, limit, doc_id, text)
    part = F.pmod(F.xxhash64("__h"), F.lit(FILES))
    rows.repartition("shard", part).drop("__h").write.partitionBy("shard").parquet(out)


def shard(df: DataFrame, limit: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards to the shared folder and reads them back: every row with its
    ``shard`` and ``n_bytes``."""
    spark, out = df.sparkSession, scratch(df.sparkSession, "shards")
    write(df, out, limit, doc_id, text)
    fields = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes if c.lower() not in ("n_bytes", "shard"))
    return spark.read.schema(f"{fields}, n_bytes bigint, shard string").parquet(out)


def with_sizes(sharded: DataFrame) -> DataFrame:
    """Each row with its shard's bytes and rows."""
    sizes = sharded.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    return sharded.join(sizes, "shard")
