"""What the operators share: the shared folder, column clashes, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlumen.session import materialize, shared_dir

__all__ = ["attach", "components", "fresh", "map_arrow", "materialize", "plain", "release", "scratch", "tokenizer_path"]


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` that every executor can reach."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def attach(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``columns`` after its own; an input column whose name clashes, in any
    letter case, gives way."""
    taken = {c.lower() for c in columns}
    return df.select(*[plain(df, c) for c in df.columns if c.lower() not in taken],
                     *[c.alias(n) for n, c in columns.items()])


def plain(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and backquotes included."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any letter case."""
    taken, out = {c.lower() for c in df.columns}, name
    while out.lower() in taken:
        out += "_"
    return out


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType) -> DataFrame:
    """``mapInArrow`` by position, for column names that it does not take (backquotes)."""
    names = [f"c{i}" for i in range(len(schema.fields))]

    def by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(names)

    numbered = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema.fields)])
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return rows.mapInArrow(by_position, numbered).toDF(*schema.names)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans whose results have been
    written: it acts on what the driver's garbage collection finds unreachable."""
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): every vertex with its component's least.

    Each round gives all vertices of a label the least label among their neighbours and
    then that vertex's own label, so paths shrink by half or better. A round is
    aggregations and equi joins on tables in the shared folder; only whether a label
    changed reaches the driver. Fails loudly if ``max_rounds`` do not suffice.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both = materialize(both.filter("a <> b").distinct(), f"{label}-edges")
    near = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = materialize(near.select(F.col("a").alias("v"), F.least("a", "least").alias("c")), f"{label}-0")
    for i in range(1, max_rounds):
        seen = both.join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
        offer = seen.groupBy(F.col("a").alias("v")).agg(F.min("cb").alias("o"))
        now = labels.join(offer, "v", "left").select("v", "c", F.least("c", F.coalesce("o", "c")).alias("o"))
        # A label's members all take the least that any of them was offered, and then
        # the label of that vertex, so that chains halve.
        root = now.groupBy("c").agg(F.min("o").alias("r"))
        now = materialize(now.select("v", "c").join(root, "c"), f"{label}-{i}a")
        ahead = now.select(F.col("v").alias("r"), F.col("r").alias("rr"))
        step = now.join(ahead, "r").select("v", F.col("c").alias("was"), F.least("r", "rr").alias("c"))
        step = materialize(step, f"{label}-{i}")
        labels = step.select("v", "c")
        if step.filter("c < was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
