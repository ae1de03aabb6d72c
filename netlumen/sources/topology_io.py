"""Topology snapshots, reports and model metadata as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.operators.topology import observations

_NODE = ("struct<id:string,name:string,ip:string,ips:array<string>,mac:string,vendor:string,"
         "device_type:string,os:string,subnet:string,site:string,criticality:int,tags:array<string>,"
         "services:array<string>,discovered_by:array<string>,position:struct<x:double,y:double,z:double>,"
         "layer:int>")
_LINK = ("struct<id:string,source:string,target:string,kind:string,bandwidth_mbps:int,"
         "discovered_by:array<string>>")
SCHEMA = f"nodes array<{_NODE}>, links array<{_LINK}>, version long, generated_at double, source string"


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, header) of a snapshot document; ``ord`` is a device's place in it."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select(F.col("ord").cast("long"), "n.*")
    nodes = nodes.withColumns({c: F.col(f"position.{c}") for c in "xyz"}).drop("position")
    links = doc.select(F.explode("links").alias("l")).select("l.*")
    return nodes, links, doc.select("version", "generated_at", "source")


def write_topology(nodes: DataFrame, links: DataFrame, path: str, version: int,
                   source: str = "discovery") -> None:
    """Writes a versioned topology as two JSON-lines tables and a header, so that no
    single document has to hold every device."""
    shaped = nodes
    if set("xyz") <= set(nodes.columns):
        shaped = nodes.withColumn("position", F.struct("x", "y", "z")).drop("x", "y", "z")
    shaped.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")
    head = nodes.sparkSession.range(1).select(
        F.lit(version).cast("long").alias("version"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("generated_at"), F.lit(source).alias("source"))
    head.write.mode("overwrite").json(f"{path}/header")


def read_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = spark.read.schema(spark.createDataFrame([], f"ord long, n {_NODE}").select(
        "ord", "n.*").schema).json(f"{path}/nodes")
    nodes = nodes.withColumns({c: F.col(f"position.{c}") for c in "xyz"}).drop("position")
    links = spark.read.schema(spark.createDataFrame([], f"l {_LINK}").select("l.*").schema).json(
        f"{path}/links")
    head = spark.read.schema("version long, generated_at double, source string").json(f"{path}/header")
    return nodes, links, head


def previous_as_observations(nodes: DataFrame, start_ord: int = 0) -> DataFrame:
    """An earlier topology as sightings, so that a new run merges into it."""
    source = F.coalesce(F.nullif(F.array_join("discovered_by", "+"), F.lit("")), F.lit("previous"))
    return observations(nodes.select(
        (F.col("ord").cast("long") + F.lit(start_ord)).alias("ord"), "ip", "mac",
        F.col("name").alias("hostname"), source.alias("source"),
        F.col("device_type").alias("device_type_hint"), F.col("vendor").alias("vendor_hint"),
        F.col("os").alias("os_hint"), "services"))


def next_version(header: DataFrame, wanted: int = 0) -> DataFrame:
    """Versions only grow: at least one above the stored one."""
    return header.agg(F.greatest(F.lit(wanted).cast("long"), F.max("version") + 1).alias("version"))


def report(detection: DataFrame, latency: DataFrame, throughput: DataFrame,
           classes: DataFrame, config: dict[str, str] | None = None) -> DataFrame:
    """One nested row: the benchmark report."""
    one = lambda df: df.select(F.struct("*")).scalar()
    # Classes are a few dozen rows.
    listed = classes.agg(F.array_sort(F.collect_list(F.struct("class", "count", "flagged",
                                                              "flagged_rate", "is_attack")))).scalar()
    conf = F.create_map(*[F.lit(x) for kv in (config or {"": ""}).items() for x in kv])
    return detection.sparkSession.range(1).select(
        F.current_timestamp().alias("created_utc"), conf.alias("config"),
        one(throughput).alias("throughput"), one(detection).alias("detection"),
        one(latency).alias("latency"), listed.alias("per_class"))


def write_report(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)
