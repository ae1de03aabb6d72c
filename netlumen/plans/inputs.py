"""Tables the catalogue starts from, derived from the given parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.fixtures import spark_view
from netlumen.functions.net import normalize_mac
from netlumen.operators.correlate import attribute_alerts
from netlumen.session import materialize


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "fx_packets")


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "fx_alerts")


def connections(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "fx_connections")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Devices with the columns topology operators expect; ids give the order."""
    return spark_view(spark, sf, "fx_nodes").withColumns({
        "ord": F.col("id"), "mac": normalize_mac(F.col("mac_raw"))})


def attributed(spark: SparkSession, sf: str) -> DataFrame:
    return attribute_alerts(alerts(spark, sf), nodes(spark, sf))


def state_events(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts above threshold on a known device, ready for the decay operators."""
    return (attributed(spark, sf)
            .filter((F.col("score") >= F.col("threshold")) & F.col("node_id").isNotNull())
            .withColumn("ts", F.col("detected_at")))


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    """The same, narrow and written once, for operators that read them several times."""
    events = state_events(spark, sf).select("event_id", "flow_id", "node_id", "ts", "score")
    return materialize(events, "state-events")


def last_detection(spark: SparkSession, sf: str) -> Column:
    return alerts(spark, sf).agg(F.max("detected_at")).scalar()


def link_sightings(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "fx_links")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return spark_view(spark, sf, "fx_observations").withColumns({
        "services": split(F.col("services_csv")), "extra_ips": split(F.col("ips_csv")),
        "extra": F.create_map(F.lit("seen_on"), F.col("interface"))})
