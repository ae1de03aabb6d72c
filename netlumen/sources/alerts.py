"""Alert payloads: tolerant decoding of single objects or batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default of each field when it is absent, empty or malformed.
DEFAULTS = {"flow_id": "", "src_ip": "", "dst_ip": "", "src_port": 0, "dst_port": 0,
            "protocol": 6, "score": 0.0, "threshold": 0.0, "detected_at": 0.0,
            "latency_s": 0.0, "label": -1.0}
_KIND = {str: "string", int: "int", float: "double"}


def _field(raw: Column, name: str) -> Column:
    default = DEFAULTS[name]
    text = F.try_element_at(raw, F.lit(name))
    if isinstance(default, str):
        value = text
    elif isinstance(default, int):
        value = text.try_cast("double").cast("int")
    else:
        value = text.try_cast("double")
    if name == "protocol":                       # 0 counts as not given
        value = F.nullif(value, F.lit(0))
    return F.coalesce(value, F.lit(default)).cast(_KIND[type(default)]).alias(name)


def decode_alerts(payloads: DataFrame, body: str = "value") -> DataFrame:
    """One row per alert of each JSON payload; unknown keys are ignored, missing ones
    defaulted. Works on static and streaming tables alike."""
    text = F.trim(F.col(body).cast("string"))
    batch = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<map<string,string>>")
                   ).otherwise(F.array(F.from_json(text, "map<string,string>")))
    rest = [c for c in payloads.columns if c != body]
    raw = payloads.select(*rest, F.explode(batch).alias("_a")).filter(F.col("_a").isNotNull())
    return raw.select(*rest, *[_field(F.col("_a"), n) for n in DEFAULTS])


def encode_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.to_json(F.struct(*DEFAULTS)).alias("value"))


def kafka_alerts(spark, servers: str, topic: str, from_start: bool = False) -> DataFrame:
    """Live alert stream of a broker; ``from_start`` replays what the topic still holds.
    Needs the Kafka connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic)
           .option("startingOffsets", "earliest" if from_start else "latest").load())
    return decode_alerts(raw.select("value"))
