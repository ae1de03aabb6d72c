"""Fixed input and output schemas, and the checks that enforce them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONNECTION_STRINGS = ("flow_id", "src_ip", "dst_ip")
# Field order of a connection record.
CONNECTION_NUMERIC = (
    "src_port", "dst_port", "protocol", "start_ts", "emit_ts", "duration",
    "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
    "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count",
    "iat_mean", "iat_std", "iat_min", "iat_max",
    "pkt_size_mean", "pkt_size_std", "pkt_size_min", "pkt_size_max",
    "payload_entropy", "tls_present", "tls_sni_len", "http_present", "http_req_count",
    "label",
)
CONNECTION_FIELDS = CONNECTION_STRINGS + CONNECTION_NUMERIC
LABEL_UNKNOWN = -1.0

CONNECTION = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in CONNECTION_STRINGS]
    + [T.StructField(n, T.DoubleType(), False) for n in CONNECTION_NUMERIC]
)

PACKET = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tls_sni_len", T.IntegerType()),
    T.StructField("is_http_request", T.BooleanType()),
])

ALERT = T.StructType([
    T.StructField("flow_id", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("detected_at", T.DoubleType()),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("label", T.DoubleType()),
])

# Observations carry every attribute a discovery source may report.
HOST_OBSERVATION = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("ip", T.StringType()),
    T.StructField("mac", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("interface", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("device_type_hint", T.StringType()),
    T.StructField("vendor_hint", T.StringType()),
    T.StructField("os_hint", T.StringType()),
    T.StructField("services", T.ArrayType(T.StringType())),
    T.StructField("extra_ips", T.ArrayType(T.StringType())),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

LINK_OBSERVATION = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("local", T.StringType()),
    T.StructField("remote", T.StringType()),
    T.StructField("local_port", T.StringType()),
    T.StructField("remote_port", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("bandwidth_mbps", T.IntegerType()),
    T.StructField("local_mac", T.StringType()),
    T.StructField("remote_mac", T.StringType()),
])

# Device types and link kinds.
DEVICE_TYPES = ("router", "switch", "firewall", "server", "workstation", "printer",
                "iot", "wireless_ap", "unknown")
INFRA_TYPES = ("switch", "router", "firewall", "wireless_ap")
class SchemaMismatch(ValueError):
    pass


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaMismatch(f"{what} lacks columns {missing}")
    return df


def as_connections(df: DataFrame) -> DataFrame:
    """Exactly the 33 connection columns, in order and typed; refuses narrower input."""
    require_columns(df, CONNECTION_FIELDS, "connection table")
    return df.select(
        *[F.col(n).cast("string").alias(n) for n in CONNECTION_STRINGS],
        *[F.col(n).cast("double").alias(n) for n in CONNECTION_NUMERIC],
    )


def numeric_tail(df: DataFrame) -> DataFrame:
    """The 30 numeric columns of a connection table."""
    return as_connections(df).select(*CONNECTION_NUMERIC)


def fill_partial(df: DataFrame) -> DataFrame:
    """Complete partial connection records: absent strings become '', numbers 0."""
    def column(name: str, empty: Column, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return F.coalesce(value, empty).alias(name)

    return df.select(
        *[column(n, F.lit(""), "string") for n in CONNECTION_STRINGS],
        *[column(n, F.lit(0.0), "double") for n in CONNECTION_NUMERIC],
    )
