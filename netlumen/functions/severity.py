"""Severity scale: ordered bands over a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale in rank order, and the lower bound of each band.
SCALE = ("none", "info", "low", "medium", "high", "critical")
BANDS = (("critical", 0.95), ("high", 0.80), ("medium", 0.55), ("low", 0.30))
CLEAR_BELOW = 0.05


def severity_of(score: Column) -> Column:
    out = F
    for name, bound in BANDS:
        out = out.when(score >= F.lit(bound), F.lit(name))
    return out.otherwise(F.lit("info"))


def severity_rank(severity: Column) -> Column:
    """0 (none) to 5 (critical)."""
    return (F.array_position(F.array(*[F.lit(s) for s in SCALE]), severity) - 1).cast("int")


def severity_from_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SCALE]), rank.cast("int") + 1)


def to_alerts(scored, threshold: float, now: Column | None = None):
    """Rows at or above the threshold, shaped as alerts. ``now`` is the detection
    time in epoch seconds; a running stream leaves it to the clock."""
    if now is None:
        now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    return scored.filter(F.col("score") >= F.lit(threshold)).select(
        "flow_id", "src_ip", "dst_ip",
        F.col("src_port").cast("int").alias("src_port"),
        F.col("dst_port").cast("int").alias("dst_port"),
        F.col("protocol").cast("int").alias("protocol"),
        F.col("score").cast("double").alias("score"),
        F.lit(float(threshold)).alias("threshold"),
        now.alias("detected_at"),
        (now - F.col("emit_ts")).alias("latency_s"),
        F.col("label").cast("double").alias("label"))


def node_label(name: Column, ip: Column, node_id: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(F.nullif(name, empty), F.nullif(ip, empty), node_id)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text. The nudge sends decimal ties up whatever their binary form."""
    return F.format_string(f"%.{digits}f", value + F.lit(1e-12))


def alert_summary(a) -> Column:
    """Readable one-liner; ``a`` maps a column name to a Column."""
    return F.format_string("%s:%d -> %s:%d score %s", a("src_ip"), a("src_port"),
                           a("dst_ip"), a("dst_port"), fixed(a("score"), 3))
