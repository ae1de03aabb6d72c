"""Roll-ups, rankings, rates and time series over alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlumen.functions.severity import severity_from_rank, severity_rank
from netlumen.operators.scan import global_rank, in_window, running


def counts_by(df: DataFrame, dims: Mapping[str, str], extra: Mapping[str, Column] | None = None,
              total: bool = False) -> DataFrame:
    """Counts per value of several columns in one pass over grouping sets.

    ``dims`` maps a label to a column; the result has dim, value, n. The rows are
    combined map-side per set before the single shuffle.
    """
    # No grand total without rows of its own set: a set per dimension, () on request.
    cols = list(dims.values())
    cube = [[c] for c in cols] + ([[]] if total else [])
    aggs = [F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"),
            *[c.alias(n) for n, c in (extra or {}).items()]]
    out = df.groupingSets(cube, *cols).agg(*aggs)
    # Spark sets a bit for every column that is rolled away, first column highest.
    full = (1 << len(cols)) - 1
    dim, value = F.lit("total"), F.lit(None).cast("string")
    for i, (label, c) in enumerate(dims.items()):
        mine = F.col("_g") == full - (1 << (len(cols) - 1 - i))
        dim = F.when(mine, label).otherwise(dim)
        value = F.when(mine, F.col(c).cast("string")).otherwise(value)
    return out.select(dim.alias("dim"), value.alias("value"), "n", *(extra or {}))


def top_per_dim(counts: DataFrame, k: int, tie: Sequence[str] = ("value",)) -> DataFrame:
    w = Window.partitionBy("dim").orderBy(F.desc("n"), *tie)
    return counts.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def alert_rollup(alerts: DataFrame, top: int = 10) -> DataFrame:
    """Busiest sources and ports (first seen wins a tie) and the totals row, whose
    mean score is over all alerts."""
    extra = {"mean_score": F.avg("score"), "_seen": F.min("event_id")}
    counts = counts_by(alerts, {"src_ip": "src_ip", "dst_port": "dst_port"}, extra, total=True)
    ranked = top_per_dim(counts, top, ("_seen",))
    return ranked.select("dim", "value", "n", "rk",
                         F.when(F.col("dim") == "total", F.col("mean_score")).alias("mean_score"))


def recent_rate(alerts: DataFrame, as_of: Column, seconds: float = 60.0,
                ts: str = "detected_at") -> DataFrame:
    recent = alerts.filter((F.col(ts) <= as_of) & (as_of - F.col(ts) <= seconds))
    return recent.agg(F.count(F.lit(1)).alias("alerts"),
                      (F.count(F.lit(1)) / F.lit(float(seconds))).alias("rate_per_s"))


def facets(nodes: DataFrame) -> DataFrame:
    """Device counts per subnet, vendor and type."""
    dims = {c: c for c in ("subnet", "vendor", "device_type")}
    return counts_by(nodes, dims)


def timeline_density(events: DataFrame, ts: str = "ts", severity: str = "severity",
                     buckets: int = 90) -> DataFrame:
    """Equal buckets over the observed span: events, worst severity, height 0..1."""
    span = events.agg(F.struct(F.min(ts).alias("a"), F.max(ts).alias("b"))).scalar()
    rows = events.withColumn("_s", span)
    width = F.greatest(F.col("_s.b") - F.col("_s.a"), F.lit(1.0))
    at = F.least(F.floor((F.col(ts) - F.col("_s.a")) / width * buckets), F.lit(buckets - 1))
    counts = rows.groupBy(at.cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.max(severity_rank(F.col(severity))).alias("_w"))
    spine = events.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    filled = spine.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_w", F.lit(0)).alias("_w"))
    # One row per bucket from here on.
    peak = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))
    return filled.select("bucket", "n", severity_from_rank(F.col("_w")).alias("worst"),
                         (F.col("n") / peak).alias("height"))


def sliding_rate(events: DataFrame, ts: str = "ts", window_s: float = 5.0) -> DataFrame:
    """At each event: events of the last ``window_s`` seconds over the time since the
    first of them."""
    out = in_window(events, [], ts, window_s, "_n", "_first")
    span = F.greatest(F.col(ts) - F.col("_first"), F.lit(1e-6))
    return out.withColumn("rate", F.col("_n") / span).drop("_n", "_first")


def alert_rate_per_minute(events: DataFrame, ts: str = "ts", order: str = "event_id",
                          window_s: float = 15.0, min_elapsed: float = 4.0) -> DataFrame:
    """At each event: alerts per minute since the oldest sample inside the window. With
    no earlier sample inside, the previous one is used; NULL until ``min_elapsed``."""
    placed = running(events, [], [ts, order], sums={"_upto": F.lit(1)}, lags={"_prev": F.col(ts)})
    prev = in_window(placed, [], ts, window_s, "_in", "_first", "_end")
    # Rows equal in time but later in order belong to the instant, not to the past.
    prev = prev.withColumn("_back", F.col("_in") - (F.col("_end") - F.col("_upto"))).drop("_upto", "_in", "_end")
    alone = F.col("_back") <= 1
    start = F.when(alone, F.col("_prev")).otherwise(F.col("_first"))
    gained = F.when(alone, F.lit(1)).otherwise(F.col("_back") - 1)
    elapsed = F.col(ts) - start
    rate = F.when(elapsed >= min_elapsed, F.floor(gained / elapsed * 60 + 0.5).cast("long"))
    return prev.withColumn("per_minute", rate).drop("_prev", "_first", "_back")


def resample_last(series: DataFrame, ts: str, value: str, end: Column, step: float = 1.5,
                  points: int = 40, order: str = "event_id", empty: float = 0.0) -> DataFrame:
    """The last known value on a grid of ``points`` ticks ending at ``end``."""
    last_tick = F.floor(end / step)
    follow = running(series, [], [F.desc(ts), F.desc(order)], lags={"_until": F.col(ts)})
    first = F.greatest(F.ceil(F.col(ts) / step), last_tick - (points - 1))
    last = F.least(F.coalesce(F.ceil(F.col("_until") / step) - 1, last_tick), last_tick)
    spread = follow.withColumns({"_a": first, "_b": last}).filter(F.col("_b") >= F.col("_a"))
    held = spread.select(F.explode(F.sequence("_a", "_b")).alias("tick"), F.col(value).alias("_v"))
    spine = series.sparkSession.range(points).select(
        (last_tick - (points - 1) + F.col("id")).alias("tick"), F.col("id").alias("i"))
    return spine.join(held, "tick", "left").select(
        "i", (F.col("tick") * F.lit(float(step))).alias("at"),
        F.coalesce("_v", F.lit(empty)).alias("value"))


def normalised(series: DataFrame, value: str) -> DataFrame:
    """Values scaled to 0..1 between min(values, 0) and max(values, 1)."""
    span = series.agg(F.struct(F.least(F.min(value), F.lit(0.0)).alias("lo"),
                               F.greatest(F.max(value), F.lit(1.0)).alias("hi"))).scalar()
    out = series.withColumn("_s", span)
    width = F.when(F.col("_s.hi") == F.col("_s.lo"), F.lit(1.0)).otherwise(
        F.col("_s.hi") - F.col("_s.lo"))
    return out.withColumn("scaled", (F.col(value) - F.col("_s.lo")) / width).drop("_s")


def newest(df: DataFrame, k: int, ts: str = "detected_at", tie: str = "event_id") -> DataFrame:
    """The k newest rows; a bounded per-task heap, not a sort of the table."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(k)


def newest_per(df: DataFrame, key: str, k: int, ts: str = "detected_at",
               tie: str = "event_id") -> DataFrame:
    """The k newest rows of every key; each task keeps at most k rows per key before
    the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def latest_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of every key, as one aggregation."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def time_range(df: DataFrame, start: float | None = None, end: float | None = None,
               keep: int | None = None, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events between two instants; of more than ``keep``, if given, the newest ones."""
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) <= end)
    return df if keep is None else newest(df, keep, ts, tie)


def numbered(df: DataFrame, ts: str = "detected_at", tie: str = "event_id") -> DataFrame:
    """Sequence numbers in time order."""
    return global_rank(df, [ts, tie], "seq")
