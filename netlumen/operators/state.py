"""Decaying per-device severity, live or as of any instant.

A score holds for ``dwell`` seconds and then halves every ``half_life`` seconds
until the next alert, which lifts it to the larger of the two. With F the summed
fading time since the first alert of a device, the score after alert n is
``2 ** (max over k <= n of (log2 s_k + F_k / half_life) - F_n / half_life)``, so a
running sum and a running maximum replace the sequential fold. Both are taken
per (device, time slice) and carried across slices (see ``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlumen.functions.severity import CLEAR_BELOW, severity_of, severity_rank
from netlumen.operators.scan import BEFORE, UP_TO, in_window, ranges, running


@dataclass(frozen=True)
class Decay:
    half_life: float = 120.0
    dwell: float = 30.0
    window: float = 300.0
    rows: int | None = None          # of alerts a task scans; None: as all scans

    def faded(self, gap: Column) -> Column:
        return F.greatest(gap - F.lit(self.dwell), F.lit(0.0))

    def at(self, score: Column, elapsed: Column) -> Column:
        """Score ``elapsed`` seconds after its last alert; 0 once it is clear.
        A score still inside its dwell time is never cleared."""
        gap = F.greatest(elapsed, F.lit(0.0))
        cooled = score * F.pow(F.lit(0.5), self.faded(gap) / F.lit(self.half_life))
        return F.when((score <= 0) | (gap <= self.dwell), score).otherwise(
            F.when(cooled < CLEAR_BELOW, F.lit(0.0)).otherwise(cooled))

    def severity_at(self, score: Column, elapsed: Column) -> Column:
        now = self.at(score, elapsed)
        return F.when((score > 0) & (now == 0), "none").otherwise(severity_of(now))


DEFAULT = Decay()


def _local(events: DataFrame, keys: Sequence[str], d: Decay) -> DataFrame:
    w = Window.partitionBy(*keys, "_slice").orderBy("ts", "event_id")
    upto = w.rowsBetween(*UP_TO)
    return (ranges(events, keys, ["ts", "event_id"], d.rows)
            .withColumn("_prev", F.lag("ts").over(w))
            .withColumn("_fade", F.coalesce(d.faded(F.col("ts") - F.col("_prev")), F.lit(0.0)))
            .withColumn("_f", F.sum("_fade").over(upto))
            .withColumn("_m", F.max(F.log2("score") + F.col("_f") / d.half_life).over(upto)))


def _slices(local: DataFrame, keys: Sequence[str], d: Decay) -> DataFrame:
    """One row per (device, slice) with what its earlier slices add up to."""
    order = F.struct("ts", "event_id")
    slices = local.groupBy(*keys, "_slice").agg(
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.max("_f").alias("_fs"),
        F.max("_m").alias("_ms"), F.count(F.lit(1)).alias("_ns"),
        F.max_by("flow_id", order).alias("_last_id"))
    w = Window.partitionBy(*keys).orderBy("_slice")
    enter = F.coalesce(d.faded(F.col("_t0") - F.lag("_t1").over(w)), F.lit(0.0))
    return (slices.withColumn("_enter", enter)
            .withColumn("_g", F.sum("_enter").over(w.rowsBetween(*UP_TO))
                        + F.coalesce(F.sum("_fs").over(w.rowsBetween(*BEFORE)), F.lit(0.0)))
            .withColumn("_mb", F.max(F.col("_ms") + F.col("_g") / d.half_life)
                        .over(w.rowsBetween(*BEFORE)))
            .withColumn("_nb", F.coalesce(F.sum("_ns").over(w.rowsBetween(*BEFORE)), F.lit(0)))
            .withColumn("_next", F.lead("_t0").over(w)))


def _score(m: Column, f: Column, d: Decay) -> Column:
    return F.coalesce(F.pow(F.lit(2.0), m - f / F.lit(d.half_life)), F.lit(0.0))


def score_timeline(events: DataFrame, keys: Sequence[str] = ("node_id",),
                   d: Decay = DEFAULT) -> DataFrame:
    """Per alert: the device score right after it, its running number and the time of
    the device's next alert. ``events`` needs keys, event_id, flow_id, ts, score."""
    local = _local(events, keys, d)
    w = Window.partitionBy(*keys, "_slice").orderBy("ts", "event_id")
    local_rows = local.withColumns({"_rn": F.row_number().over(w), "_lead": F.lead("ts").over(w)})
    carried = _slices(local, keys, d).select(*keys, "_slice", "_g", "_mb", "_nb", "_next")
    rows = local_rows.join(carried, [*keys, "_slice"], "left")
    m = F.greatest(F.col("_m") + F.col("_g") / d.half_life, F.col("_mb"))
    return rows.select(
        *[F.col(c) for c in events.columns if c != "score"],
        F.col("score").alias("event_score"),
        _score(m, F.col("_f") + F.col("_g"), d).alias("score"),
        (F.col("_rn") + F.col("_nb")).alias("alert_count"),
        F.coalesce("_lead", "_next").alias("next_ts"))


def state_at(events: DataFrame, as_of: Column, keys: Sequence[str] = ("node_id",),
             d: Decay = DEFAULT) -> DataFrame:
    """Every non-clear device as it was at ``as_of``; alerts after it are ignored.
    Only slice summaries are shuffled past the first exchange."""
    seen = events.filter(F.col("ts") <= as_of)
    slices = _slices(_local(seen, keys, d), keys, d)
    last = slices.groupBy(*keys).agg(
        F.max(F.col("_ms") + F.col("_g") / d.half_life).alias("_m"),
        F.max(F.col("_fs") + F.col("_g")).alias("_f"),
        F.sum("_ns").alias("alert_count"),
        F.min("_t0").alias("first_alert_at"), F.max("_t1").alias("last_alert_at"),
        F.max_by("_last_id", "_slice").alias("last_alert_id"))
    base = last.withColumn("_s", _score(F.col("_m"), F.col("_f"), d))
    elapsed = as_of - F.col("last_alert_at")
    return (base.select(*keys, d.severity_at(F.col("_s"), elapsed).alias("severity"),
                        d.at(F.col("_s"), elapsed).alias("score"), "alert_count",
                        "first_alert_at", "last_alert_at", "last_alert_id")
            .filter(F.col("severity") != "none"))


def ranked(states: DataFrame, top: int | None = None) -> DataFrame:
    """Worst first; ties by most recent alert. ``top`` turns it into a bounded sort."""
    out = states.withColumn("rank", severity_rank(F.col("severity")))
    order = [F.desc("rank"), F.desc("last_alert_at"), F.asc("node_id")]
    return out.orderBy(*order) if top is None else out.orderBy(*order).limit(top)


def with_epoch(events: DataFrame, acks: DataFrame, d: Decay = DEFAULT) -> DataFrame:
    """Numbers the periods between acknowledgements: an acknowledgement clears a
    device, so later alerts start from nothing. ``acks`` needs node_id, ts."""
    marks = acks.select("node_id", "ts", F.lit(1).alias("_ack"))
    both = events.withColumn("_ack", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    # An alert at the very instant of an acknowledgement counts as after it.
    order = [F.col("ts"), F.desc("_ack"), F.col("event_id")]
    out = running(both, ["node_id"], order, rows=d.rows,
                  sums={"epoch": F.col("_ack")})
    return out.filter(F.col("_ack") == 0).drop("_ack")


def state_after_acks(events: DataFrame, acks: DataFrame, as_of: Column,
                     d: Decay = DEFAULT) -> DataFrame:
    """States at ``as_of`` when acknowledgements up to then are honoured: only the
    alerts after a device's last acknowledgement count."""
    cleared = (acks.filter(F.col("ts") <= as_of).groupBy("node_id")
               .agg(F.max("ts").alias("_cleared_at")))
    live = events.join(cleared, "node_id", "left").filter(
        F.col("_cleared_at").isNull() | (F.col("ts") >= F.col("_cleared_at")))
    return state_at(live.drop("_cleared_at"), as_of, d=d)


def rolling_count(events: DataFrame, keys: Sequence[str] = ("node_id",),
                  d: Decay = DEFAULT) -> DataFrame:
    """Alerts of the device in the ``d.window`` seconds up to and including each alert."""
    return in_window(events, keys, "ts", d.window, "alert_count_window", rows=d.rows)


def most_recent_distinct(events: DataFrame, item: Column, k: int = 5,
                         name: str = "items") -> DataFrame:
    """Per device the ``k`` most recently seen distinct values, newest first."""
    seen = (events.select("node_id", item.alias("_i"), F.struct("ts", "event_id").alias("_o"))
            .filter(F.col("_i").isNotNull())
            .groupBy("node_id", "_i").agg(F.max("_o").alias("_o")))
    w = Window.partitionBy("node_id").orderBy(F.desc("_o"))
    top = seen.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    pairs = F.array_sort(F.collect_list(F.struct("_r", "_i")))     # at most k per device
    return top.groupBy("node_id").agg(F.transform(pairs, lambda p: p["_i"]).alias(name))


def recent_context(attributed: DataFrame, k: int = 5) -> DataFrame:
    """Top peers (device when known, else far address) and ports per device."""
    peers = most_recent_distinct(
        attributed, F.nullif(F.coalesce("peer_node_id", "dst_ip"), F.lit("")), k, "top_peers")
    ports = most_recent_distinct(
        attributed, F.nullif(F.col("dst_port"), F.lit(0)), k, "top_ports")
    return peers.join(ports, "node_id", "full")


def severity_changes(timeline: DataFrame, step: float, d: Decay = DEFAULT) -> DataFrame:
    """What a sweep every ``step`` seconds reports: a device whose severity differs from
    the one it last had. An alert is only followed until it has faded out or the next
    one arrives, so the number of ticks per alert is bounded by the decay itself."""
    lifetime = F.lit(d.dwell) + F.lit(d.half_life) * F.log2(F.col("score") / CLEAR_BELOW)
    gone = F.col("ts") + F.greatest(lifetime, F.lit(d.dwell)) + F.lit(2 * step)
    end = F.least(F.coalesce(F.col("next_ts"), gone), gone)
    first = F.ceil(F.col("ts") / step)
    last = F.ceil(end / step) - 1                      # a tick at the next alert is its own
    ticks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    swept = (timeline.filter(F.col("score") > 0).withColumn("_k", F.explode(ticks))
             .withColumn("tick", F.col("_k") * F.lit(float(step))))
    now = d.severity_at(F.col("score"), F.col("tick") - F.col("ts"))
    earlier = F.col("tick") - F.lit(float(step))
    before = F.when(earlier >= F.col("ts"),
                    d.severity_at(F.col("score"), earlier - F.col("ts"))
                    ).otherwise(severity_of(F.col("score")))
    return (swept.withColumns({"severity": now, "before": before})
            .filter(F.col("severity") != F.col("before"))
            .select("tick", "node_id", "severity", "before"))
