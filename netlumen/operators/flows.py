"""Packets to connection records.

A conversation is cut where the previous packet carried RST, where the gap to it
reaches the idle timeout, where both sides have sent FIN since the cut, and by the
first packet ``active_timeout`` seconds after the cut; the closing packet belongs
to the segment it closes. Idle and RST cuts do not depend on earlier cuts, so they
split a conversation into independent runs with one scan. The other two rules are
greedy: they are followed inside a run only, segment by segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlumen.functions import net
from netlumen.operators.scan import BEFORE, UP_TO, global_rank, ranges, running
from netlumen.schemas import CONNECTION_FIELDS, LABEL_UNKNOWN
from netlumen.session import materialize


@dataclass(frozen=True)
class Timeouts:
    idle: float = 15.0
    active: float = 120.0
    rows: int | None = None          # of packets a task scans; None: as all scans
    size_bin: int = 64


DEFAULT = Timeouts()


def keyed(packets: DataFrame) -> DataFrame:
    """Adds the bidirectional flow key and whether the packet left its smaller end."""
    ends = [F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")]
    return packets.withColumns({
        "flow_key": net.flow_key(*ends, F.col("protocol")),
        "from_low": net.source_is_low_end(*ends)})


def runs(packets: DataFrame, t: Timeouts = DEFAULT) -> DataFrame:
    """Adds ``gap`` to the previous packet of the conversation, ``reset`` and ``run``."""
    base = ranges(keyed(packets), ["flow_key"], ["ts", "event_id"], t.rows)
    w = Window.partitionBy("flow_key", "_slice").orderBy("ts", "event_id")
    rst = net.has_flag(F.col("tcp_flags"), net.RST)

    def resets(gap: Column, after_rst: Column) -> Column:
        return ((gap >= t.idle) | after_rst).cast("int")

    base = base.withColumns({"_pt": F.lag("ts").over(w), "_pr": F.lag(rst).over(w),
                             "_rst": rst, "_rn": F.row_number().over(w)})
    base = base.withColumn("_reset", F.coalesce(
        resets(F.col("ts") - F.col("_pt"), F.col("_pr")), F.lit(0)))
    base = base.withColumn("_runs", F.sum("_reset").over(w.rowsBetween(*UP_TO)))
    slices = base.groupBy("flow_key", "_slice").agg(
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"),
        F.max_by("_rst", "_rn").alias("_r1"), F.sum("_reset").alias("_n"))
    ws = Window.partitionBy("flow_key").orderBy("_slice")
    slices = slices.withColumns({"_before_t": F.lag("_t1").over(ws),
                                 "_before_r": F.lag("_r1").over(ws)})
    enter = F.coalesce(resets(F.col("_t0") - F.col("_before_t"), F.col("_before_r")), F.lit(1))
    slices = slices.withColumn("_enter", enter)
    slices = slices.withColumn(
        "_base", F.sum("_enter").over(ws.rowsBetween(*UP_TO))
        + F.coalesce(F.sum("_n").over(ws.rowsBetween(*BEFORE)), F.lit(0)))
    rows = base.join(slices.select("flow_key", "_slice", "_before_t", "_enter", "_base"),
                     ["flow_key", "_slice"], "left")
    first = F.col("_rn") == 1
    return rows.select(
        *packets.columns, "flow_key", "from_low",
        (F.col("ts") - F.when(first, F.col("_before_t")).otherwise(F.col("_pt"))).alias("gap"),
        F.when(first, F.col("_enter")).otherwise(F.col("_reset")).alias("reset"),
        (F.col("_base") + F.col("_runs")).alias("run"))


def closings(ts: np.ndarray, fin: np.ndarray, rst: np.ndarray | None, since: float, fins: int, t: Timeouts) -> np.ndarray:
    """Positions of the packets that close a segment, of packets in order without an idle
    gap among them. The first belongs to a segment begun at ``since`` that has seen ``fins``
    (1: the low end's, 2: the high end's).

    For every packet the closing one of a segment begun there is known from sorted look-ups,
    so only segments are walked, not packets."""
    n = len(ts)

    def next_of(hit: np.ndarray) -> np.ndarray:
        at = np.where(hit, np.arange(n), n)
        return np.append(np.minimum.accumulate(at[::-1])[::-1], n)

    low, high = next_of((fin & 1) > 0), next_of((fin & 2) > 0)
    reset = next_of(rst) if rst is not None else np.full(n + 1, n)
    out, at = [], 0
    while at < n:
        due = int(np.searchsorted(ts, since + t.active))
        # The sum may be rounded to just beside the packet that reaches the timeout.
        while due > at and ts[due - 1] - since >= t.active:
            due -= 1
        while due < n and ts[due] - since < t.active:
            due += 1
        both = max(at if fins & 1 else low[at], at if fins & 2 else high[at])
        end = int(min(max(due, at), both, reset[at]))
        if end >= n:
            break
        out.append(end)
        at, fins = end + 1, 0
        since = ts[at] if at < n else 0.0
    return np.array(out, np.int64)


def _greedy_starts(narrow: DataFrame, t: Timeouts) -> DataFrame:
    """(flow_key, event_id) of packets that open a segment inside a run, its first packet
    left out. A run streams through one task in order, a batch at a time, and what is kept
    from batch to batch is one row: its run, the open segment's start and its FINs."""
    rows = narrow.repartition("flow_key", "run").sortWithinPartitions("flow_key", "run", "ts", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, since, fins = None, 0.0, 0
        for batch in batches:
            key, run = batch.column(0), batch.column(1).to_numpy()
            if not len(run):
                continue
            ts, event, fin = (batch.column(i).to_numpy() for i in (2, 3, 4))
            place = key.dictionary_encode().indices.to_numpy()
            edge = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (place[1:] != place[:-1])))
            opened = []
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(run)]):
                now = (key[lo].as_py(), int(run[lo]))
                if now != last:
                    last, since, fins = now, float(ts[lo]), 0
                elif since is None:                      # the batch before ended with a closing packet
                    opened.append(lo)
                    since, fins = float(ts[lo]), 0
                ends = closings(ts[lo:hi], fin[lo:hi], None, since, fins, t) + lo
                starts = ends + 1
                opened += starts[starts < hi].tolist()
                if not len(ends):
                    fins |= int(np.bitwise_or.reduce(fin[lo:hi]))
                elif starts[-1] == hi:
                    since, fins = None, 0
                else:
                    since, fins = float(ts[starts[-1]]), int(np.bitwise_or.reduce(fin[starts[-1]:hi]))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(opened, pa.int64())), pa.array(event[opened] if opened else [], pa.int64())],
                                             names=["flow_key", "event_id"])

    return rows.select("flow_key", "run", "ts", "event_id", F.col("fin").cast("int")).mapInArrow(
        fold, "flow_key string, event_id long")


def segments(packets: DataFrame, t: Timeouts = DEFAULT) -> DataFrame:
    """Packets with ``segment`` (1, 2, ... per conversation), ``gap`` (NULL on the first
    packet of a segment) and ``flow_id``, named after the conversation and that packet."""
    cut = materialize(runs(packets, t), "packet-runs")
    fin = F.when(net.has_flag(F.col("tcp_flags"), net.FIN),
                 F.when(F.col("from_low"), F.lit(1)).otherwise(F.lit(2))).otherwise(F.lit(0))
    narrow = cut.select("flow_key", "run", "ts", "event_id", fin.alias("fin"))
    # Only runs that can hold a greedy cut are followed.
    facts = narrow.groupBy("flow_key", "run").agg(
        (F.max("ts") - F.min("ts")).alias("_span"), F.bit_or("fin").alias("_fins"))
    open_ended = facts.filter((F.col("_span") >= t.active) | (F.col("_fins") == 3)).select("flow_key", "run")
    starts = _greedy_starts(narrow.join(open_ended, ["flow_key", "run"], "left_semi"), t)
    opened = cut.join(starts.withColumn("_open", F.lit(1)), ["flow_key", "event_id"], "left")
    opened = opened.withColumn("_start", F.greatest("reset", F.coalesce("_open", F.lit(0))))
    first = F.when(F.col("_start") == 1, F.struct("ts", "event_id"))
    numbered = running(opened, ["flow_key"], ["ts", "event_id"], rows=t.rows,
                       sums={"segment": F.col("_start")}, maxes={"_first": first})
    key = F.substring(F.sha2("flow_key", 256), 1, 12)
    return numbered.select(
        *packets.columns, "flow_key", "from_low",
        F.when(F.col("_start") == 0, F.col("gap")).alias("gap"), "segment",
        F.concat_ws("-", F.lit("c"), key, F.col("_first.event_id").cast("string")).alias("flow_id"))


def size_entropy(segmented: DataFrame, t: Timeouts = DEFAULT) -> DataFrame:
    """Shannon entropy (bits) of packet-size bins per flow."""
    size_bin = F.floor(F.least(F.greatest(F.col("length"), F.lit(0)), F.lit(65535)) / t.size_bin)
    bins = segmented.groupBy("flow_id", size_bin.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    n, weighted = F.sum("_c"), F.sum(F.col("_c") * F.log2("_c"))
    # -sum p log2 p with p = c/n, rearranged so that one aggregation is enough.
    return bins.groupBy("flow_id").agg(
        F.greatest(F.log2(n) - weighted / n, F.lit(0.0)).alias("payload_entropy"))


def flow_records(segmented: DataFrame, t: Timeouts = DEFAULT) -> DataFrame:
    """One connection record per segment, in the fixed 33-column layout."""
    order = F.struct("ts", "event_id")
    low, flags, size = F.col("from_low"), F.col("tcp_flags"), F.col("length").cast("double")

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("int")).cast("double")

    ends = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    opener = F.min(F.struct(order.alias("at"), *ends, "from_low"))
    facts = segmented.groupBy("flow_id").agg(
        *[opener[c].alias(c) for c in ends], opener["from_low"].alias("_low_first"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("emit_ts"),
        F.sum(F.when(low, size).otherwise(0.0)).alias("_bytes_low"),
        F.sum(F.when(~low, size).otherwise(0.0)).alias("_bytes_high"),
        count(low).alias("_pkts_low"), count(~low).alias("_pkts_high"),
        *[count(net.has_flag(flags, bit)).alias(f"{name}_count") for name, bit in (
            ("syn", net.SYN), ("ack", net.ACK), ("fin", net.FIN), ("rst", net.RST),
            ("psh", net.PSH), ("urg", net.URG))],
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("iat_mean"),
        F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("iat_std"),
        F.coalesce(F.min("gap"), F.lit(0.0)).alias("iat_min"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("iat_max"),
        F.avg(size).alias("pkt_size_mean"), F.stddev_pop(size).alias("pkt_size_std"),
        F.min(size).alias("pkt_size_min"), F.max(size).alias("pkt_size_max"),
        F.max(F.col("tls_sni_len").cast("double")).alias("tls_sni_len"),
        count(F.col("is_http_request")).alias("http_req_count"))
    initiated_low = F.col("_low_first")

    def side(what: str, orig: bool) -> Column:
        pick = initiated_low if orig else ~initiated_low
        return F.when(pick, F.col(f"_{what}_low")).otherwise(F.col(f"_{what}_high"))

    records = facts.join(size_entropy(segmented, t), "flow_id").withColumns({
        "orig_bytes": side("bytes", True), "resp_bytes": side("bytes", False),
        "orig_pkts": side("pkts", True), "resp_pkts": side("pkts", False),
        "duration": F.greatest(F.col("emit_ts") - F.col("start_ts"), F.lit(0.0)),
        "tls_present": F.when(F.col("tls_sni_len") > 0, 1.0).otherwise(0.0),
        "http_present": F.when(F.col("http_req_count") > 0, 1.0).otherwise(0.0),
        "label": F.lit(LABEL_UNKNOWN),
        **{c: F.col(c).cast("double") for c in ("src_port", "dst_port", "protocol")}})
    return records.select(*CONNECTION_FIELDS)


def close_reasons(segmented: DataFrame, as_of: Column | None = None,
                  t: Timeouts = DEFAULT) -> DataFrame:
    """Why each flow ended: closed, active, idle, or still open at ``as_of``."""
    flags = F.col("tcp_flags")
    fin = F.when(net.has_flag(flags, net.FIN),
                 F.when(F.col("from_low"), F.lit(1)).otherwise(F.lit(2))).otherwise(F.lit(0))
    facts = segmented.groupBy("flow_id").agg(
        F.max(net.has_flag(flags, net.RST)).alias("rst"), F.bit_or(fin).alias("fins"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    idle = F.col("as_of") - F.col("t1") >= t.idle if as_of is not None else F.lit(True)
    if as_of is not None:
        facts = facts.withColumn("as_of", as_of)
    reason = (F.when(F.col("rst") | (F.col("fins") == 3), "closed")
              .when(F.col("t1") - F.col("t0") >= t.active, "active")
              .when(idle, "idle").otherwise("open"))
    return facts.select("flow_id", "t0", "t1", reason.alias("reason"))


def expiry_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("flows"))


def evicted(open_flows: DataFrame, max_flows: int, last_seen: str = "t1") -> DataFrame:
    """Flows a table capped at ``max_flows`` would drop: the longest unseen ones."""
    ranked = global_rank(open_flows, [F.desc(last_seen), "flow_id"])
    return ranked.filter(F.col("rn") > max_flows).drop("rn")


def _crowded(records: DataFrame, rows: int) -> Column | None:
    """Whether a record is of a flow with ``rows`` records or more; None if there is no such flow.
    One pass over the ids with a sketch of the commonest, which misses none above a 2,000th of all."""
    found = records.agg(F.expr("approx_top_k(flow_id, 1000, 10000)").alias("top"),
                        F.count_if(F.col("flow_id").isNull()).alias("nameless")).first()
    ids = [t["item"] for t in found["top"] if t["item"] is not None and t["count"] >= rows]
    if not ids and found["nameless"] < rows:
        return None
    return F.col("flow_id").isNull() | F.col("flow_id").isin(ids)


def merge_partials(records: DataFrame, order: list[str],
                   extra_keys: list[Column] | None = None, crowd: int = 1_000_000) -> DataFrame:
    """One record per flow_id. Counters add, extremes widen, means are weighted by
    packets; identity comes from the first record, the label from the last known one.
    ``order`` must order the partial records of a flow.

    Structs are aggregated in sorted order. Most flows have few records, so a merge before the
    shuffle would sort every input split for nothing: records are shuffled as they are and
    sorted once. Only flows of ``crowd`` records or more are merged on both sides of the shuffle."""
    if records.isStreaming or extra_keys:
        return _merged(records, order, extra_keys)
    crowded = _crowded(records, crowd)
    if crowded is None:
        return _merged(records.repartition("flow_id"), order)
    return _merged(records.filter(~crowded).repartition("flow_id"), order).unionByName(
        _merged(records.filter(crowded), order))


def _merged(records: DataFrame, order: list[str], extra_keys: list[Column] | None = None) -> DataFrame:
    pkts = F.col("orig_pkts") + F.col("resp_pkts")
    at = F.struct(*order)
    sums = ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "syn_count",
            "ack_count", "fin_count", "rst_count", "psh_count", "urg_count", "http_req_count")
    maxes = ("emit_ts", "iat_max", "pkt_size_max", "tls_sni_len", "payload_entropy",
             "tls_present", "http_present")
    mins = ("start_ts", "iat_min", "pkt_size_min")
    firsts = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    means = ("iat_mean", "iat_std", "pkt_size_mean", "pkt_size_std")
    # One struct per end of the order instead of one buffer per column.
    first = F.min(F.struct(at.alias("at"), *firsts, *means))
    last_known = F.max(F.when(F.col("label") != LABEL_UNKNOWN, F.struct(at.alias("at"), "label")))
    weight = F.sum(pkts)
    out = {
        **{c: F.sum(c) for c in sums}, **{c: F.max(c) for c in maxes},
        **{c: F.min(c) for c in mins}, **{c: first[c] for c in firsts},
        **{c: F.when(weight > 0, F.sum(F.col(c) * pkts) / F.nullif(weight, F.lit(0.0)))
           .otherwise(first[c]) for c in means},
        "label": F.coalesce(last_known["label"], F.lit(LABEL_UNKNOWN)),
    }
    return records.groupBy("flow_id", *(extra_keys or [])).agg(*[c.alias(n) for n, c in out.items()]).select(
        *CONNECTION_FIELDS)
