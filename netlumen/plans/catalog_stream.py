"""Streaming jobs worked off over the given tables, held to their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with, spark_view
from netlumen.functions.features import linear_score
from netlumen.operators import rollups
from netlumen.plans import inputs
from netlumen.plans.catalog_flows import MERGE_ORDER, SCORER, SCORER_BIAS, SCORER_THRESHOLD, _FACTS, _Z, walk_sql
from netlumen.plans.catalog_state import _ACK_SQL, attr_sql
from netlumen.plans.registry import Registry, decay_ctes, r6, severity_sql, sql6
from netlumen.streaming import jobs, stateful

reg = Registry()


def stream_view(spark, sf, name):
    """A fixture view over the given table read as a stream."""
    return spark_view(spark, sf, name,
                      read=lambda table: jobs.file_stream(spark, f"{sf}/{table}.parquet"))


_DONE = """done AS (SELECT f.*, CASE WHEN rst OR fins = 3 THEN 'closed' WHEN t1 - t0 >= 120e0 THEN 'active' ELSE 'idle' END AS reason FROM facts f)"""


@reg.query("stream_flow_assembly", walk_sql(
    f"""SELECT d.flow_id, d.reason, {sql6('d.t0')} AS start_ts, {sql6('d.t1 - d.t0')} AS duration, CAST(count(*) AS DOUBLE) AS pkts,
 CAST(sum(length) AS DOUBLE) AS bytes, CAST(sum(CASE WHEN (tcp_flags & 16) <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS ack_count, {sql6('coalesce(max(gap), 0e0)')} AS iat_max
 FROM done d JOIN seg s ON s.flow_id = d.flow_id GROUP BY d.flow_id, d.reason, d.t0, d.t1""", _FACTS, _DONE))
def stream_flow_assembly(spark, sf):
    """All flows of the table: what is still open at the end comes out as idle."""
    out = jobs.run_bounded(stream_view(spark, sf, "fx_packets"), "ts",
                           lambda packets: stateful.assemble_flows(packets, "0 seconds"), "flows")
    return out.select(
        "flow_id", "reason", r6("start_ts").alias("start_ts"), r6("duration").alias("duration"),
        (F.col("orig_pkts") + F.col("resp_pkts")).alias("pkts"),
        (F.col("orig_bytes") + F.col("resp_bytes")).alias("bytes"), "ack_count",
        r6("iat_max").alias("iat_max"))


# Live state as SQL. An episode of a device ends when an acknowledgement comes or when its
# score has cooled off; timers run in whole milliseconds.
_GONE = "floor((ts + 30e0 + CASE WHEN s > {b} THEN 120e0 * log2(s / {b}) ELSE 0e0 END) * 1000) + 1"
_LIVE_SQL = attr_sql(
    f"""SELECT node_id, 'alert' AS cause, flow_id, {sql6('ts')} AS at, {severity_sql('s')} AS severity, {sql6('s')} AS score, alert_count, alert_count_window FROM told
UNION ALL SELECT node_id, 'cooling', '', {sql6('due / 1000')}, CASE WHEN b < 0.1 THEN 'none' ELSE {severity_sql('now')} END,
 CASE WHEN b < 0.1 THEN 0e0 ELSE {sql6('now')} END, alert_count, alert_count_window FROM cooled
UNION ALL SELECT node_id, 'ack', '', {sql6('ts')}, 'none', 0e0, alert_count, alert_count_window FROM acked""",
    _ACK_SQL,
    "both_ AS (SELECT event_id, flow_id, node_id, ts, score, 0 AS ack FROM ev UNION ALL SELECT NULL, NULL, node_id, ts, NULL, 1 FROM acks)",
    """numbered AS (SELECT *, CAST(sum(ack) OVER o AS BIGINT) AS epoch, lead(ts) OVER o AS nxt, row_number() OVER o AS place FROM both_
 WINDOW o AS (PARTITION BY node_id ORDER BY ts, ack DESC, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING))""",
    "live_ev AS (SELECT * FROM numbered WHERE ack = 0)",
    *decay_ctes("live_ev", key="node_id, epoch"),
    f"gone AS (SELECT *, {_GONE.format(b='0.05e0')} AS clear FROM line)",
    """fresh AS (SELECT *, CASE WHEN n = 1 OR lag(clear) OVER (PARTITION BY node_id, epoch ORDER BY ts, event_id) <= ts * 1000 THEN 1 ELSE 0 END AS opens FROM gone)""",
    "eps AS (SELECT *, sum(opens) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM fresh)",
    """told AS (SELECT *, row_number() OVER (PARTITION BY node_id, ep ORDER BY ts, event_id) AS alert_count,
 count(*) OVER (PARTITION BY node_id, ep ORDER BY ts RANGE BETWEEN 300e0 PRECEDING AND CURRENT ROW)
 - count(*) OVER (PARTITION BY node_id, ep, ts) + row_number() OVER (PARTITION BY node_id, ep, ts ORDER BY event_id) AS alert_count_window FROM eps)""",
    f"falls AS (SELECT *, {_GONE.format(b='b')} AS due FROM told JOIN (VALUES (0.95e0), (0.8e0), (0.55e0), (0.3e0), (0.05e0)) v(b) ON b <= s)",
    "cooled AS (SELECT *, s * pow(0.5e0, (due / 1000 - ts - 30e0) / 120e0) AS now FROM falls WHERE nxt IS NULL OR due <= nxt * 1000)",
    """acked AS (SELECT a.node_id, a.ts, t.alert_count, t.alert_count_window FROM numbered a
 JOIN told t ON t.node_id = a.node_id AND t.place = a.place - 1 WHERE a.ack = 1 AND t.clear > a.ts * 1000)""")


@reg.query("stream_node_states", _LIVE_SQL)
def stream_node_states(spark, sf):
    """Alerts enriched per micro-batch and folded into keyed state, together with
    acknowledgements: every change of state until all devices have cooled off."""
    path = jobs.scratch_path(spark, "attributed")
    alerts = stream_view(spark, sf, "fx_alerts")
    sink = jobs.enrich_sink(lambda: inputs.nodes(spark, sf), path)
    jobs.start(alerts, sink, jobs.scratch_path(spark, "enrich-checkpoint")).awaitTermination()
    known = jobs.file_stream(spark, path).filter(F.col("node_id").isNotNull()).withColumn("ts", F.col("detected_at"))
    firing = known.filter(F.col("score") >= F.col("threshold")).withColumn("is_ack", F.lit(False))
    acks = known.filter(F.col("event_type") == "purchase").withColumn("is_ack", F.lit(True))
    out = jobs.run_bounded(firing.unionByName(acks), "ts", lambda rows: stateful.live_states(rows, "0 seconds"), "states")
    return out.select("node_id", "cause", "flow_id", r6("at").alias("at"), "severity", r6("score").alias("score"),
                      "alert_count", "alert_count_window")


@reg.query("stream_merge", duck_with("fx_connections", """o AS (SELECT *, CASE WHEN start_ts - lag(start_ts) OVER w <= 86400 THEN 0 ELSE 1 END AS cut FROM fx_connections
 WINDOW w AS (PARTITION BY flow_id ORDER BY start_ts))""", "s AS (SELECT *, sum(cut) OVER (PARTITION BY flow_id ORDER BY start_ts ROWS UNBOUNDED PRECEDING) AS sess FROM o)",
    "m AS (SELECT flow_id, sum(orig_bytes) AS orig_bytes, max(tls_sni_len) AS tls_sni_len, sum(duration) AS duration FROM s GROUP BY flow_id, sess)") +
    f"SELECT flow_id, {sql6('orig_bytes')} AS orig_bytes, tls_sni_len, {sql6('duration')} AS duration FROM m")
def stream_merge(spark, sf):
    """Partial records at most a day apart, all sessions of the table."""
    # Chosen inside the job, so that shuffle, state and sink hold these columns only.
    merged = jobs.run_bounded(
        stream_view(spark, sf, "fx_connections"), "start_ts",
        lambda records: jobs.merge_stream(records, MERGE_ORDER, "0 seconds", gap="86400 seconds").select(
            "flow_id", "orig_bytes", "tls_sni_len", "duration"), "merged")
    return merged.select("flow_id", r6("orig_bytes").alias("orig_bytes"), "tls_sni_len", r6("duration").alias("duration"))


@reg.query("stream_counts", duck_with("fx_alerts") + "SELECT src_ip AS value, count(*) AS n FROM fx_alerts GROUP BY 1")
def stream_counts(spark, sf):
    """Each micro-batch writes the values that it changed; the last version counts."""
    counts = jobs.running_counts(stream_view(spark, sf, "fx_alerts"), "src_ip")
    out = jobs.run_to_table(counts, "counts", "update")
    return rollups.latest_per(out, "value", ["batch"]).select("value", "n")


@reg.query("stream_minute_windows", duck_with("fx_alerts") + "SELECT floor(detected_at / 60) * 60e0 AS from_s, count(*) AS n FROM fx_alerts GROUP BY 1")
def stream_minute_windows(spark, sf):
    return jobs.run_bounded(stream_view(spark, sf, "fx_alerts"), "detected_at",
                            lambda alerts: jobs.window_counts(alerts, "0 seconds"), "windows")


@reg.query("stream_sliding_windows", duck_with("fx_alerts") + """SELECT from_s, count(*) AS n FROM (SELECT unnest([floor(detected_at / 20) * 20e0, floor(detected_at / 20) * 20e0 - 20, floor(detected_at / 20) * 20e0 - 40]) AS from_s FROM fx_alerts)
 GROUP BY 1""")
def stream_sliding_windows(spark, sf):
    return jobs.run_bounded(stream_view(spark, sf, "fx_alerts"), "detected_at", lambda alerts: jobs.window_counts(
        alerts, "0 seconds", "60 seconds", "20 seconds"), "sliding")


@reg.query("stream_idle_sessions", duck_with("fx_packets", """k AS (SELECT *, concat_ws('|', least(src_ip, dst_ip), src_port + dst_port, protocol) AS fk FROM fx_packets)""",
    "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 15 THEN 0 ELSE 1 END AS cut FROM k WINDOW w AS (PARTITION BY fk ORDER BY ts, event_id))",
    "s AS (SELECT *, sum(cut) OVER (PARTITION BY fk ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM g)") +
    f"SELECT count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, {sql6('min(ts)')} AS start_ts FROM s GROUP BY fk, sess")
def stream_idle_sessions(spark, sf):
    out = jobs.run_bounded(stream_view(spark, sf, "fx_packets"), "ts",
                           lambda packets: jobs.idle_sessions(packets, "0 seconds"), "sessions")
    return out.select("packets", "bytes", r6("start_ts").alias("start_ts"))


@reg.query("stream_deduplicated", duck_with("fx_alerts") + "SELECT DISTINCT flow_id FROM fx_alerts")
def stream_deduplicated(spark, sf):
    """The same alerts delivered twice come out once."""
    alerts = stream_view(spark, sf, "fx_alerts")
    return jobs.run_to_table(jobs.deduplicated(alerts.unionByName(
        stream_view(spark, sf, "fx_alerts")), "10 minutes").select("flow_id"), "once")


# Deliveries out of order: a third of the day each, then every seventh event of all times.
_DELIVERY = "CASE WHEN event_id % 7 = 0 THEN 3 ELSE least(CAST(floor(detected_at / 14400) AS INT), 2) END"
_LATENESS = 21600


@reg.query("stream_late_rows", duck_with(
    "fx_alerts", f"p AS (SELECT detected_at, {_DELIVERY} AS batch FROM fx_alerts)",
    f"w AS (SELECT b.batch, max(a.detected_at) - {_LATENESS} AS watermark FROM (SELECT DISTINCT batch FROM p) b LEFT JOIN p a ON a.batch < b.batch GROUP BY 1)") +
    f"""SELECT CAST(p.batch AS BIGINT) AS batch, count(*) AS rows, count(*) FILTER (detected_at < watermark) AS late, {sql6('any_value(watermark)')} AS watermark
 FROM p JOIN w ON w.batch = p.batch GROUP BY p.batch""")
def stream_late_rows(spark, sf):
    """Rows behind the watermark are parted off and counted, batch by batch."""
    folder = jobs.scratch_path(spark, "deliveries")
    alerts = inputs.alerts(spark, sf)
    stream = jobs.file_stream(spark, f"{folder}/delivery-*", alerts.schema)
    split = jobs.LateRows(stream, "detected_at", _LATENESS, "late")
    for i in range(4):
        alerts.filter(F.expr(_DELIVERY) == i).write.parquet(f"{folder}/delivery-{i}")
        split.run()
    return split.counts().select("batch", "rows", "late", r6("watermark").alias("watermark"))


@reg.query("stream_detect", duck_with("fx_connections") + f"""SELECT flow_id, src_ip, dst_ip, CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port,
 CAST(protocol AS INTEGER) AS protocol, round(1e0 / (1e0 + exp(-({_Z}))), 4) AS score, 0.5e0 AS threshold, {sql6('2e9 - emit_ts')} AS latency_s, label
 FROM fx_connections WHERE {_Z} >= 0""")
def stream_detect(spark, sf):
    """Connections to features to scores to alerts as a stream."""
    alerts = jobs.detect_stream(stream_view(spark, sf, "fx_connections"), linear_score(SCORER, SCORER_BIAS), SCORER_THRESHOLD, F.lit(2e9))
    out = jobs.run_to_table(alerts, "alerts")
    return out.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.round("score", 4).alias("score"),
                      "threshold", r6("latency_s").alias("latency_s"), "label")


@reg.query("stream_latest_per_node", attr_sql(
    "SELECT node_id, arg_max(flow_id, (ts, event_id)) AS flow_id FROM ev GROUP BY node_id"))
def stream_latest_per_node(spark, sf):
    """One trigger over the whole table: the newest alert per device of that batch."""
    path = jobs.scratch_path(spark, "latest")
    nodes = inputs.nodes(spark, sf)

    def write(batch, number):
        from netlumen.operators.correlate import attribute_alerts

        rows = attribute_alerts(batch, nodes).filter(
            (F.col("score") >= F.col("threshold")) & F.col("node_id").isNotNull())
        jobs.latest_sink(path, order=("detected_at", "event_id"))(
            rows.select("node_id", "flow_id", "detected_at", "event_id"), number)

    jobs.start(stream_view(spark, sf, "fx_alerts"), write, jobs.scratch_path(spark, "cp")).awaitTermination()
    out = spark.read.parquet(path)
    return rollups.latest_per(out, "node_id", ["batch"]).select("node_id", "flow_id")
