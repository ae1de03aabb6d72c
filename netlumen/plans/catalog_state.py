"""Attribution, severity and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with
from netlumen.functions.severity import severity_from_rank, severity_rank
from netlumen.operators import correlate, state
from netlumen.plans import inputs
from netlumen.plans.registry import (ATTRIBUTION_CTES, Registry, decay_ctes, r6, rank_sql,
                                     severity_sql, sql6, state_ctes, decayed_sql)
from netlumen.session import materialize

reg = Registry()
VIEWS = "fx_alerts fx_nodes"
AS_OF = "(SELECT max(detected_at) FROM fx_alerts)"
HALF = "(SELECT max(detected_at) / 2 FROM fx_alerts)"


def attr_sql(body: str, *ctes: str) -> str:
    return duck_with(VIEWS, *ATTRIBUTION_CTES, *ctes) + body


@reg.query("device_attribution", attr_sql(
    "SELECT flow_id, node_id, peer_node_id, correlation, severity, unresolved_ip FROM attr"))
def device_attribution(spark, sf):
    return inputs.attributed(spark, sf).select(
        "flow_id", "node_id", "peer_node_id", "correlation", "severity", "unresolved_ip")


def _prefer_sql(first: str, second: str) -> str:
    a, b = first, second
    return attr_sql(f"""SELECT flow_id, coalesce({a}n, {b}n) AS node_id,
 CASE WHEN {a}n IS NOT NULL THEN {b}n END AS peer_node_id,
 CASE WHEN {a}n IS NOT NULL THEN {a}m WHEN {b}n IS NOT NULL THEN {b}m ELSE 'unresolved' END AS correlation FROM pick""")


def _prefer(side):
    def run(spark, sf):
        out = correlate.attribute_alerts(inputs.alerts(spark, sf), inputs.nodes(spark, sf), side)
        return out.select("flow_id", "node_id", "peer_node_id", "correlation")
    return run


reg.query("attribution_prefer_source", _prefer_sql("s", "d"))(_prefer("source"))
reg.query("attribution_prefer_destination", _prefer_sql("d", "s"))(_prefer("destination"))


# Every third alert names a hardware address, every fifth an asset tag.
_HINT_SQL = attr_sql("""SELECT a.flow_id, coalesce(m.node_id, t.node_id, a.node_id) AS node_id,
 CASE WHEN m.node_id IS NULL AND t.node_id IS NULL THEN a.peer_node_id END AS peer_node_id,
 CASE WHEN m.node_id IS NOT NULL THEN 'mac' WHEN t.node_id IS NOT NULL THEN 'asset' ELSE a.correlation END AS correlation
 FROM hinted a LEFT JOIN macs m ON m.mac = a.mac LEFT JOIN tags t ON t.asset = a.asset_tag""",
    """hinted AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN concat('001b54', lpad(CAST(src_port - 49152 AS VARCHAR), 6, '0')) END AS mac,
 CASE WHEN event_id % 5 = 0 THEN concat('Customer#', lpad(CAST(src_port - 49152 AS VARCHAR), 9, '0')) END AS asset_tag FROM attr)""",
    "macs AS (SELECT mac_raw AS mac, min(id) AS node_id FROM fx_nodes GROUP BY 1)",
    "tags AS (SELECT name AS asset, min(id) AS node_id FROM fx_nodes GROUP BY 1)")


@reg.query("attribution_mac_asset", _HINT_SQL)
def attribution_mac_asset(spark, sf):
    user = (F.col("src_port") - 49152).cast("string")
    alerts = inputs.alerts(spark, sf).withColumns({
        "mac": F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("001B54-"), F.lpad(user, 6, "0"))),
        "asset_tag": F.when(F.col("event_id") % 5 == 0,
                            F.concat(F.lit("Customer#"), F.lpad(user, 9, "0")))})
    nodes = inputs.nodes(spark, sf).withColumn(
        "tags", F.array(F.concat(F.lit("asset:"), F.col("name")), F.col("team")))
    return correlate.attribute_alerts(alerts, nodes).select(
        "flow_id", "node_id", "peer_node_id", "correlation")


@reg.query("subnet_gateways", duck_with("fx_nodes", *ATTRIBUTION_CTES[1:3]) +
           "SELECT subnet, gateway_id, CAST(24 AS INTEGER) AS prefix_len FROM gw")
def subnet_gateways(spark, sf):
    return correlate.subnet_gateways(inputs.nodes(spark, sf)).select(
        "subnet", "gateway_id", "prefix_len")


@reg.query("unresolved_report", attr_sql(
    "SELECT unresolved_ip AS ip, count(*) AS alerts FROM attr WHERE node_id IS NULL GROUP BY 1"))
def unresolved_report(spark, sf):
    return correlate.unresolved_report(inputs.attributed(spark, sf))


@reg.query("correlation_stats", attr_sql("""SELECT count(DISTINCT unresolved_ip) AS unresolved_addresses,
 CAST(count(*) AS BIGINT) AS unresolved_alerts, (SELECT count(*) FROM by_ip) AS indexed_ips,
 (SELECT count(DISTINCT mac_raw) FROM fx_nodes) AS indexed_macs, (SELECT count(*) FROM gw) AS subnets
 FROM attr WHERE node_id IS NULL"""))
def correlation_stats(spark, sf):
    return correlate.correlation_stats(inputs.attributed(spark, sf), inputs.nodes(spark, sf))


_RANKED = ("SELECT node_id, severity, " + sql6("score") + " AS score, alert_count, " +
           sql6("last_alert_at") + " AS last_alert_at, last_alert_id, CAST(rank AS INTEGER) AS rank FROM live")


@reg.query("ranked_states", attr_sql(_RANKED, *decay_ctes(until=AS_OF), *state_ctes(AS_OF)))
def ranked_states(spark, sf):
    """Which devices are alerting now, and how badly."""
    states = state.state_at(inputs.stored_events(spark, sf), inputs.last_detection(spark, sf))
    return state.ranked(states).select(
        "node_id", "severity", r6("score").alias("score"), "alert_count",
        r6("last_alert_at").alias("last_alert_at"), "last_alert_id", "rank")


@reg.query("replay_at", attr_sql(
    f"SELECT node_id, severity, {sql6('score')} AS score, alert_count, {sql6('first_alert_at')} AS first_alert_at FROM live",
    *decay_ctes(until=HALF), *state_ctes(HALF)))
def replay_at(spark, sf):
    states = state.state_at(inputs.stored_events(spark, sf), inputs.last_detection(spark, sf) / 2)
    return states.select("node_id", "severity", r6("score").alias("score"), "alert_count",
                         r6("first_alert_at").alias("first_alert_at"))


@reg.query("state_timeline", attr_sql(
    f"""SELECT event_id, node_id, {sql6('s')} AS score, {severity_sql('s')} AS severity, n AS alert_count,
 count(*) OVER (PARTITION BY node_id ORDER BY ts RANGE BETWEEN 300e0 PRECEDING AND CURRENT ROW) AS alert_count_window,
 row_number() OVER (ORDER BY ts, event_id) AS seq FROM line""", *decay_ctes()))
def state_timeline(spark, sf):
    from netlumen.operators.scan import global_rank
    from netlumen.functions.severity import severity_of

    line = materialize(state.score_timeline(inputs.stored_events(spark, sf)).select(
        "event_id", "node_id", "ts", "score", "alert_count"), "score-line")
    counted = state.rolling_count(line)
    numbered = global_rank(counted, ["ts", "event_id"], "seq")
    return numbered.select("event_id", "node_id", r6("score").alias("score"),
                           severity_of(F.col("score")).alias("severity"), "alert_count",
                           "alert_count_window", "seq")


_SWEEP = 60


def _sweep_sql() -> str:
    now = decayed_sql("s", f"(k * {_SWEEP}e0 - ts)")
    before = decayed_sql("s", f"((k - 1) * {_SWEEP}e0 - ts)")
    band = lambda x: f"CASE WHEN ({x}) = 0 THEN 'none' ELSE {severity_sql('(' + x + ')')} END"
    return attr_sql(f"""SELECT k * {_SWEEP}e0 AS tick, node_id, severity, before FROM (
 SELECT node_id, k, {band(now)} AS severity, CASE WHEN (k - 1) * {_SWEEP}e0 >= ts THEN {band(before)}
 ELSE {severity_sql('s')} END AS before FROM ticks) WHERE severity <> before""",
        *decay_ctes(),
        f"""ticks AS (SELECT *, unnest(generate_series(CAST(ceil(ts / {_SWEEP}e0) AS BIGINT),
 CAST(ceil(least(coalesce(next_ts, ts + 1000e0), ts + 1000e0) / {_SWEEP}e0) AS BIGINT) - 1)) AS k FROM line)""")


@reg.query("severity_changes", _sweep_sql())
def severity_changes(spark, sf):
    line = state.score_timeline(inputs.stored_events(spark, sf))
    return state.severity_changes(line, float(_SWEEP))


# Acknowledgements: an operator clears a device whenever its user makes a purchase.
_ACK_SQL = "acks AS (SELECT node_id, ts FROM attr WHERE node_id IS NOT NULL AND event_type = 'purchase')"


def _acks(spark, sf):
    return (inputs.attributed(spark, sf)
            .filter(F.col("node_id").isNotNull() & (F.col("event_type") == "purchase"))
            .select("node_id", F.col("detected_at").alias("ts")))


@reg.query("ack_epochs", attr_sql(
    f"""SELECT event_id, node_id, epoch, {sql6('s')} AS score, n AS alert_count FROM line""",
    _ACK_SQL,
    """both_ AS (SELECT event_id, flow_id, node_id, ts, score, 0 AS ack FROM ev
 UNION ALL SELECT NULL, NULL, node_id, ts, NULL, 1 FROM acks)""",
    """numbered AS (SELECT *, CAST(sum(ack) OVER (PARTITION BY node_id ORDER BY ts, ack DESC, event_id NULLS FIRST
 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM both_)""",
    "live_ev AS (SELECT * FROM numbered WHERE ack = 0)",
    *decay_ctes("live_ev", key="node_id, epoch")))
def ack_epochs(spark, sf):
    numbered = state.with_epoch(inputs.stored_events(spark, sf), _acks(spark, sf))
    numbered = materialize(numbered, "epochs")
    line = state.score_timeline(numbered, ("node_id", "epoch"))
    return line.select("event_id", "node_id", "epoch", r6("score").alias("score"), "alert_count")


@reg.query("states_after_acks", attr_sql(
    f"SELECT node_id, severity, {sql6('score')} AS score, alert_count FROM live",
    _ACK_SQL, "cleared AS (SELECT node_id, max(ts) AS at FROM acks GROUP BY 1)",
    "kept AS (SELECT e.* FROM ev e LEFT JOIN cleared c ON c.node_id = e.node_id WHERE c.at IS NULL OR e.ts >= c.at)",
    *decay_ctes("kept"), *state_ctes(AS_OF)))
def states_after_acks(spark, sf):
    events = inputs.state_events(spark, sf).select("event_id", "flow_id", "node_id", "ts", "score")
    states = state.state_after_acks(events, _acks(spark, sf), inputs.last_detection(spark, sf))
    return states.select("node_id", "severity", r6("score").alias("score"), "alert_count")


@reg.query("recent_peers_ports", attr_sql(
    """SELECT coalesce(p.node_id, q.node_id) AS node_id, p.top_peers, q.top_ports FROM
 (SELECT node_id, string_agg(i, ',' ORDER BY o DESC) AS top_peers FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY o DESC) AS r
   FROM (SELECT node_id, coalesce(peer_node_id, dst_ip) AS i, max(event_id) AS o FROM ev GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1) p
 FULL JOIN (SELECT node_id, string_agg(i, ',' ORDER BY o DESC) AS top_ports FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY o DESC) AS r
   FROM (SELECT node_id, CAST(dst_port AS VARCHAR) AS i, max(event_id) AS o FROM ev GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1) q
 ON p.node_id = q.node_id"""))
def recent_peers_ports(spark, sf):
    context = state.recent_context(inputs.state_events(spark, sf))
    return context.select("node_id", F.array_join("top_peers", ",").alias("top_peers"),
                          F.array_join(F.col("top_ports").cast("array<string>"), ",").alias("top_ports"))


@reg.query("node_alert_bounds", attr_sql(
    f"""SELECT node_id, {sql6('min(ts)')} AS first_alert_at, {sql6('max(ts)')} AS last_alert_at,
 arg_max(flow_id, event_id) AS last_alert_id, count(*) AS alert_count FROM ev GROUP BY node_id"""))
def node_alert_bounds(spark, sf):
    return inputs.state_events(spark, sf).groupBy("node_id").agg(
        r6(F.min("ts")).alias("first_alert_at"), r6(F.max("ts")).alias("last_alert_at"),
        F.max_by("flow_id", F.struct("ts", "event_id")).alias("last_alert_id"),
        F.count(F.lit(1)).alias("alert_count"))


@reg.query("severity_histogram", attr_sql(
    """SELECT severity, count(*) AS devices FROM live GROUP BY severity""",
    *decay_ctes(until=AS_OF), *state_ctes(AS_OF)))
def severity_histogram(spark, sf):
    states = state.state_at(inputs.stored_events(spark, sf), inputs.last_detection(spark, sf))
    return states.groupBy("severity").agg(F.count(F.lit(1)).alias("devices"))


@reg.query("threat_level", attr_sql(
    """SELECT CASE coalesce(max(rank), 0) WHEN 0 THEN 'none' WHEN 1 THEN 'info' WHEN 2 THEN 'low' WHEN 3 THEN 'medium'
 WHEN 4 THEN 'high' ELSE 'critical' END AS threat, count(*) AS alerting,
 (SELECT count(*) FROM fx_nodes) AS coverage, (SELECT count(*) FROM fx_nodes) - count(*) AS quiet FROM live""",
    *decay_ctes(until=AS_OF), *state_ctes(AS_OF)))
def threat_level(spark, sf):
    states = state.state_at(inputs.stored_events(spark, sf), inputs.last_detection(spark, sf))
    coverage = inputs.nodes(spark, sf).agg(F.count(F.lit(1))).scalar()
    top = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    return (states.agg(severity_from_rank(top).alias("threat"), F.count(F.lit(1)).alias("alerting"))
            .withColumn("coverage", coverage)
            .withColumn("quiet", F.col("coverage") - F.col("alerting")))


@reg.query("animated_tier", attr_sql(
    "SELECT node_id, severity FROM live WHERE rank = (SELECT max(rank) FROM live) ORDER BY last_alert_at DESC, node_id LIMIT 6",
    *decay_ctes(until=AS_OF), *state_ctes(AS_OF)))
def animated_tier(spark, sf):
    """At most six devices may be animated: the most recent of the worst tier."""
    states = state.state_at(inputs.stored_events(spark, sf), inputs.last_detection(spark, sf))
    # The order puts the worst tier first, so six rows are enough to know the top rank.
    top = state.ranked(states, 6)
    worst = top.agg(F.max("rank")).scalar()
    return top.filter(F.col("rank") == worst).select("node_id", "severity")


@reg.query("severity_bands", duck_with("fx_alerts") +
           f"""SELECT severity, CAST({rank_sql('severity')} AS INTEGER) AS rank, count(*) AS alerts FROM
 (SELECT {severity_sql('score')} AS severity FROM fx_alerts WHERE score >= threshold) GROUP BY 1""")
def severity_bands(spark, sf):
    from netlumen.functions.severity import severity_of

    flagged = inputs.alerts(spark, sf).filter(F.col("score") >= F.col("threshold"))
    return (flagged.groupBy(severity_of(F.col("score")).alias("severity"))
            .agg(F.count(F.lit(1)).alias("alerts"))
            .withColumn("rank", severity_rank(F.col("severity"))))
