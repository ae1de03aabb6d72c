"""Roll-ups, series, searches and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with
from netlumen.functions.severity import alert_summary, node_label
from netlumen.operators import rollups, state, views
from netlumen.plans import inputs
from netlumen.plans.catalog_state import AS_OF, VIEWS, attr_sql
from netlumen.plans.registry import (ATTRIBUTION_CTES, Registry, decay_ctes, r6, rank_sql,
                                     severity_sql, sql6, state_ctes)

reg = Registry()
MAC_SQL = "regexp_replace(mac_raw, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"
VENDOR_SQL = "CASE substr(mac_raw, 1, 6) WHEN '001b54' THEN 'Cisco' WHEN '00000c' THEN 'Cisco' ELSE 'unknown' END"
_NODES = f"nd AS (SELECT *, {MAC_SQL} AS mac, {VENDOR_SQL} AS vendor FROM fx_nodes)"
_NS = ("ns AS (SELECT nd.*, coalesce(l.severity, 'none') AS severity, coalesce(l.rank, 0) AS rank, l.score, l.alert_count, "
       "l.last_alert_at FROM nd LEFT JOIN live l ON l.node_id = nd.id)")
_LIVE = (*decay_ctes(until=AS_OF), *state_ctes(AS_OF))


def nodes(spark, sf):
    from netlumen.sources.oui import with_vendor

    return with_vendor(inputs.nodes(spark, sf))


def states(spark, sf):
    return state.state_at(inputs.state_events(spark, sf), inputs.last_detection(spark, sf))


def located(spark, sf):
    return views.with_state(nodes(spark, sf), states(spark, sf))


def state_sql(body: str, *ctes: str) -> str:
    return attr_sql(body, *_LIVE, _NODES, _NS, *ctes)


def _top(col: str, dim: str) -> str:
    return f"""SELECT '{dim}' AS dim, CAST({col} AS VARCHAR) AS value, n, CAST(row_number() OVER (ORDER BY n DESC, seen) AS INTEGER) AS rk,
 CAST(NULL AS DOUBLE) AS mean_score FROM (SELECT {col}, count(*) AS n, min(event_id) AS seen FROM fx_alerts GROUP BY 1)"""


@reg.query("alert_rollup", duck_with("fx_alerts") + f"""SELECT * FROM ({_top('src_ip', 'src_ip')}) WHERE rk <= 10 UNION ALL
 SELECT * FROM ({_top('dst_port', 'dst_port')}) WHERE rk <= 10 UNION ALL
 SELECT 'total', NULL, count(*), 1, {sql6('avg(score)')} FROM fx_alerts""")
def alert_rollup(spark, sf):
    out = rollups.alert_rollup(inputs.alerts(spark, sf))
    return out.withColumn("mean_score", r6("mean_score"))


@reg.query("alert_rate", duck_with("fx_alerts") + f"""SELECT count(*) AS alerts, {sql6('count(*) / 60e0')} AS rate_per_s FROM fx_alerts
 WHERE {AS_OF} - detected_at <= 60""")
def alert_rate(spark, sf):
    out = rollups.recent_rate(inputs.alerts(spark, sf), inputs.last_detection(spark, sf))
    return out.withColumn("rate_per_s", r6("rate_per_s"))


@reg.query("facets", duck_with("fx_nodes", _NODES) + """SELECT 'subnet' AS dim, subnet AS value, count(*) AS n FROM nd GROUP BY subnet
 UNION ALL SELECT 'vendor', vendor, count(*) FROM nd GROUP BY vendor UNION ALL SELECT 'device_type', device_type, count(*) FROM nd GROUP BY device_type""")
def facets(spark, sf):
    return rollups.facets(nodes(spark, sf))


@reg.query("timeline_density", attr_sql(f"""SELECT b.bucket, coalesce(n, 0) AS n, CASE coalesce(w, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'info' WHEN 2 THEN 'low'
 WHEN 3 THEN 'medium' WHEN 4 THEN 'high' ELSE 'critical' END AS worst, {sql6('coalesce(n, 0) / greatest(max(n) OVER (), 1)')} AS height
 FROM (SELECT unnest(generate_series(0, 89)) AS bucket) b LEFT JOIN (SELECT CAST(least(floor((ts - a) / greatest(z - a, 1e0) * 90), 89) AS BIGINT) AS bucket, count(*) AS n,
 max({rank_sql('severity')}) AS w FROM ev, (SELECT min(ts) AS a, max(ts) AS z FROM ev) GROUP BY 1) c ON c.bucket = b.bucket"""))
def timeline_density(spark, sf):
    out = rollups.timeline_density(inputs.state_events(spark, sf))
    return out.withColumn("height", r6("height"))


def _series(spark, sf):
    return inputs.alerts(spark, sf).select("event_id", F.col("detected_at").alias("ts"), "score")


@reg.query("sliding_rate", duck_with("fx_alerts") + f"""SELECT event_id, {sql6('count(*) OVER w / greatest(detected_at - min(detected_at) OVER w, 1e-6)')} AS rate
 FROM fx_alerts WINDOW w AS (ORDER BY detected_at RANGE BETWEEN 5e0 PRECEDING AND CURRENT ROW)""")
def sliding_rate(spark, sf):
    return rollups.sliding_rate(_series(spark, sf)).select("event_id", r6("rate").alias("rate"))


@reg.query("alert_rate_per_minute", duck_with("fx_alerts") + """SELECT event_id, CASE WHEN elapsed >= 4 THEN CAST(floor(gained / elapsed * 60 + 0.5e0) AS BIGINT) END AS per_minute FROM (
 SELECT event_id, CASE WHEN k <= 1 THEN 1 ELSE k - 1 END AS gained, detected_at - CASE WHEN k <= 1 THEN prev ELSE first END AS elapsed FROM (
 SELECT event_id, detected_at, lag(detected_at) OVER (ORDER BY detected_at, event_id) AS prev, count(*) OVER w AS k, min(detected_at) OVER w AS first
 FROM fx_alerts WINDOW w AS (ORDER BY detected_at RANGE BETWEEN 15e0 PRECEDING AND CURRENT ROW)))""")
def alert_rate_per_minute(spark, sf):
    return rollups.alert_rate_per_minute(_series(spark, sf)).select("event_id", "per_minute")


@reg.query("history_series", duck_with("fx_alerts", f"z AS (SELECT CAST(floor({AS_OF} / 1.5e0) AS BIGINT) AS k)") +
           """SELECT i, tick * 1.5e0 AS at, coalesce((SELECT arg_max(score, (detected_at, event_id)) FROM fx_alerts WHERE detected_at <= tick * 1.5e0), 0e0) AS value
 FROM (SELECT i, k - 39 + i AS tick FROM z, (SELECT unnest(generate_series(0, 39)) AS i))""")
def history_series(spark, sf):
    return rollups.resample_last(_series(spark, sf), "ts", "score", inputs.last_detection(spark, sf))


@reg.query("sparkline", f"""SELECT event_id, {sql6('(value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END')} AS scaled FROM events,
 (SELECT least(min(value), 0e0) AS lo, greatest(max(value), 1e0) AS hi FROM events)""")
def sparkline(spark, sf):
    out = rollups.normalised(spark.read.parquet(f"{sf}/events.parquet"), "value")
    return out.select("event_id", r6("scaled").alias("scaled"))


@reg.query("alert_sequence", duck_with("fx_alerts") +
           "SELECT event_id, row_number() OVER (ORDER BY detected_at, event_id) AS seq FROM fx_alerts")
def alert_sequence(spark, sf):
    return rollups.numbered(inputs.alerts(spark, sf)).select("event_id", "seq")


@reg.query("latest_per_node", attr_sql(
    "SELECT node_id, event_id, flow_id, severity FROM ev QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) = 1"))
def latest_per_node(spark, sf):
    events = inputs.state_events(spark, sf).select("node_id", "event_id", "flow_id", "severity", "ts")
    return rollups.latest_per(events, "node_id", ["ts", "event_id"]).drop("ts")


@reg.query("newest_alerts", attr_sql(
    f"SELECT event_id, node_id, severity FROM attr WHERE {rank_sql('severity')} >= 3 ORDER BY detected_at DESC, event_id DESC LIMIT 100"))
def newest_alerts(spark, sf):
    return views.recent_alerts(inputs.attributed(spark, sf), 100, "medium").select(
        "event_id", "node_id", "severity")


@reg.query("newest_per_node", attr_sql(
    "SELECT node_id, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY detected_at DESC, event_id DESC) AS rn FROM ev) WHERE rn <= 25"))
def newest_per_node(spark, sf):
    return rollups.newest_per(inputs.state_events(spark, sf), "node_id", 25).select(
        "node_id", "event_id", "rn")


@reg.query("timeline_range", attr_sql(
    "SELECT event_id, node_id FROM ev WHERE ts >= 1000 AND ts <= 20000 ORDER BY ts DESC, event_id DESC LIMIT 1000"))
def timeline_range(spark, sf):
    return rollups.time_range(inputs.state_events(spark, sf), 1000.0, 20000.0, 1000).select(
        "event_id", "node_id")


@reg.query("filter_alerts", duck_with("fx_alerts") +
           "SELECT event_id, src_ip, score FROM fx_alerts WHERE score >= 0.5 AND dst_port = 443 ORDER BY detected_at DESC, event_id DESC LIMIT 50")
def filter_alerts(spark, sf):
    return views.filter_alerts(inputs.alerts(spark, sf), 0.5, dst_port=443).select(
        "event_id", "src_ip", "score")


_HAY = "lower(concat_ws(' ', coalesce({0}src_ip, 'null'), coalesce({0}dst_ip, 'null'), coalesce(node_id, 'null'), severity, CAST(dst_port AS VARCHAR)))"


@reg.query("log_view", attr_sql(
    f"SELECT event_id, node_id, severity FROM attr WHERE contains({_HAY.format('')}, 'high') ORDER BY {rank_sql('severity')} DESC, event_id"))
def log_view(spark, sf):
    return views.log_view(inputs.attributed(spark, sf), " HIGH ", "severity").select(
        "event_id", "node_id", "severity")


_NHAY = "contains(lower(concat_ws(' ', coalesce(name, 'null'), coalesce(ip, 'null'), coalesce(mac, 'null'), coalesce(vendor, 'null'), coalesce(subnet, 'null'))), '{q}')"


@reg.query("search_nodes", state_sql(f"SELECT id, severity FROM ns WHERE {_NHAY.format(q='customer#00000001')}"))
def search_nodes(spark, sf):
    return located(spark, sf).filter(views.passes(query="Customer#00000001")).select("id", "severity")


_FILTER = "device_type IN ('server', 'iot') AND vendor IN ('Cisco') AND rank >= 2"


@reg.query("filter_nodes", state_sql(f"SELECT id, severity, CAST(rank AS INTEGER) AS rank FROM ns WHERE {_FILTER}"))
def filter_nodes(spark, sf):
    rule = views.passes("low", vendors=["Cisco"], types=["server", "iot"])
    return located(spark, sf).filter(rule).select("id", "severity", "rank")


@reg.query("visible_nodes", state_sql("SELECT id, severity FROM ns WHERE subnet = '10.20.30.0/24' OR rank > 0"))
def visible_nodes(spark, sf):
    return views.visible(located(spark, sf), views.passes(subnets=["10.20.30.0/24"])).select(
        "id", "severity")


_PHAY = _NHAY.replace("coalesce(subnet, 'null')", "coalesce(subnet, 'null'), device_type")


@reg.query("palette", state_sql("""SELECT 'Active alerts' AS section, id, name, severity FROM hit UNION ALL
 SELECT 'Hosts', id, name, severity FROM (SELECT * FROM m WHERE id NOT IN (SELECT id FROM hit) ORDER BY id LIMIT 8)""",
    f"m AS (SELECT * FROM ns WHERE {_PHAY.format(q='10.20.1')})",
    "hit AS (SELECT * FROM m WHERE rank > 0 ORDER BY rank DESC, last_alert_at DESC, id LIMIT 6)"))
def palette(spark, sf):
    return views.palette(located(spark, sf), "10.20.1")


@reg.query("alert_queue", state_sql(f"""SELECT l.node_id, coalesce(n.name, l.node_id) AS name, n.ip, n.device_type, l.severity, {sql6('l.score')} AS score, l.alert_count
 FROM (SELECT * FROM live ORDER BY rank DESC, last_alert_at DESC, node_id LIMIT 80) l LEFT JOIN nd n ON n.id = l.node_id"""))
def alert_queue(spark, sf):
    out = views.alert_queue(states(spark, sf), inputs.nodes(spark, sf))
    return out.withColumn("score", r6("score")).drop("last_alert_at")


@reg.query("auto_tickets", state_sql("SELECT node_id, severity FROM live WHERE rank >= 4"))
def auto_tickets(spark, sf):
    return views.ticket_rule(states(spark, sf), "high").select("node_id", "severity")


_F = lambda x, d: f"printf('%.{d}f', {x} + 1e-12)"
_SUM = f"concat(e.src_ip, ':', e.src_port, ' -> ', e.dst_ip, ':', e.dst_port, ' score ', {_F('e.score', 3)})"


@reg.query("ticket_fields", state_sql(f"""SELECT l.node_id, concat('[', upper(l.severity), '] Suspicious activity on ', n.name) AS title,
 concat(l.alert_count, ' alert(s), peak score ', {_F('l.score', 2)}, '. Latest: ', t.s) AS summary, t.k AS evidence_rows, t.f AS newest_flow, n.mac AS asset_mac
 FROM live l JOIN nd n ON n.id = l.node_id LEFT JOIN (SELECT node_id, least(count(*), 20) AS k, arg_max(flow_id, (ts, event_id)) AS f,
  arg_max({_SUM}, (ts, event_id)) AS s FROM ev e GROUP BY node_id) t ON t.node_id = l.node_id"""))
def ticket_fields(spark, sf):
    out = views.tickets(states(spark, sf), inputs.nodes(spark, sf), inputs.state_events(spark, sf))
    return out.select("node_id", "title", "summary",
                      F.size("evidence").cast("long").alias("evidence_rows"),
                      F.col("evidence")[0]["flow_id"].alias("newest_flow"),
                      F.col("asset.mac").alias("asset_mac"))


@reg.query("labels_and_summaries", attr_sql(
    f"SELECT event_id, {_SUM.replace('e.', '')} AS summary, coalesce(nullif(n.name, ''), nullif(n.ip, ''), n.id) AS label FROM attr LEFT JOIN fx_nodes n ON n.id = node_id"
    .replace("src_ip, ':'", "attr.src_ip, ':'")))
def labels_and_summaries(spark, sf):
    n = inputs.nodes(spark, sf).select("id", "name", "ip")
    out = inputs.attributed(spark, sf).join(n, F.col("node_id") == F.col("id"), "left")
    return out.select("event_id", alert_summary(F.col).alias("summary"),
                      node_label(F.col("name"), F.col("ip"), F.col("id")).alias("label"))


@reg.query("timeline_export", attr_sql(f"""SELECT concat(strftime(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S'), '.',
 lpad(CAST(CAST(floor((ts - floor(ts)) * 1000) AS INTEGER) AS VARCHAR), 3, '0'), 'Z') AS timestamp_iso,
 {_F('ts', 3)} AS timestamp_epoch, node_id, severity, {_F('score', 4)} AS score, src_ip, dst_ip, dst_port, flow_id FROM ev"""))
def timeline_export(spark, sf):
    return views.timeline_export(inputs.state_events(spark, sf))
