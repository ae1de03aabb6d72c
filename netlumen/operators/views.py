"""What an analyst asks of alerts, devices and their state: search, filter, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlumen.functions.severity import alert_summary, fixed, node_label, severity_rank
from netlumen.operators.rollups import newest, newest_per


def filter_alerts(alerts: DataFrame, min_score: float = 0.0, src_ip: str | None = None,
                  dst_port: int | None = None, limit: int = 50) -> DataFrame:
    out = alerts.filter(F.col("score") >= min_score)
    if src_ip:
        out = out.filter(F.col("src_ip") == src_ip)
    if dst_port is not None:
        out = out.filter(F.col("dst_port") == dst_port)
    return newest(out, limit)


def _text(*cols: str) -> Column:
    """Lower-case text of several columns, a missing value reading as 'null'."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("null"))
                                      for c in cols]))


def log_view(alerts: DataFrame, query: str = "", sort: str = "detected_at",
             descending: bool = True, limit: int | None = None) -> DataFrame:
    """Alert log: free-text filter, sortable by any column (severity by its rank)."""
    out = alerts
    q = query.strip().lower()
    if q:
        hay = _text("src_ip", "dst_ip", "node_id", "severity", "dst_port")
        out = out.filter(F.contains(hay, F.lit(q)))
    key = severity_rank(F.col("severity")) if sort == "severity" else F.col(sort)
    out = out.orderBy(key.desc() if descending else key.asc(), F.col("event_id").asc())
    return out if limit is None else out.limit(limit)


def recent_alerts(alerts: DataFrame, limit: int, floor: str = "info") -> DataFrame:
    from netlumen.functions.severity import SCALE

    keep = severity_rank(F.col("severity")) >= SCALE.index(floor)
    return newest(alerts.filter(keep), limit)


def passes(min_severity: str | None = None, query: str = "", subnets: Sequence[str] = (),
           vendors: Sequence[str] = (), types: Sequence[str] = ()) -> Column:
    """Filter over a device row that carries ``rank`` (0 when it has no state)."""
    from netlumen.functions.severity import SCALE

    ok = F.lit(True)
    for column, wanted in (("subnet", subnets), ("vendor", vendors), ("device_type", types)):
        if wanted:
            ok = ok & F.col(column).isin(*wanted)
    if min_severity:
        ok = ok & (F.col("rank") >= SCALE.index(min_severity))
    if query:
        hay = _text("name", "ip", "mac", "vendor", "subnet")
        ok = ok & F.contains(hay, F.lit(query.lower()))
    return ok


def with_state(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Devices left-joined with their live state; rank 0 and severity none without one."""
    s = states.select("node_id", "severity", "score", "alert_count", "last_alert_at")
    out = nodes.join(s, nodes["id"] == s["node_id"], "left").drop("node_id")
    out = out.withColumn("severity", F.coalesce("severity", F.lit("none")))
    return out.withColumn("rank", severity_rank(F.col("severity")))


def visible(nodes_with_state: DataFrame, condition: Column) -> DataFrame:
    """Devices the filter lets through, plus every alerting one."""
    return nodes_with_state.filter(condition | (F.col("rank") > 0))


def palette(nodes_with_state: DataFrame, query: str, alerting: int = 6,
            hosts: int = 8) -> DataFrame:
    """Up to six matching alerting devices, worst first, then up to eight other hosts."""
    q = query.strip().lower()
    hay = _text("name", "ip", "mac", "vendor", "subnet", "device_type")
    match = nodes_with_state.filter(F.contains(hay, F.lit(q))) if q else nodes_with_state
    first = (match.filter(F.col("rank") > 0)
             .orderBy(F.desc("rank"), F.desc("last_alert_at"), "id").limit(alerting))
    columns = ("id", "name", "severity")
    top = first.select(F.lit("Active alerts").alias("section"), *columns)
    if not q:
        return top
    others = (match.join(first.select("id"), "id", "left_anti").orderBy("ord").limit(hosts)
              .select(F.lit("Hosts").alias("section"), *columns))
    return top.unionByName(others)


def alert_queue(states: DataFrame, nodes: DataFrame, limit: int = 80) -> DataFrame:
    """The worst devices with their inventory data; a device without inventory stays."""
    from netlumen.operators.state import ranked

    top = ranked(states, limit)
    n = nodes.select("id", "name", "ip", "device_type")
    return top.join(n, top["node_id"] == n["id"], "left").select(
        "node_id", F.coalesce("name", "node_id").alias("name"), "ip", "device_type",
        "severity", "score", "alert_count", "last_alert_at")


def node_detail(nodes: DataFrame, states: DataFrame, links: DataFrame, alerts: DataFrame,
                context: DataFrame | None = None, alert_limit: int = 25, node: str | None = None) -> DataFrame:
    """One nested row per device, or of ``node`` alone: its inventory, its live state (NULL
    without one), its neighbours in id order, its newest alerts and its telemetry.

    ``alerts`` name their device in node_id; ``context`` may add top_peers and top_ports per
    node_id. The filter on one device is applied to every input before anything is
    gathered. A neighbour list is as long as a device has links."""
    from netlumen.operators.topology import neighbours

    near = neighbours(links, node)
    if node is not None:
        nodes, states = nodes.filter(F.col("id") == node), states.filter(F.col("node_id") == node)
        alerts = alerts.filter(F.col("node_id") == node)
        context = None if context is None else context.filter(F.col("node_id") == node)
    whole = lambda df, name: df.select(F.col("node_id").alias("id"), F.struct("*").alias(name))
    peers = near.groupBy("id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("peer").alias("id"), "kind"))).alias("neighbours"))
    fields = [c for c in alerts.columns if c != "node_id"]
    last = newest_per(alerts, "node_id", alert_limit, "detected_at").groupBy(F.col("node_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rn", F.struct(*fields).alias("a")))).alias("_a"))
    out = nodes.select("id", F.struct("*").alias("node"))
    for part in (whole(states, "state"), peers, last, *([] if context is None else [whole(context, "_c")])):
        out = out.join(part, "id", "left")
    told = [] if context is None else [F.col("_c.top_peers"), F.col("_c.top_ports")]
    listed = [F.col(f"node.{c}") for c in ("services", "discovered_by") if c in nodes.columns]
    return out.select(
        "id", "node", "state", F.coalesce("neighbours", F.array()).alias("neighbours"),
        F.transform(F.coalesce("_a", F.array()), lambda x: x["a"]).alias("alerts"),
        F.struct(F.coalesce("state.alert_count", F.lit(0)).alias("alert_count"), *told, *listed).alias("telemetry"))


def ticket_rule(states: DataFrame, floor: str) -> DataFrame:
    """State rows severe enough to open a ticket."""
    from netlumen.functions.severity import SCALE

    return states.filter(severity_rank(F.col("severity")) >= SCALE.index(floor))


def tickets(states: DataFrame, nodes: DataFrame, alerts: DataFrame, evidence: int = 20,
            source: str = "netlumen") -> DataFrame:
    """One nested incident payload per device state. Evidence is the newest alerts of
    the device, never more than ``evidence`` of them."""
    fields = ("flow_id", "src_ip", "dst_ip", "dst_port", "protocol", "score", "detected_at")
    newest_rows = newest_per(alerts, "node_id", evidence)
    lines = newest_rows.withColumn("summary", alert_summary(F.col))
    packed = F.array_sort(F.collect_list(F.struct("rn", F.struct(*fields).alias("e"), "summary")))
    per_node = lines.groupBy("node_id").agg(packed.alias("_e"))
    joined = states.join(per_node, "node_id", "left").join(
        nodes, F.col("node_id") == nodes["id"])
    optional = lambda c, kind: (F.col(c) if c in joined.columns else F.lit(None).cast(kind))
    latest = F.coalesce(F.try_element_at("_e", F.lit(1))["summary"], F.lit("n/a"))
    label = node_label(F.col("name"), F.col("ip"), F.col("id"))
    return joined.select(
        F.lit(source).alias("source"), "node_id", "severity",
        F.format_string("[%s] Suspicious activity on %s", F.upper("severity"), label).alias("title"),
        F.format_string("%d alert(s), peak score %s. Latest: %s",
                        F.col("alert_count"), fixed(F.col("score"), 2), latest).alias("summary"),
        F.struct(F.col("id").alias("node_id"), "name", "ip", "mac",
                 optional("vendor", "string").alias("vendor"), "device_type", "subnet",
                 optional("site", "string").alias("site"), "criticality",
                 optional("tags", "array<string>").alias("tags")).alias("asset"),
        F.struct("alert_count", optional("alert_count_window", "long").alias("alert_count_window"),
                 "first_alert_at", "last_alert_at", F.col("score").alias("peak_score"),
                 optional("top_ports", "array<int>").alias("top_ports"),
                 optional("top_peers", "array<string>").alias("top_peers")).alias("detection"),
        F.transform(F.coalesce("_e", F.array()), lambda x: x["e"]).alias("evidence"))


def timeline_export(events: DataFrame) -> DataFrame:
    """The columns and text formats of the timeline file."""
    # Plain arithmetic keeps the text in UTC whatever the session zone is.
    second = F.floor(F.col("ts"))
    of_day = F.pmod(second, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int"))
    iso = F.format_string(
        "%sT%02d:%02d:%02d.%03dZ", day.cast("string"), F.floor(of_day / 3600),
        F.floor(of_day / 60) % 60, of_day % 60, F.floor((F.col("ts") - second) * 1000))
    return events.select(
        iso.alias("timestamp_iso"), fixed(F.col("ts"), 3).alias("timestamp_epoch"),
        "node_id", "severity", fixed(F.col("score"), 4).alias("score"),
        "src_ip", "dst_ip", "dst_port", "flow_id")


def write_timeline(events: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes the export as a folder of CSV or JSON files."""
    if fmt == "csv":
        timeline_export(events).write.option("header", True).csv(path)
    elif fmt == "json":
        events.write.json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
