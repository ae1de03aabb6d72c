"""Device identity, links, layout and topology facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with
from netlumen.operators import layout, state, topology, views
from netlumen.plans import inputs
from netlumen.plans.catalog_state import AS_OF, attr_sql
from netlumen.plans.catalog_views import MAC_SQL, VENDOR_SQL, nodes, states
from netlumen.plans.registry import ATTRIBUTION_CTES, Registry, decay_ctes, r6, sql6, state_ctes
from netlumen.session import materialize
from netlumen.sources.oui import builtin

reg = Registry()

# --- identity ---------------------------------------------------------------------
_NORM = ("CASE WHEN mac IS NOT NULL THEN regexp_replace(lower(regexp_replace(mac, '[^0-9A-Fa-f]', '', 'g')), "
         "'(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') END")
_IDENTITY = (
    f"ob AS (SELECT *, {_NORM} AS nmac, lower(trim(hostname)) AS host FROM fx_observations)",
    """kd AS (SELECT *, CASE WHEN nmac IS NOT NULL THEN 'mac:' || nmac WHEN coalesce(ip, '') <> '' THEN 'ip:' || ip ELSE 'host:' || lower(hostname) END AS key,
 CASE WHEN host <> '' THEN min(ord) OVER (PARTITION BY host) END AS first_ord FROM ob)""",
    """kn AS (SELECT a.*, b.key AS first_key, min(CASE WHEN a.host = '' OR a.ord = a.first_ord THEN a.ord END) OVER (PARTITION BY a.key) AS since
 FROM kd a LEFT JOIN kd b ON b.ord = a.first_ord AND b.host = a.host)""",
    "idt AS (SELECT *, CASE WHEN since <= ord THEN key ELSE first_key END AS identity FROM kn)",
    """mg AS (SELECT identity, min(ord) AS ord, arg_min(nullif(ip, ''), ord) FILTER (coalesce(ip, '') <> '') AS ip,
 arg_min(nmac, ord) FILTER (nmac IS NOT NULL) AS mac, arg_min(hostname, ord) FILTER (hostname <> '') AS hostname,
 arg_min(device_type_hint, ord) FILTER (device_type_hint <> '') AS hint, arg_min(vendor_hint, ord) FILTER (vendor_hint <> '') AS vh,
 arg_min(os_hint, ord) FILTER (os_hint <> '') AS os FROM idt GROUP BY identity)""",
    """sv AS (SELECT identity, string_agg(v, ',' ORDER BY o, p) AS services FROM (SELECT identity, v, min(ord) AS o, arg_min(p, ord) AS p FROM (
 SELECT identity, ord, unnest(l) AS v, unnest(generate_series(1, len(l))) AS p FROM (SELECT identity, ord, string_split(services_csv, ',') AS l FROM idt WHERE services_csv <> '')) GROUP BY 1, 2) GROUP BY 1)""",
    "sr AS (SELECT identity, string_agg(DISTINCT s, '+' ORDER BY s) AS discovered_by FROM (SELECT identity, unnest(string_split(source, '+')) AS s FROM idt) GROUP BY 1)",
    """xi AS (SELECT identity, string_agg(DISTINCT a, ',' ORDER BY a) AS more FROM (SELECT i.identity, a FROM (
 SELECT identity, ip AS a FROM idt UNION ALL SELECT identity, ips_csv FROM idt) i JOIN mg ON mg.identity = i.identity WHERE coalesce(a, '') <> '' AND a IS DISTINCT FROM mg.ip) GROUP BY 1)""",
    f"""nodes_ AS (SELECT mg.*, coalesce(services, '') AS services, discovered_by, CASE WHEN mg.ip IS NULL THEN coalesce(more, '') ELSE concat_ws(',', mg.ip, more) END AS ips,
 coalesce(vh, {VENDOR_SQL.replace('substr(mac_raw, 1, 6)', "replace(substr(mac, 1, 8), ':', '')")}) AS vendor FROM mg
 LEFT JOIN sv USING (identity) LEFT JOIN sr USING (identity) LEFT JOIN xi USING (identity))""",
    """typed AS (SELECT *, CASE WHEN hint IS NOT NULL THEN hint WHEN t LIKE '%printer%' THEN 'printer' WHEN t LIKE '%server%' THEN 'server' WHEN vendor = 'Canon' THEN 'printer'
 WHEN vendor = 'Cisco' THEN 'switch' ELSE 'unknown' END AS device_type FROM (SELECT *, lower(concat(coalesce(os, ''), ' ', coalesce(hostname, ''))) AS t FROM nodes_))""",
)
_LOCAL = "substr(mac, 1, 2) = '02'"
_IDSQL = (f"CASE WHEN mac IS NOT NULL AND NOT {_LOCAL} THEN 'n-' || replace(mac, ':', '') WHEN ip IS NOT NULL THEN 'n-ip-' || replace(ip, '.', '-') "
          "WHEN mac IS NOT NULL THEN 'n-' || replace(mac, ':', '') ELSE 'n-' || replace(lower(hostname), ' ', '-') END")


@reg.query("identity_resolution", duck_with("fx_observations", *_IDENTITY[:4]) + "SELECT ord, identity FROM idt")
def identity_resolution(spark, sf):
    return topology.identify(topology.observations(inputs.observations(spark, sf))).select(
        "ord", "identity")


@reg.query("identity_merge", duck_with("fx_observations", *_IDENTITY) + f"""SELECT {_IDSQL} AS id, coalesce(hostname, ip, mac, 'unknown') AS name, ip, ips, mac, vendor,
 device_type, coalesce(os, '') AS os, services, discovered_by,
 CASE WHEN ip IS NULL THEN 'unknown' ELSE regexp_extract(ip, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1) || '.0/24' END AS subnet,
 concat_ws(',', CASE WHEN mac IS NOT NULL AND {_LOCAL} THEN 'randomized-mac' END, CASE WHEN device_type IN ('switch', 'router', 'firewall', 'wireless_ap') THEN 'infrastructure' END) AS tags
 FROM typed""")
def identity_merge(spark, sf):
    out = topology.build_nodes(inputs.observations(spark, sf))
    join = lambda c, s=",": F.array_join(c, s).alias(c)
    return out.select("id", "name", "ip", join("ips"), "mac", "vendor", "device_type", "os",
                      join("services"), join("discovered_by", "+"), "subnet", join("tags"))


@reg.query("vendor_lookup", duck_with("fx_nodes") + f"SELECT id, {VENDOR_SQL} AS vendor FROM fx_nodes")
def vendor_lookup(spark, sf):
    return nodes(spark, sf).select("id", "vendor")


# --- links ------------------------------------------------------------------------
_ND = f"nd AS (SELECT *, {MAC_SQL} AS mac, {VENDOR_SQL} AS vendor FROM fx_nodes)"
_ENDS = (
    _ND,
    """names AS (SELECT key, arg_min(id, id) AS id FROM (SELECT 'n:' || lower(name) AS key, id FROM nd UNION ALL SELECT 'i:' || ip, id FROM nd
 UNION ALL SELECT 'm:' || mac, id FROM nd) GROUP BY key)""",
    """raw AS (SELECT *, 'm:' || regexp_replace(lower(regexp_replace(remote_mac, '[^0-9A-Fa-f]', '', 'g')), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS rm FROM fx_links)""",
    """ends_ AS (SELECT r.*, coalesce(ln.id, li.id, lm.id) AS local_id, coalesce(rm_.id, rn.id, ri.id, rx.id) AS remote_id FROM raw r
 LEFT JOIN names ln ON ln.key = 'n:' || lower(trim(local)) LEFT JOIN names li ON li.key = 'i:' || local LEFT JOIN names lm ON lm.key = 'm:' || local
 LEFT JOIN names rm_ ON rm_.key = rm LEFT JOIN names rn ON rn.key = 'n:' || lower(trim(remote)) LEFT JOIN names ri ON ri.key = 'i:' || remote LEFT JOIN names rx ON rx.key = 'm:' || remote)""",
    """meas AS (SELECT concat('l-', source, '-', target) AS id, source, target, kind, bandwidth_mbps, discovered_by FROM (SELECT least(local_id, remote_id) AS source, greatest(local_id, remote_id) AS target,
 kind, bandwidth_mbps, fx_source AS discovered_by, row_number() OVER (PARTITION BY least(local_id, remote_id), greatest(local_id, remote_id) ORDER BY ord) AS k
 FROM (SELECT *, source AS fx_source FROM ends_) WHERE local_id IS NOT NULL AND remote_id IS NOT NULL AND local_id <> remote_id) WHERE k = 1)""",
    """inf AS (SELECT concat('l-', source, '-', target) AS id, source, target, 'inferred' AS kind, CAST(NULL AS INTEGER) AS bandwidth_mbps, 'inference:subnet' AS discovered_by FROM (
 SELECT least(h.id, u) AS source, greatest(h.id, u) AS target FROM (SELECT n.id, coalesce(s.sw, (SELECT min(id) FROM nd WHERE device_type IN ('switch', 'router'))) AS u FROM nd n
 LEFT JOIN (SELECT subnet, min(id) AS sw FROM nd WHERE device_type IN ('switch', 'wireless_ap') GROUP BY 1) s ON s.subnet = n.subnet
 WHERE n.device_type NOT IN ('switch', 'router', 'firewall', 'wireless_ap') AND n.id NOT IN (SELECT source FROM meas UNION SELECT target FROM meas)) h WHERE u IS NOT NULL AND u <> h.id))""",
    "links_ AS (SELECT * FROM meas UNION ALL SELECT * FROM inf)",
)
_BOTH = "both_ AS (SELECT source AS id, target AS peer, kind FROM links_ UNION ALL SELECT target, source, kind FROM links_)"


def link_sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return duck_with("fx_nodes fx_links", *_ENDS, _BOTH, *ctes, recursive=recursive) + body


def links(spark, sf):
    return topology.build_links(inputs.link_sightings(spark, sf), nodes(spark, sf))


@reg.query("link_endpoints", link_sql("SELECT ord, local_id, remote_id FROM ends_"))
def link_endpoints(spark, sf):
    return topology.resolve_endpoints(inputs.link_sightings(spark, sf), nodes(spark, sf)).select(
        "ord", "local_id", "remote_id")


@reg.query("topology_links", link_sql("SELECT * FROM meas"))
def topology_links(spark, sf):
    out = topology.measured_links(inputs.link_sightings(spark, sf), nodes(spark, sf))
    return out.withColumn("discovered_by", F.array_join("discovered_by", "+"))


@reg.query("inferred_uplinks", link_sql("SELECT id, source, target, kind, discovered_by FROM inf"))
def inferred_uplinks(spark, sf):
    n = nodes(spark, sf)
    out = topology.inferred_uplinks(n, topology.measured_links(inputs.link_sightings(spark, sf), n))
    return out.select("id", "source", "target", "kind",
                      F.array_join("discovered_by", "+").alias("discovered_by"))


@reg.query("neighbours", link_sql("SELECT id, peer, kind FROM both_"))
def neighbours(spark, sf):
    return topology.neighbours(links(spark, sf))


@reg.query("present_links", link_sql(
    "SELECT source, target FROM links_ WHERE source IN (SELECT id FROM nd WHERE criticality >= 1) AND target IN (SELECT id FROM nd WHERE criticality >= 1)"))
def present_links(spark, sf):
    kept = nodes(spark, sf).filter(F.col("criticality") >= 1)
    return topology.present_links(links(spark, sf), kept).select("source", "target")


@reg.query("discovery_summary", link_sql(
    """SELECT source, count(*) AS observations, (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM links_) AS links,
 (SELECT count(*) FROM meas) AS links_measured, (SELECT count(*) FROM inf) AS links_inferred FROM fx_links GROUP BY source"""))
def discovery_summary(spark, sf):
    return topology.run_summary(inputs.link_sightings(spark, sf), nodes(spark, sf), links(spark, sf))


@reg.query("orphan_states", attr_sql(
    "SELECT node_id FROM live WHERE node_id IN (SELECT id FROM fx_nodes WHERE device_type <> 'server')",
    *decay_ctes(until=AS_OF), *state_ctes(AS_OF)))
def orphan_states(spark, sf):
    kept = nodes(spark, sf).filter(F.col("device_type") != "server")
    return topology.drop_orphans(states(spark, sf), kept).select("node_id")


@reg.query("node_detail", duck_with(
    "fx_nodes fx_links fx_alerts", *ATTRIBUTION_CTES, *decay_ctes(until=AS_OF), *state_ctes(AS_OF), *_ENDS, _BOTH,
    "near AS (SELECT id, string_agg(peer || ' ' || kind, ',' ORDER BY peer, kind) AS neighbours FROM both_ GROUP BY id)",
    """newest AS (SELECT node_id, string_agg(flow_id, ',' ORDER BY detected_at DESC, event_id DESC) AS alerts FROM (
 SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY detected_at DESC, event_id DESC) AS k FROM ev) WHERE k <= 25 GROUP BY node_id)""",
    """ports AS (SELECT node_id, string_agg(i, ',' ORDER BY o DESC) AS top_ports FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY o DESC) AS r
 FROM (SELECT node_id, CAST(dst_port AS VARCHAR) AS i, max(event_id) AS o FROM ev GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1)""") +
    f"""SELECT nd.id, name, vendor, l.severity, {sql6('l.score')} AS score, coalesce(l.alert_count, 0) AS alert_count, coalesce(neighbours, '') AS neighbours,
 coalesce(alerts, '') AS alerts, coalesce(top_ports, '') AS top_ports FROM nd LEFT JOIN live l ON l.node_id = nd.id
 LEFT JOIN near ON near.id = nd.id LEFT JOIN newest ON newest.node_id = nd.id LEFT JOIN ports ON ports.node_id = nd.id""")
def node_detail(spark, sf):
    """What is known of every device, its nested parts as text."""
    events = materialize(inputs.state_events(spark, sf), "events")       # three readers
    live = state.state_at(events, inputs.last_detection(spark, sf))
    out = views.node_detail(nodes(spark, sf), live, links(spark, sf), events, state.recent_context(events))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select(
        "id", "node.name", "node.vendor", "state.severity", r6("state.score").alias("score"),
        "telemetry.alert_count", text("neighbours", lambda n: F.concat_ws(" ", n["id"], n["kind"])).alias("neighbours"),
        text("alerts", lambda a: a["flow_id"]).alias("alerts"),
        F.coalesce(F.array_join(F.col("telemetry.top_ports").cast("array<string>"), ","), F.lit("")).alias("top_ports"))


@reg.query("removed_nodes", duck_with("fx_nodes") + "SELECT id FROM fx_nodes WHERE device_type = 'server'")
def removed_nodes(spark, sf):
    before = nodes(spark, sf)
    return topology.removed_nodes(before, before.filter(F.col("device_type") != "server")).select("id")


@reg.query("topology_stats", link_sql(
    """SELECT 'device_type' AS dim, device_type AS value, count(*) AS n, CAST(NULL AS BIGINT) AS links, CAST(NULL AS VARCHAR) AS vendors FROM nd GROUP BY device_type
 UNION ALL SELECT 'subnet', subnet, count(*), NULL, NULL FROM nd GROUP BY subnet
 UNION ALL SELECT 'total', NULL, count(*), (SELECT count(*) FROM links_), string_agg(DISTINCT vendor, ',' ORDER BY vendor) FROM nd"""))
def topology_stats(spark, sf):
    return topology.topology_stats(nodes(spark, sf), links(spark, sf))


# --- layout -----------------------------------------------------------------------
_U = lambda axis: f"CAST(CAST(concat('0x', substr(sha256(id || '{axis}'), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496e0"
_GA = "(pi() * (3e0 - sqrt(5e0)))"
_LAYERS = ("""lay AS (SELECT nd.*, CASE WHEN d.k >= 2 THEN 2 WHEN device_type IN ('router', 'firewall') THEN 3 WHEN device_type IN ('switch', 'wireless_ap') THEN 1 ELSE 0 END AS layer
 FROM nd LEFT JOIN (SELECT b.id, count(DISTINCT peer) AS k FROM both_ b JOIN nd n ON n.id = b.id JOIN nd p ON p.id = b.peer
 WHERE n.device_type IN ('switch', 'wireless_ap') AND p.device_type IN ('switch', 'wireless_ap') GROUP BY 1) d ON d.id = nd.id)""",)
_PLACE = (
    *_LAYERS,
    """ctr AS (SELECT subnet, n, CASE WHEN c = 1 THEN 0e0 ELSE 9e0 * sqrt(t) / 2 * cos(2 * pi() * i / c) END AS cx,
 CASE WHEN c = 1 THEN 0e0 ELSE 9e0 * sqrt(t) / 2 * sin(2 * pi() * i / c) END AS cz FROM (SELECT subnet, n, row_number() OVER (ORDER BY subnet) - 1 AS i, count(*) OVER () AS c, sum(n) OVER () AS t
 FROM (SELECT subnet, count(*) AS n FROM lay WHERE layer = 0 GROUP BY 1)))""",
    f"""host AS (SELECT id, layer, CASE WHEN n <= 1 THEN 0e0 ELSE r * cos({_GA} * i) END + cx + ({_U('x')} - 0.5e0) * 0.35e0 AS x,
 ({_U('y')} - 0.5e0) * 0.7e0 AS y, CASE WHEN n <= 1 THEN 0e0 ELSE r * sin({_GA} * i) END + cz + ({_U('z')} - 0.5e0) * 0.35e0 AS z
 FROM (SELECT l.id, l.layer, c.cx, c.cz, c.n, i, 9e0 * sqrt(n) / 2.2e0 * sqrt((i + 0.5e0) / n) AS r FROM (SELECT *, row_number() OVER (PARTITION BY subnet ORDER BY id) - 1 AS i FROM lay WHERE layer = 0) l JOIN ctr c ON c.subnet = l.subnet))""",
    # Infrastructure one device at a time, in tier and id order; positions ride in a list.
    """infra AS (SELECT l.id, l.layer, coalesce(c.cx, 10.8e0 * (layer - 1) * cos(2 * pi() * ti / tn)) AS fx, coalesce(c.cz, 10.8e0 * (layer - 1) * sin(2 * pi() * ti / tn)) AS fz,
 row_number() OVER (ORDER BY layer, l.id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY id) - 1 AS ti, count(*) OVER (PARTITION BY layer) AS tn FROM lay WHERE layer > 0) l
 LEFT JOIN ctr c ON c.subnet = l.subnet)""",
    """adj AS (SELECT DISTINCT b.id, b.peer FROM both_ b JOIN infra i ON i.id = b.id)""",
    """hsum AS (SELECT a.id, sum(x) AS sx, sum(z) AS sz, count(*) AS n FROM adj a JOIN host h ON h.id = a.peer GROUP BY 1)""",
    """want AS (SELECT i.*, coalesce(sx, 0e0) AS sx, coalesce(sz, 0e0) AS sz, coalesce(n, 0) AS n, (SELECT list(peer) FROM adj a WHERE a.id = i.id) AS peers FROM infra i LEFT JOIN hsum h ON h.id = i.id)""",
    """put AS (SELECT CAST(0 AS BIGINT) AS k, [{'id': '', 'x': 0e0, 'z': 0e0}] AS done UNION ALL
 SELECT k, list_append(done, {'id': id, 'x': CASE WHEN n + len(near) > 0 THEN (sx + coalesce(list_sum(list_transform(near, lambda d: d.x)), 0e0)) / (n + len(near)) ELSE fx END,
  'z': CASE WHEN n + len(near) > 0 THEN (sz + coalesce(list_sum(list_transform(near, lambda d: d.z)), 0e0)) / (n + len(near)) ELSE fz END}) FROM (
  SELECT w.*, p.done, list_filter(p.done, lambda d: list_contains(w.peers, d.id)) AS near FROM put p JOIN want w ON w.k = p.k + 1))""",
    "last_ AS (SELECT unnest(done) AS d FROM put ORDER BY put.k DESC LIMIT 1000000)",
    "ipos AS (SELECT DISTINCT d.id AS id, d.x AS x, d.z AS z FROM last_ WHERE d.id <> '')",
    """pos AS (SELECT id, layer, x, y, z FROM host UNION ALL SELECT i.id, i.layer, p.x, CASE i.layer WHEN 1 THEN 15e0 WHEN 2 THEN 30e0 ELSE 46e0 END, p.z FROM infra i JOIN ipos p ON p.id = i.id)""",
)


def layout_sql(body: str, *ctes: str) -> str:
    return link_sql(body, *_PLACE, *ctes, recursive=True)


def placed(spark, sf):
    return layout.compute_layout(nodes(spark, sf), links(spark, sf))


@reg.query("layers", link_sql("SELECT id, CAST(layer AS INTEGER) AS layer FROM lay", *_LAYERS))
def layers(spark, sf):
    return layout.layers(nodes(spark, sf), links(spark, sf)).select("id", "layer")


@reg.query("layout", layout_sql(
    f"SELECT id, CAST(layer AS INTEGER) AS layer, {sql6('x')} AS x, {sql6('y')} AS y, {sql6('z')} AS z FROM pos"))
def layout_query(spark, sf):
    return placed(spark, sf).select("id", "layer", *[r6(c).alias(c) for c in "xyz"])


_AX = ", ".join(f"{sql6(f'{f}({c})')} AS {f}_{c}" for f in ("min", "max") for c in "xyz")
_CX = ", ".join(f"{sql6(f'(min({c}) + max({c})) / 2')} AS center_{c}" for c in "xyz")


@reg.query("bounds", layout_sql(
    f"SELECT {_AX}, {_CX}, {sql6('greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2')} AS radius FROM pos"))
def bounds(spark, sf):
    out = layout.bounds(placed(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@reg.query("clusters", layout_sql(f"""SELECT p.subnet, count(*) AS members, coalesce(any_value(t.label), p.subnet) AS label, {sql6('avg(x)')} AS cx, {sql6('avg(y)')} AS cy, {sql6('avg(z)')} AS cz,
 {sql6('greatest(2.2e0, cbrt(count(*)) * 1.6e0)')} AS radius, 'none' AS worst FROM (SELECT pos.*, nd.subnet FROM pos JOIN nd ON nd.id = pos.id) p
 LEFT JOIN (SELECT subnet, arg_min(team, (-n, o)) AS label FROM (SELECT subnet, team, count(*) AS n, min(id) AS o FROM nd WHERE team <> 'infrastructure' GROUP BY 1, 2) GROUP BY 1) t ON t.subnet = p.subnet
 GROUP BY p.subnet HAVING count(*) >= 8"""))
def clusters(spark, sf):
    tagged = placed(spark, sf).withColumn("tags", F.array("team"))
    out = topology.clusters(tagged)
    return out.withColumns({c: r6(c) for c in ("cx", "cy", "cz", "radius")})


@reg.query("compact_topology", layout_sql(
    f"""SELECT 'node' AS part, row_number() OVER (ORDER BY pos.id) - 1 AS a, CAST(NULL AS BIGINT) AS b, concat_ws('|', pos.id, nd.name, nd.ip, nd.mac, nd.vendor, nd.device_type, nd.subnet, pos.layer) AS body FROM pos JOIN nd ON nd.id = pos.id
 UNION ALL SELECT 'link', s.i, t.i, kind FROM links_ l JOIN ix s ON s.id = l.source JOIN ix t ON t.id = l.target""",
    "ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nd)"))
def compact_topology(spark, sf):
    table, edges = topology.compact(placed(spark, sf), links(spark, sf))
    body = F.concat_ws("|", "id", "name", "ip", "mac", "vendor", "device_type", "subnet",
                       F.col("layer").cast("string"))
    part = table.select(F.lit("node").alias("part"), F.col("idx").alias("a"),
                        F.lit(None).cast("long").alias("b"), body.alias("body"))
    return part.unionByName(edges.select(
        F.lit("link").alias("part"), F.col("source_idx").alias("a"), F.col("target_idx").alias("b"),
        F.col("kind").alias("body")))


@reg.query("expand_topology", link_sql("SELECT source, target, kind FROM links_"))
def expand_topology(spark, sf):
    flat = nodes(spark, sf).withColumns({"layer": F.lit(0), "x": F.lit(0.0), "y": F.lit(0.0), "z": F.lit(0.0)})
    return topology.expand(*topology.compact(flat, links(spark, sf)))


@reg.query("oui_registry", duck_with("fx_nodes") +
           "SELECT DISTINCT upper(substr(mac_raw, 1, 6)) AS oui, concat('Vendor ', upper(substr(mac_raw, 1, 6))) AS vendor FROM fx_nodes")
def oui_registry(spark, sf):
    """A registry update built from the addresses in use overrides the built-in names."""
    from netlumen.functions.net import oui_of
    from netlumen.sources.oui import registry

    update = nodes(spark, sf).select(oui_of(F.col("mac")).alias("oui")).distinct().select(
        "oui", F.concat(F.lit("Vendor "), F.col("oui")).alias("vendor"))
    merged = registry(builtin(spark), update)
    return merged.join(update.select("oui"), "oui", "left_semi")
