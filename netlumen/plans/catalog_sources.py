"""Parsers, payload decoding, dataset adapters and augmentation over derived inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with
from netlumen.operators import augment, topology
from netlumen.plans import discovery, inputs
from netlumen.plans.catalog_views import MAC_SQL
from netlumen.plans.registry import Registry, r6, sql6
from netlumen.schemas import CONNECTION_FIELDS, as_connections
from netlumen.session import scratch_path
from netlumen.sources import alerts as codec
from netlumen.sources import datasets, lldp, neighbours, snmp, topology_io

reg = Registry()
_ND = f"nd AS (SELECT *, {MAC_SQL} AS mac FROM fx_nodes)"


def _dumps(rows, line, subject="subnet"):
    """One dump per subnet with a line per device, as a collected folder would hold."""
    return rows.select(F.col(subject).alias("dump"), line.alias("line"), "id").groupBy("dump").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))),
                                 lambda x: x["line"]), "\n").alias("text"))


@reg.query("neighbour_dumps", duck_with("fx_nodes", _ND) +
           "SELECT ip, mac, CASE WHEN criticality = 0 THEN name ELSE '' END AS hostname, 'eth0' AS interface, 'arp' AS source FROM nd WHERE device_type <> 'printer'")
def neighbour_dumps(spark, sf):
    """Devices written in the four neighbour-table spellings and read back; entries
    that never resolved (printers) must not become devices."""
    return _neighbour_hosts(inputs.nodes(spark, sf)).select("ip", "mac", "hostname", "interface", "source")


def _neighbour_hosts(n):
    dead = F.col("device_type") == "printer"
    line = (F.when(F.col("criticality") == 0, F.format_string(
        "%s (%s) at %s [ether] on eth0", "name", "ip", F.when(dead, "<incomplete>").otherwise(F.col("mac"))))
        .when(F.col("criticality") == 1, F.format_string(
            "%s dev eth0 lladdr %s %s", "ip", "mac", F.when(dead, "FAILED").otherwise("REACHABLE")))
        .when(F.col("criticality") == 2, F.format_string(
            "%s 0x1 %s %s * eth0", "ip", F.when(dead, "0x0").otherwise("0x2"), "mac"))
        .otherwise(F.format_string("? (%s) at %s on eth0 ifscope [ethernet]", "ip",
                                   F.when(dead, "(incomplete)").otherwise(F.regexp_replace("mac", "(^|:)0", "$1")))))
    return neighbours.parse_neighbours(_dumps(n, line))


_LLDP_SQL = duck_with("fx_nodes", _ND) + """SELECT mac, name AS hostname, ip, 'eth7' AS interface,
 CASE device_type WHEN 'router' THEN 'router' WHEN 'wireless_ap' THEN 'wireless_ap' WHEN 'switch' THEN 'switch' WHEN 'firewall' THEN 'router' ELSE 'workstation' END AS device_type_hint FROM nd"""


@reg.query("lldp_json", _LLDP_SQL)
def lldp_json(spark, sf):
    """One JSON report per device in one of the three shapes."""
    hosts, _ = _lldp_reports(inputs.nodes(spark, sf))
    return hosts.select("mac", "hostname", "ip", "interface", "device_type_hint")


def _lldp_reports(n):
    cap = F.when(F.col("device_type").isin("router", "firewall"), "Router").when(
        F.col("device_type") == "wireless_ap", "Wlan").when(
        F.col("device_type") == "switch", "Bridge").otherwise("Station")
    caps = '"capability":[{"type":"Telephone","enabled":false},{"type":"%s","enabled":true}]'
    named = '{"lldp":{"interface":[{"name":"eth7","chassis":{"name":"%s","id":{"type":"mac","value":"%s"},"mgmt-ip":[{"value":"%s"}],' + caps + '},"port":{"id":{"type":"ifname","value":"p1"}}}]}}'
    keyed = '{"lldp":{"interface":{"eth7":{"chassis":{"name":[{"value":"%s"}],"id":[{"type":"mac","value":"%s"}],"mgmt-ip":"%s",' + caps + '}}}}}'
    by_name = '{"lldp":{"interface":[{"eth7":{"chassis":{"%s":{"id":{"type":"mac","value":"%s"},"mgmt-ip":"%s",' + caps + '}}}}]}}'
    args = ["name", "mac", "ip", cap]
    text = F.when(F.col("criticality") == 0, F.format_string(named, *args)).when(
        F.col("criticality") == 1, F.format_string(keyed, *args)).otherwise(F.format_string(by_name, *args))
    dumps = n.select(F.col("id").alias("dump"), text.alias("text"), F.lit("probe-1").alias("local_name"))
    return lldp.parse_json(dumps)


_TEXT_SQL = duck_with("fx_nodes", _ND) + """SELECT 'probe-1' AS local, name AS remote, 'eth7' AS local_port, concat('gi0/', criticality) AS remote_port, mac AS remote_mac FROM nd"""


@reg.query("lldp_text", _TEXT_SQL)
def lldp_text(spark, sf):
    line = F.format_string(
        "-------\nInterface:    eth7, via: LLDP, RID: 1\n  Chassis:\n    ChassisID:    mac %s\n    SysName:      %s\n"
        "    MgmtIP:       %s\n    Capability:   Bridge, on\n    Capability:   Router, off\n  Port:\n    PortID:       ifname gi0/%d\n",
        "mac", "name", "ip", "criticality")
    dumps = _dumps(inputs.nodes(spark, sf), line).withColumn("local_name", F.lit("probe-1"))
    _, links = lldp.parse_text(dumps)
    return links.select("local", "remote", "local_port", "remote_port", "remote_mac")


def _walks(spark, sf):
    """One walk per device: it lists itself and one neighbour."""
    text = F.format_string(
        "SNMPv2-MIB::sysDescr.0 = STRING: \"Cisco IOS Catalyst L3 Switch\"\n.1.3.6.1.2.1.1.2.0 = OID: .1.3.6.1.4.1.9.1.516\n"
        "SNMPv2-MIB::sysName.0 = STRING: %s\nIF-MIB::ifName.3 = STRING: Gi0/3\nIF-MIB::ifPhysAddress.3 = STRING: %s\n"
        "IP-MIB::ipNetToMediaPhysAddress.3.%s = STRING: %s\nLLDP-MIB::lldpRemSysName.0.3.1 = STRING: peer-%s\n"
        "1.0.8802.1.1.2.1.4.1.1.7.0.3.1 = STRING: \"eth1\"\nSNMPv2-MIB::sysContact.0 = No Such Object available on this agent at this OID\n",
        "name", "mac", "ip", F.regexp_replace("mac", ":", " "), "id")
    n = inputs.nodes(spark, sf)
    dumps = n.select(F.col("id").alias("dump"), text.alias("text"))
    return snmp.parse_walks(dumps), n.select(F.col("id").alias("dump"), F.col("ip").alias("host_ip"))


@reg.query("snmp_walk_variables", duck_with("fx_nodes") + """SELECT name, count(*) AS devices FROM (SELECT id, unnest(['sysDescr', 'sysObjectID', 'sysName', 'ifName', 'ifPhysAddress',
 'ipNetToMediaPhysAddress', 'lldpRemSysName', 'lldpRemPortId']) AS name FROM fx_nodes) GROUP BY 1""")
def snmp_walk_variables(spark, sf):
    walks, _ = _walks(spark, sf)
    return walks.groupBy("name").agg(F.count(F.lit(1)).alias("devices"))


@reg.query("snmp_devices", duck_with("fx_nodes", _ND) +
           "SELECT ip, mac, name AS hostname, 'switch' AS device_type_hint, 'Cisco' AS vendor_hint FROM nd")
def snmp_devices(spark, sf):
    return snmp.devices(*_walks(spark, sf)).select("ip", "mac", "hostname", "device_type_hint", "vendor_hint")


@reg.query("snmp_neighbours", duck_with("fx_nodes", _ND) + "SELECT ip, mac, name AS learned_from FROM nd")
def snmp_neighbours(spark, sf):
    return snmp.arp_hosts(*_walks(spark, sf)).select(
        "ip", "mac", F.col("extra")["learned_from"].alias("learned_from"))


@reg.query("snmp_links", duck_with("fx_nodes") +
           "SELECT name AS local, concat('peer-', id) AS remote, 'Gi0/3' AS local_port, 'eth1' AS remote_port FROM fx_nodes")
def snmp_links(spark, sf):
    return snmp.lldp_links(*_walks(spark, sf)).select("local", "remote", "local_port", "remote_port")


@reg.query("discovery_topology", duck_with("fx_nodes", _ND) + """SELECT CASE WHEN substr(mac, 2, 1) IN ('2', '3', '6', '7', 'a', 'b', 'e', 'f') THEN concat('n-ip-', replace(ip, '.', '-'))
 ELSE concat('n-', replace(mac, ':', '')) END AS id, name, ip, mac, CASE WHEN device_type = 'printer' THEN 'lldp,snmp,snmp:arp' ELSE 'arp,lldp,snmp,snmp:arp' END AS discovered_by,
 CASE WHEN device_type = 'printer' THEN 'eth7' ELSE 'eth0' END AS interface FROM nd""")
def discovery_topology(spark, sf):
    """Dumps of all collectors to devices: neighbour tables, then link-layer reports, then
    SNMP, the first that has an attribute deciding it."""
    n = inputs.nodes(spark, sf)
    lldp_hosts, _ = _lldp_reports(n)
    walks, hosts = _walks(spark, sf)
    seen = discovery.union_sightings(_neighbour_hosts(n), lldp_hosts, snmp.devices(walks, hosts),
                                     snmp.arp_hosts(walks, hosts))
    first = topology.merge_sightings(seen).select("ord", "interface")
    built = topology.build_nodes(seen).join(first, "ord")
    return built.select("id", "name", "ip", "mac", F.array_join("discovered_by", ",").alias("discovered_by"), "interface")


@reg.query("alert_decode", duck_with("fx_alerts") + """SELECT flow_id, src_ip, src_port, CAST(6 AS INTEGER) AS protocol, CASE WHEN event_type = 'error' THEN 0e0 ELSE score END AS score,
 CASE WHEN event_type = 'view' THEN -1e0 ELSE label END AS label FROM fx_alerts""")
def alert_decode(spark, sf):
    """Payloads of one alert or a batch, some lacking fields, some with unknown ones."""
    a = inputs.alerts(spark, sf)
    one = F.to_json(F.struct(
        "flow_id", "src_ip", F.col("src_port").cast("string").alias("src_port"),
        F.when(F.col("event_type") == "click", 0).otherwise(6).alias("protocol"),
        F.when(F.col("event_type") != "error", F.col("score")).alias("score"),
        F.when(F.col("event_type") != "view", F.col("label")).alias("label"),
        F.lit("extra").alias("colour")))
    batch = F.when(F.col("event_type") == "signup", F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    out = codec.decode_alerts(a.select(batch.alias("value")))
    return out.select("flow_id", "src_ip", "src_port", "protocol", "score", "label")


@reg.query("connection_schema", duck_with("fx_connections") + "SELECT " + ", ".join(
    c if c in ("flow_id", "src_ip", "dst_ip") else f"{sql6(c)} AS {c}" for c in CONNECTION_FIELDS) + " FROM fx_connections")
def connection_schema(spark, sf):
    rows = as_connections(inputs.connections(spark, sf))
    return rows.select(*[F.col(c) if c in ("flow_id", "src_ip", "dst_ip") else r6(c).alias(c)
                         for c in CONNECTION_FIELDS])


def _as_csv(spark, raw, label):
    """``raw`` as a folder of CSV files under two spellings of its heading, every text as it is."""
    folder = scratch_path(spark, label)
    odd = F.pmod(F.xxhash64(*raw.columns), F.lit(2)) == 1
    shouted = raw.filter(odd).toDF(*[f" {c.upper().replace('_', ' ')}" for c in raw.columns])
    for part in (raw.filter(~odd), shouted):
        part.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


@reg.query("unsw_adapter", f"""SELECT class, CAST(dense_rank() OVER (ORDER BY class) - 1 AS INTEGER) AS class_id, count(*) AS flows, {sql6('sum(iat_mean)')} AS iat_mean, {sql6('sum(iat_min)')} AS iat_min,
 {sql6('sum(size_std)')} AS pkt_size_std, {sql6('sum(syn)')} AS syn_count, {sql6('sum(proto)')} AS protocol, {sql6('sum(lab)')} AS label FROM (
 SELECT CASE WHEN l_returnflag = 'R' THEN 'Recon' WHEN l_returnflag = 'A' THEN 'DoS' ELSE 'Normal' END AS class, CASE WHEN l_discount > 0 THEN (l_quantity + l_discount * 100) / 1000 / 2 ELSE l_quantity / 1000 END AS iat_mean,
 least(l_quantity / 1000, CASE WHEN l_discount > 0 THEN l_discount * 100 / 1000 ELSE l_quantity / 1000 END) AS iat_min, abs(l_quantity - l_tax * 100) / 2 AS size_std,
 CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS syn, CASE WHEN l_linenumber > 3 THEN 6 ELSE 17 END AS proto, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS lab FROM lineitem) GROUP BY class""")
def unsw_adapter(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = lambda c: c.cast("string")
    raw = li.select(
        F.when(F.col("l_linenumber") > 3, "TCP").otherwise("udp").alias("proto"),
        text(F.col("l_quantity")).alias("sinpkt"), text(F.col("l_discount") * 100).alias("dinpkt"),
        text(F.col("l_quantity")).alias("smean"), text(F.col("l_tax") * 100).alias("dmean"),
        F.when(F.col("l_linestatus") == "F", "fin").otherwise("ACC").alias("state"),
        F.when(F.col("l_returnflag") == "R", " Recon ").when(F.col("l_returnflag") == "A", "DoS").alias("attack_cat"))
    out = datasets.load_unsw(spark, _as_csv(spark, raw, "unsw"))
    sums = ("iat_mean", "iat_min", "pkt_size_std", "syn_count", "protocol", "label")
    return out.groupBy("class", "class_id").agg(
        F.count(F.lit(1)).alias("flows"), *[r6(F.sum(c)).alias(c) for c in sums])


@reg.query("cic_adapter", f"""SELECT class, CAST(dense_rank() OVER (ORDER BY class) - 1 AS INTEGER) AS class_id, count(*) AS flows, {sql6('sum(d)')} AS duration, {sql6('sum(b)')} AS orig_bytes, {sql6('sum(CAST(lab AS DOUBLE))')} AS label,
 50000e0 AS src_port FROM (SELECT CASE WHEN l_returnflag = 'N' THEN 'benign' ELSE 'DDoS' END AS class, CASE WHEN l_linestatus = 'F' THEN 0e0 ELSE l_extendedprice / 1e6 END AS d,
 l_quantity AS b, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS lab FROM lineitem) GROUP BY class""")
def cic_adapter(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    raw = li.select(
        F.when(F.col("l_linestatus") == "F", "Infinity").otherwise(F.col("l_extendedprice").cast("string")).alias("flow_duration"),
        F.col("l_quantity").cast("string").alias("total_length_of_fwd_packets"),
        F.when(F.col("l_returnflag") == "N", " benign").otherwise("DDoS ").alias("label"))
    out = datasets.load_cic(spark, _as_csv(spark, raw, "cic"))
    return out.groupBy("class", "class_id").agg(
        F.count(F.lit(1)).alias("flows"), *[r6(F.sum(c)).alias(c) for c in ("duration", "orig_bytes", "label")],
        F.max("src_port").alias("src_port"))


@reg.query("zeek_adapter", duck_with("fx_connections") + f"""SELECT src_ip, count(*) AS flows, {sql6('sum(orig_bytes)')} AS orig_bytes, {sql6('sum(2 + rst_count)')} AS flags, {sql6('sum(protocol)')} AS protocol, {sql6('sum(duration)')} AS duration FROM fx_connections GROUP BY 1""")
def zeek_adapter(spark, sf):
    c = inputs.connections(spark, sf)
    text = {n: F.col(n).cast("string") for n in ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")}
    log = c.select(
        F.col("flow_id").alias("uid"), F.col("src_ip").alias("id.orig_h"), F.col("dst_ip").alias("id.resp_h"),
        F.col("src_port").cast("string").alias("id.orig_p"), F.col("dst_port").cast("string").alias("id.resp_p"),
        F.when(F.col("protocol") == 6, "tcp").otherwise("udp").alias("proto"), F.col("start_ts").cast("string").alias("ts"),
        *[v.alias(k) for k, v in text.items()],
        F.when(F.col("rst_count") > 0, "ShR").otherwise("Sh").alias("history"))
    out = datasets.zeek_connections(log)
    return out.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"), r6(F.sum("orig_bytes")).alias("orig_bytes"),
        r6(F.sum(F.col("syn_count") + F.col("rst_count"))).alias("flags"),
        r6(F.sum("protocol")).alias("protocol"), r6(F.sum("duration")).alias("duration"))


@reg.query("previous_topology", duck_with("fx_nodes", _ND) +
           "SELECT ip, mac, name AS hostname, 'previous' AS source, device_type AS device_type_hint FROM nd")
def previous_topology(spark, sf):
    n = inputs.nodes(spark, sf).withColumns({
        "ord": F.xxhash64("id"), "vendor": F.lit("unknown"), "os": F.lit(""),
        "services": F.array().cast("array<string>"), "discovered_by": F.array().cast("array<string>")})
    return topology_io.previous_as_observations(n).select(
        "ip", "mac", "hostname", "source", "device_type_hint")


# --- augmentation -----------------------------------------------------------------
@reg.query("drift_identity", duck_with("fx_connections") + "SELECT flow_id, orig_bytes, iat_max FROM fx_connections")
def drift_identity(spark, sf):
    return augment.drift(inputs.connections(spark, sf), 0.0).select("flow_id", "orig_bytes", "iat_max")


def unit_sql(seed: int) -> str:
    return f"((CAST(CAST(concat('0x', substr(sha256('{seed}:' || flow_id), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0)"


def normal_sql(column: str, seed: int = 7) -> str:
    """The column's normal draw, times its spread."""
    i = list(augment.DRIFT).index(column)
    u, v = unit_sql(seed + 10 * i), unit_sql(seed + 10 * i + 1)
    return f"(sqrt(-2e0 * ln({u})) * cos(2e0 * pi() * {v}) * {augment.DRIFT[column]!r}e0)"


def _drifted_sql(column: str, amount: float = 0.4) -> str:
    return f"({column} * exp({amount}e0 * {normal_sql(column)}))"


@reg.query("drift_augmented", duck_with("fx_connections") + f"""SELECT flow_id, {sql6(_drifted_sql('orig_bytes'))} AS orig_bytes,
 {sql6(f"{_drifted_sql('iat_mean')} + 3 * {_drifted_sql('iat_std')}")} AS iat_max FROM fx_connections""")
def drift_augmented(spark, sf):
    out = augment.drift(inputs.connections(spark, sf), 0.4)
    return out.select("flow_id", r6("orig_bytes").alias("orig_bytes"), r6("iat_max").alias("iat_max"))


@reg.query("invariants", duck_with("fx_connections", """i AS (SELECT *, greatest(round_even(orig_pkts, 0), 1e0) AS op, greatest(round_even(resp_pkts, 0), 0e0) AS rp FROM fx_connections)""",
    "j AS (SELECT *, op + rp AS n, greatest(orig_bytes, 40 * op) AS ob, greatest(resp_bytes, 40 * rp) AS rb FROM i)",
    "k AS (SELECT *, greatest(duration, 0e0) / greatest(n - 1, 1e0) AS im, least(greatest((ob + rb) / greatest(n, 1e0), 40e0), 1500e0) AS ms FROM j)") +
    f"""SELECT flow_id, op AS orig_pkts, {sql6('ob')} AS orig_bytes, {sql6('rb')} AS resp_bytes, CASE WHEN protocol = 6 THEN least(ack_count, n) ELSE 0e0 END AS ack_count,
 {sql6('im')} AS iat_mean, {sql6('greatest(im - 2 * iat_std, 0e0)')} AS iat_min, {sql6('ms')} AS pkt_size_mean, {sql6('least(greatest(ms - 1.8e0 * pkt_size_std, 40e0), 1500e0)')} AS pkt_size_min FROM k""")
def invariants(spark, sf):
    out = augment.restore_invariants(inputs.connections(spark, sf))
    names = ("orig_bytes", "resp_bytes", "iat_mean", "iat_min", "pkt_size_mean", "pkt_size_min")
    return out.select("flow_id", "orig_pkts", "ack_count", *[r6(n).alias(n) for n in names])


def mixed_sql(column: str) -> str:
    return f"exp((1 - w) * ln(greatest({column}, 1e-6)) + w * ln(greatest(p_{column}, 1e-6)))"


@reg.query("blend_opposite", duck_with(
    "fx_connections", """c AS (SELECT *, CASE WHEN label > 0.5 THEN 1 ELSE 0 END AS y FROM fx_connections WHERE label >= 0)""",
    f"""d AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY substr(sha256('11:' || flow_id), 1, 16), flow_id, start_ts, orig_bytes, payload_entropy, duration) AS no,
 (SELECT count(*) FROM c) - count(*) OVER (PARTITION BY y) AS m, {unit_sql(12)} AS pick, {unit_sql(13)} AS ask, 0.2e0 + 0.5e0 * {unit_sql(14)} AS w, {unit_sql(15)} AS take FROM c)""",
    """e AS (SELECT a.*, b.orig_bytes AS p_orig_bytes, b.orig_pkts AS p_orig_pkts, b.dst_port AS p_dst_port, b.flow_id IS NOT NULL AS hit
 FROM d a LEFT JOIN d b ON a.pick < 0.05e0 AND b.y = 1 - a.y AND b.no = floor(a.ask * a.m) + 1)""") + f"""SELECT flow_id, label,
 {sql6(f"CASE WHEN hit THEN greatest({mixed_sql('orig_bytes')}, 40 * greatest(round_even({mixed_sql('orig_pkts')}, 0), 1e0)) ELSE orig_bytes END")} AS orig_bytes,
 CASE WHEN hit AND take < w THEN p_dst_port ELSE dst_port END AS dst_port FROM e""")
def blend_opposite(spark, sf):
    labelled = inputs.connections(spark, sf).filter(F.col("label") >= 0)
    return augment.blend_opposite(labelled, 0.05).select("flow_id", "label", r6("orig_bytes").alias("orig_bytes"), "dst_port")


@reg.query("blend_fixed_weight", duck_with("fx_connections") + f"""SELECT flow_id, {sql6('exp(0.75e0 * ln(greatest(duration, 1e-6)) + 0.25e0 * ln(10e0))')} AS duration,
 {sql6('least(greatest(0.75e0 * payload_entropy + 0.25e0 * 2, 0e0), 4.5e0)')} AS payload_entropy, 17e0 AS protocol, 0e0 AS syn_count FROM fx_connections""")
def blend_fixed_weight(spark, sf):
    """Everything a quarter of the way toward one constant partner."""
    values = {n: F.lit(10.0) for n in augment.GEOMETRIC} | {"payload_entropy": F.lit(2.0)} | {
        n: F.lit(0.0) for n in augment.SWAPPED} | {"protocol": F.lit(17.0)}
    rows = inputs.connections(spark, sf).withColumn("p", F.struct(*[c.alias(n) for n, c in values.items()]))
    out = augment.blend_with(rows, F.lit(0.25), F.lit(True))
    return out.select("flow_id", r6("duration").alias("duration"),
                      r6("payload_entropy").alias("payload_entropy"), "protocol", "syn_count")


@reg.query("class_mix", duck_with("fx_alerts") + """SELECT flow_id, event_type AS class FROM (SELECT flow_id, event_type, row_number() OVER (PARTITION BY event_type
 ORDER BY substr(sha256('3:' || flow_id), 1, 16), flow_id) AS r FROM fx_alerts) WHERE r <= CASE event_type WHEN 'click' THEN 500 WHEN 'view' THEN 300 WHEN 'error' THEN 200 ELSE 0 END""")
def class_mix(spark, sf):
    mix = augment.normalised_mix({"click": 5, "view": 3, "error": 2}, ("click", "view", "error", "signup"))
    out = augment.resample_mix(inputs.alerts(spark, sf), "event_type", mix, 1000)
    return out.select("flow_id", F.col("event_type").alias("class"))


@reg.query("stratified_split", duck_with("fx_alerts") + """SELECT flow_id, label, row_number() OVER (PARTITION BY label
 ORDER BY substr(sha256('20240917:' || flow_id), 1, 16), flow_id) <= floor(count(*) OVER (PARTITION BY label) * 0.75e0) AS is_train FROM fx_alerts""")
def stratified_split(spark, sf):
    out = augment.stratified_split(inputs.alerts(spark, sf))
    return out.select("flow_id", "label", "is_train")
