import random

import pytest
from pyspark.sql import functions as F

from netlumen.operators import layout, topology
from netlumen.sources import alerts, datasets, lldp, neighbours, oui, snmp, topology_io


def dumps(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, "me") for i, t in enumerate(texts)], "dump string, text string, local_name string")


def test_neighbour_formats(spark):
    text = """? (10.0.0.1) at 0:1b:54:11:22:33 on en0 ifscope [ethernet]
gw (10.0.0.2) at 00:1b:54:11:22:34 [ether] on eth0
? (10.0.0.3) at (incomplete) on en0
10.0.0.4 dev eth1 lladdr 00:1b:54:11:22:36 REACHABLE
10.0.0.5 dev eth1 lladdr 00:1b:54:11:22:37 FAILED
10.0.0.6 dev eth1  INCOMPLETE
fe80::1 dev eth1 lladdr 00:1b:54:11:22:38 router STALE
IP address       HW type     Flags       HW address            Mask     Device
10.0.0.7         0x1         0x2         00:1b:54:11:22:39     *        eth2
10.0.0.8         0x1         0x0         00:00:00:00:00:00     *        eth2
10.0.0.4 dev eth9 lladdr 00:1b:54:11:22:36 STALE
nonsense here
"""
    got = sorted((r.ip, r.mac[-2:], r.hostname, r.interface) for r in neighbours.parse_neighbours(dumps(spark, text)).collect())
    assert got == [("10.0.0.1", "33", "", "en0"), ("10.0.0.2", "34", "gw", "eth0"), ("10.0.0.4", "36", "", "eth1"),
                   ("10.0.0.7", "39", "", "eth2"), ("fe80::1", "38", "", "eth1")]


def test_neighbours_from_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"? (10.0.{i}.1) at 00:1b:54:11:22:3{i} on en0\n")
    assert neighbours.parse_neighbours(neighbours.read_dumps(spark, str(tmp_path))).count() == 3


def test_lldp_shapes(spark):
    listed = '{"lldp":{"interface":[{"name":"eth0","chassis":[{"id":[{"type":"mac","value":"00:1b:54:00:00:01"}],"name":[{"value":"core"}],"capability":[{"type":"Bridge","enabled":true},{"type":"Router","enabled":false}]}],"port":[{"id":[{"value":"gi1"}]}]}]}}'
    keyed = '{"lldp":{"interface":{"eth0":{"chassis":{"name":"edge","id":{"type":"mac","value":"00:1b:54:00:00:02"},"mgmt-ip":"10.0.0.9"},"port":{"descr":"up"}}}}}'
    named = '{"interface":[{"eth1":{"chassis":{"deep":{"id":"00:1b:54:00:00:03","descr":"x"}}}}]}'
    hosts, links = lldp.parse_json(dumps(spark, listed, keyed, named, "{}"))
    got = {r.hostname: r for r in hosts.collect()}
    assert set(got) == {"core", "edge", "deep"}
    assert got["core"].device_type_hint == "switch" and got["edge"].ip == "10.0.0.9" and got["deep"].interface == "eth1"
    ports = {r.remote: (r.local_port, r.remote_port) for r in links.collect()}
    assert ports == {"core": ("eth0", "gi1"), "edge": ("eth0", "up"), "deep": ("eth1", "")}


def test_lldp_text(spark):
    text = """-----
Interface:    eth0, via: LLDP, RID: 1, Time: 0 day, 00:01:00
  Chassis:
    ChassisID:    mac 00:1b:54:aa:bb:cc
    SysName:      sw-1
    SysDescr:     Cisco: IOS
    MgmtIP:       10.0.0.2
    MgmtIP:       fe80::2
    Capability:   Bridge, on
    Capability:   Router, off
  Port:
    PortID:       ifname Gi1/0/1
-----
Interface:    eth1, via: CDP
  Chassis:
    ChassisID:    local nobody
"""
    hosts, links = lldp.parse_text(dumps(spark, text))
    h = hosts.collect()
    assert len(h) == 1 and (h[0].hostname, h[0].ip, h[0].mac, h[0].device_type_hint, h[0].os_hint) == (
        "sw-1", "10.0.0.2", "00:1b:54:aa:bb:cc", "switch", "Cisco: IOS")
    assert links.first().remote_port == "Gi1/0/1"


def test_snmp_walk(spark):
    text = """SNMPv2-MIB::sysName.0 = STRING: core-1
.1.3.6.1.2.1.1.1.0 = STRING: "Juniper JUNOS box"
SNMPv2-MIB::sysObjectID.0 = OID: .1.3.6.1.4.1.2636.1
SNMPv2-MIB::sysContact.0 = No Such Object available on this agent at this OID
IF-MIB::ifDescr.2 = STRING: two
IF-MIB::ifPhysAddress.1 = STRING: 0:0:0:0:0:0
IF-MIB::ifPhysAddress.2 = STRING: 0:1b:54:1:2:3
IP-MIB::ipNetToMediaPhysAddress.2.10.0.0.9 = STRING: 00 1b 54 01 02 04
IP-MIB::ipNetToMediaPhysAddress.2.10.0.0.8 = STRING: 0:0:0:0:0:0
LLDP-MIB::lldpRemSysName.0.2.1 = STRING: other
LLDP-MIB::lldpRemPortId.0.2.1 = STRING: p9
not a line
"""
    walks = snmp.parse_walks(dumps(spark, text))
    assert walks.filter("name = 'sysDescr'").first().value == "Juniper JUNOS box"
    assert walks.filter("name = 'sysContact'").count() == 0
    hosts = spark.createDataFrame([("d0", "10.0.0.1")], "dump string, host_ip string")
    d = snmp.devices(walks, hosts).first()
    assert (d.hostname, d.mac, d.device_type_hint, d.vendor_hint) == ("core-1", "00:1b:54:01:02:03", "router", "Juniper")
    assert [(r.ip, r.mac) for r in snmp.arp_hosts(walks, hosts).collect()] == [("10.0.0.9", "00:1b:54:01:02:04")]
    link = snmp.lldp_links(walks, hosts).first()
    assert (link.local, link.remote, link.local_port, link.remote_port) == ("core-1", "other", "two", "p9")


def test_oui_registry(spark, tmp_path):
    (tmp_path / "oui.csv").write_text('Registry,Assignment,Organization Name\nMA-L,00000c,New Cisco\nMA-L,ABC,short\n')
    (tmp_path / "manuf").write_text("# comment\n00:1B:54\tCsc\tCisco Systems\nAA:BB:CC:00/28 Tiny\n\n")
    table = oui.registry(oui.builtin(spark), oui.read_csv(spark, str(tmp_path / "oui.csv")), oui.read_manuf(spark, str(tmp_path / "manuf")))
    got = {r.oui: r.vendor for r in table.collect()}
    assert got["00000C"] == "New Cisco" and got["001B54"] == "Csc" and got["AABBCC0"] == "Tiny" and "AABBCC" not in got and got["B827EB"] == "RaspberryPi"
    macs = spark.createDataFrame([("aa:bb:cc:01:02:03",), ("aa:bb:cc:f1:02:03",), ("00:1b:54:00:00:00",), (None,)], "mac string")
    wide = table.union(spark.createDataFrame([("AABBCC", "Wide")], "oui string, vendor string"))
    assert {r.mac: r.vendor for r in oui.with_vendor(macs, wide).collect()} == {
        "aa:bb:cc:01:02:03": "Tiny", "aa:bb:cc:f1:02:03": "Wide", "00:1b:54:00:00:00": "Csc", None: "unknown"}


def brute_identity(rows):
    """One sighting at a time: (mac, ip, host) -> key, in order."""
    merged, names, out = set(), {}, []
    for mac, ip, host in rows:
        key = f"mac:{mac}" if mac else f"ip:{ip}" if ip else f"host:{host.lower()}"
        h = host.strip().lower()
        if key not in merged and h and h in names:
            key = names[h]
        merged.add(key)
        if h:
            names.setdefault(h, key)
        out.append(key)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_identity_equals_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    macs = [f"00:1b:54:00:00:0{i}" for i in range(4)]
    rows = [(rng.choice([None, *macs]), rng.choice([None, "10.0.0.1", "10.0.0.2", "10.0.0.3"]), rng.choice(["", "", "Alpha", "beta ", "gamma"]))
            for _ in range(120)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, mac string, ip string, hostname string")
    got = [r.identity for r in topology.identify(topology.observations(df)).orderBy("ord").collect()]
    assert got == brute_identity(rows)


def test_nodes_merge_sources(spark):
    rows = [(1, "10.0.0.2", "00:1b:54:00:00:01", "", "arp", "", []), (2, None, "001b.5400.0001", "core-sw", "snmp", "switch", ["ssh"]),
            (3, "10.0.0.3", None, "CORE-SW", "lldp", "", ["http", "ssh"]), (4, "10.0.0.9", "02:00:00:00:00:09", "", "arp", "", [])]
    df = spark.createDataFrame(rows, "ord long, ip string, mac string, hostname string, source string, device_type_hint string, services array<string>")
    n = {r.id: r for r in topology.build_nodes(df).collect()}
    sw = n["n-001b54000001"]
    assert (sw.name, sw.device_type, sw.vendor, sw.ips, sw.services, sw.discovered_by) == (
        "core-sw", "switch", "Cisco", ["10.0.0.2", "10.0.0.3"], ["ssh", "http"], ["arp", "lldp", "snmp"])
    assert sw.tags == ["infrastructure"] and n["n-ip-10-0-0-9"].tags == ["randomized-mac"]


def test_topology_round_trip_and_layout(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("r", "r", "10.0.0.1", "router", "10.0.0.0/24", 0), ("s", "s", "10.0.0.2", "switch", "10.0.0.0/24", 1), ("s2", "s2", None, "switch", "10.0.1.0/24", 2),
         ("s3", "s3", None, "switch", "10.0.1.0/24", 3), *[(f"h{i}", f"h{i}", f"10.0.0.{9 + i}", "server", "10.0.0.0/24", 4 + i) for i in range(9)]],
        "id string, name string, ip string, device_type string, subnet string, ord long")
    none = spark.createDataFrame([("s", "S2", "uplink"), ("s3", "s", "uplink"), ("r", "s", "uplink"), ("S", "s3", "wireless")], "local string, remote string, kind string")
    sightings = none.select(F.monotonically_increasing_id().alias("ord"), "*", F.lit(None).cast("string").alias("local_mac"), F.lit(None).cast("string").alias("remote_mac"),
                            F.lit("lldp").alias("source"), F.lit(None).cast("int").alias("bandwidth_mbps"))
    links = topology.build_links(sightings, nodes)
    assert links.filter("kind = 'uplink'").count() == 3 and links.filter("kind = 'inferred'").count() == 9
    a = layout.compute_layout(nodes, links).orderBy("id").collect()
    b = layout.compute_layout(nodes.repartition(5), links).orderBy("id").collect()
    assert a == b
    at = {r.id: r for r in a}
    assert at["s"].layer == 2 and at["s2"].layer == 1 and at["r"].layer == 3 and at["h1"].layer == 0
    box = layout.bounds(spark.createDataFrame(a)).first()
    assert box.max_y >= 30 and box.radius > 0
    topology_io.write_topology(layout.compute_layout(nodes, links), links, str(tmp_path / "t"), 3)
    n2, l2, head = topology_io.read_topology(spark, str(tmp_path / "t"))
    assert n2.count() == 13 and l2.count() == links.count() and topology_io.next_version(head).first()["version"] == 4
    assert {r.id: r.x for r in n2.collect()} == {r.id: r.x for r in a}


def test_snapshot_document(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"version": 2, "generated_at": 1.5, "source": "x",\n "nodes": [{"id": "a", "name": "A", "position": {"x": 1.0, "y": 2.0, "z": 3.0}, "discovered_by": ["arp"]}],\n "links": [{"id": "l", "source": "a", "target": "b", "kind": "ethernet"}]}')
    nodes, links, head = topology_io.read_snapshot(spark, str(tmp_path / "t.json"))
    assert nodes.first().x == 1.0 and links.first().target == "b" and head.first().version == 2
    again = topology_io.previous_as_observations(nodes.withColumns({"services": F.array().cast("array<string>")})).first()
    assert again.hostname == "A" and again.source == "arp"


def test_alert_payloads(spark):
    rows = [('{"flow_id":"a","score":"0.5","protocol":0,"new_key":{"x":1}}',), ('[{"flow_id":"b"},{"src_port":"x"}]',), ("{}",), ("not json",)]
    out = alerts.decode_alerts(spark.createDataFrame(rows, "value string")).collect()
    assert sorted(r.flow_id for r in out)[:2] == ["", ""] and len(out) == 4 + (len(out) == 5)
    a = next(r for r in out if r.flow_id == "a")
    assert a.score == 0.5 and a.protocol == 6 and a.label == -1.0 and a.dst_port == 0


def test_unsw_files(spark, tmp_path):
    (tmp_path / "UNSW_1.csv").write_text(" Proto ,sport,dsport,dur,sbytes,dbytes,spkts,dpkts,Sinpkt,dinpkt,smean,dmean,state,service,attack_cat,label\n"
                                         "tcp,1000,80,1.5,100,200,2,3,10,30,50,70,FIN,http,,0\n")
    (tmp_path / "UNSW_2.csv").write_text("proto,sport,dsport,dur,sbytes,dbytes,spkts,dpkts,sinpkt,dinpkt,smean,dmean,state,service,attack_cat,label\n"
                                         "UDP,2000,53,,100,0,2,0,10,0,50,0,INT,ssl, Exploits ,1\n")
    rows = {r["class"]: r for r in datasets.load_dataset(spark, "UNSW", str(tmp_path)).collect()}
    n, e = rows["Normal"], rows["Exploits"]
    assert n.protocol == 6 and n.iat_mean == pytest.approx(0.02) and n.iat_min == pytest.approx(0.01) and n.fin_count == 1 and n.http_present == 1
    assert e.protocol == 17 and e.duration == 0 and e.iat_mean == pytest.approx(0.01) and e.tls_present == 1 and e.label == 1
    assert (e.class_id, n.class_id) == (0, 1)


def test_cic_files(spark, tmp_path):
    (tmp_path / "day.pcap_ISCX.csv").write_bytes((" Destination Port, Flow Duration, Total Fwd Packets,Flow IAT Mean, SYN Flag Count, Label\n"
                                                  "443,2000000,4,Infinity,1,BENIGN\n80,NaN,x,1000,0,Web Attack \x96 XSS\n").encode("latin-1"))
    rows = sorted(datasets.load_dataset(spark, "cic", str(tmp_path)).collect(), key=lambda r: r.dst_port)
    bad, good = rows
    assert good.duration == 2.0 and good.iat_mean == 0 and good.syn_count == 1 and good.label == 0 and good.src_port == 50000 and good.protocol == 6
    assert bad.duration == 0 and bad.orig_pkts == 0 and bad.label == 1 and "\x96" in bad["class"]
    with pytest.raises(ValueError):
        datasets.cic_connections(spark.createDataFrame([("1",)], "flow_duration string"))


def test_dataset_dispatch_errors(spark, tmp_path):
    for kind, path in (("nope", "x"), ("unsw", None)):
        with pytest.raises(ValueError):
            datasets.load_dataset(spark, kind, path)
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, "cic", str(tmp_path))
    (tmp_path / "UNSW-a.csv").write_text("proto\ntcp\n")
    assert len(datasets.find_files(spark, str(tmp_path), ("UNSW*.csv", "*.csv"))) == 1


def test_zeek_log(spark, tmp_path):
    (tmp_path / "conn.log").write_text('{"uid":"C1","id.orig_h":"10.0.0.1","id.orig_p":5000,"id.resp_h":"10.0.0.2","id.resp_p":443,"proto":"tcp","ts":10.5,"duration":2.0,"orig_bytes":5,"history":"ShADadFfR"}\n')
    (tmp_path / "ssl.log").write_text('{"uid":"C1","server_name":"example.com"}\n')
    r = datasets.read_zeek(spark, str(tmp_path / "conn.log"), str(tmp_path / "ssl.log")).first()
    assert (r.syn_count, r.ack_count, r.fin_count, r.rst_count, r.tls_sni_len, r.emit_ts, r.resp_bytes) == (2, 3, 2, 1, 11, 12.5, 0)


def test_sightings_to_placed_topology(spark, tmp_path):
    from netlumen.plans.discovery import build_topology

    arp = neighbours.parse_neighbours(dumps(spark, "? (10.0.0.2) at 00:1b:54:00:00:01 on e0\n? (10.0.0.5) at 00:1c:23:00:00:05 on e0\n"))
    hosts, links = lldp.parse_json(dumps(spark, '{"lldp":{"interface":{"eth0":{"chassis":{"name":"sw","id":{"type":"mac","value":"00:1b:54:00:00:01"},"capability":{"type":"Bridge","enabled":true}}}}}}'))
    me = spark.createDataFrame([(1, "10.0.0.7", "00:1c:23:00:00:07", "me", "local")], "ord long, ip string, mac string, hostname string, source string")
    nodes, edges = build_topology(arp.unionByName(hosts).unionByName(topology.observations(me)), links)
    got = {r.name: r for r in nodes.collect()}
    assert set(got) == {"sw", "10.0.0.5", "me"} and got["sw"].layer == 1 and got["sw"].ip == "10.0.0.2"
    kinds = sorted((r.kind, r.discovered_by[0]) for r in edges.collect())
    assert kinds == [("ethernet", "lldp"), ("inferred", "inference:subnet")]
    again, _ = build_topology(topology.observations(me), links, previous=nodes)
    assert {r.id for r in again.collect()} == {r.id for r in got.values()}


def test_dumps_are_dealt_by_their_text(spark, monkeypatch):
    """However few files hold them, dumps go to as many tasks as their text asks for, and
    groupings by dump move nothing again."""
    from netlumen.sources import lldp, neighbours, snmp

    walk = "SNMPv2-MIB::sysName.0 = STRING: a\nSNMPv2-MIB::sysName.0 = STRING: b\n"
    dumps = spark.createDataFrame([(f"d{i}", walk, "p") for i in range(40)], "dump string, text string, local_name string").coalesce(1)
    monkeypatch.setattr(neighbours, "TEXT_BYTES", 10 * len(walk))
    assert neighbours.dealt(dumps).rdd.getNumPartitions() == 4
    walks = snmp.parse_walks(dumps)
    assert sorted(map(tuple, walks.collect())) == sorted((f"d{i}", "sysName", "0", "b", 0) for i in range(40))
    for out in (walks.groupBy("dump").count(), lldp.parse_json(dumps)[0]):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
