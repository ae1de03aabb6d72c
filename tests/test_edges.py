"""Rows that the catalogue's data does not have: equal places, missing labels, crowded windows."""

from pyspark.sql import functions as F

from netlumen.operators import topology
from netlumen.operators.scan import in_window
from netlumen.plans import discovery
from netlumen.sources import datasets


def test_links_with_equal_places_keep_their_ends(spark):
    nodes = spark.createDataFrame(
        [(f"n{x}", x, f"10.0.0.{i}", i) for i, x in enumerate("abcd")], "id string, name string, ip string, ord long")
    links = spark.createDataFrame(
        [(0, "a", "b", None, None), (0, "c", "d", None, None), (0, "a", "nobody", None, None)],
        "ord long, local string, remote string, local_mac string, remote_mac string")
    got = {(r.local, r.remote): (r.local_id, r.remote_id) for r in topology.resolve_endpoints(links, nodes).collect()}
    assert got == {("a", "b"): ("na", "nb"), ("c", "d"): ("nc", "nd"), ("a", "nobody"): ("na", None)}


def test_sightings_are_numbered_by_source_first(spark):
    schema = "ord long, ip string, hostname string"
    arp = topology.observations(spark.createDataFrame([(7, "10.0.0.1", "x"), (7, "10.0.0.2", "y"), (9, "10.0.0.3", "z")], schema))
    snmp = topology.observations(spark.createDataFrame([(0, "10.0.0.1", "late"), (7, "10.0.0.4", "w")], schema))
    rows = discovery.union_sightings(arp, snmp).orderBy("ord").collect()
    assert [r.ord for r in rows] == [1, 2, 3, 4, 5]
    assert [r.hostname for r in rows[2:]] == ["z", "late", "w"]


def test_cic_rows_without_label_and_with_bad_cells(spark):
    df = spark.createDataFrame(
        [("BENIGN", "80", "tcp?"), (None, "1e3", "6"), ("DoS", "text", None), ("DoS", "Infinity", "NaN")],
        "label string, source_port string, protocol string")
    got = sorted((r["class"], r.class_id, r.label, r.src_port, r.protocol) for r in datasets.cic_connections(df).collect())
    assert got == [("0.0", 0, 1.0, 1000.0, 6.0), ("BENIGN", 1, 0.0, 80.0, 6.0), ("DoS", 2, 1.0, 0.0, 0.0), ("DoS", 2, 1.0, 50000.0, 0.0)]


def test_unsw_without_categories_has_fixed_ids(spark):
    df = spark.createDataFrame([("1",), ("0",)], "label string")
    assert sorted((r["class"], r.class_id) for r in datasets.unsw_connections(df).collect()) == [("attack", 1), ("normal", 0)]
    attacks = datasets.unsw_connections(df.filter("label = '1'")).collect()
    assert [(r["class"], r.class_id) for r in attacks] == [("attack", 1)]


def test_csv_files_by_heading(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"a{i}.csv").write_text(f" Source Port,Label\n{i},BENIGN\n")
    (tmp_path / "b.csv").write_text("Label,Flow/Duration\nDoS,7\n")
    df = datasets.read_csvs(spark, datasets.find_files(spark, str(tmp_path), ("*.csv",)))
    assert df.count() == 5 and set(df.columns) == {"source_port", "label", "flow_duration"}
    assert len(df._jdf.queryExecution().optimizedPlan().collectLeaves().toString().split("Relation")) == 3


def test_zeek_tab_separated(spark, tmp_path):
    names = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "history"]
    row = ["100.5", "C1", "10.0.0.1", "1234", "10.0.0.2", "443", "tcp", "2.0", "10", "-", "ShADF"]
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\t" + "\t".join(names) + "\n#types\tx\n" + "\t".join(row) + "\n#close\n")
    (tmp_path / "ssl.log").write_text('{"uid": "C1", "server_name": "abc.example"}\n')
    r = datasets.read_zeek(spark, str(tmp_path / "conn.log"), str(tmp_path / "ssl.log")).first()
    assert (r.flow_id, r.src_ip, r.dst_port, r.protocol, r.duration, r.orig_bytes, r.tls_sni_len) == (
        "C1", "10.0.0.1", 443.0, 6.0, 2.0, 10.0, 11.0)


def test_window_counts_on_a_crowded_key(spark):
    times = sorted([float(i % 37) for i in range(400)] + [1000.0, 1005.0])
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, ts double, i long")
    got = {r.i: (r.n, r.first) for r in in_window(df, ["key"], "ts", 5.0, "n", "first").collect()}
    want = {i: (sum(t - 5 <= x <= t for x in times), min(x for x in times if t - 5 <= x <= t)) for i, t in enumerate(times)}
    assert got == want
    plan = in_window(df, ["key"], "ts", 5.0, "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "PRECEDING" not in plan.upper() or "-5.0" not in plan


def test_scored_features(spark):
    from netlumen.functions.features import linear_score

    row = spark.range(1).select(F.lit(2.0).alias("a"), F.lit(1.0).alias("b")).select(linear_score({"a": 1.0, "b": -2.0}, 0.0).alias("s")).first()
    assert row.s == 0.5
