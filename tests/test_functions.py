import math

import pytest
from pyspark.sql import functions as F

from netlumen.functions import devices, net
from netlumen.functions.features import FEATURE_NAMES, extract_features
from netlumen.functions.severity import severity_of, severity_rank
from netlumen.schemas import CONNECTION_FIELDS, CONNECTION_NUMERIC, SchemaMismatch, as_connections, fill_partial


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("ip,want", [
    ("10.1.2.3", True), ("172.31.255.255", True), ("172.32.0.0", False), ("192.168.0.1", True),
    ("100.64.0.1", True), ("100.128.0.1", False), ("169.254.9.9", True), ("8.8.8.8", False),
    ("fe80::1", True), ("fd12::1", True), ("2001:db8::1", False), ("", False), ("x", False),
    ("256.1.1.1", False), ("010.1.1.1", False)])
def test_internal(spark, ip, want):
    assert one(spark, ip, net.is_internal) is want


@pytest.mark.parametrize("ip,prefix,want", [
    ("10.1.2.3", 24, "10.1.2.0/24"), ("10.1.250.3", 20, "10.1.240.0/20"),
    ("2001:db8:0:1:9::5", 24, "2001:db8:0:1::/64"), ("2001:db8::5", 24, "2001:db8::/64"),
    ("::1", 24, "::/64"), ("fe80::1%eth0", 24, "fe80::/64"), ("", 24, "unknown"), ("nope", 24, "unknown"),
    ("1::2::3", 24, "unknown")])
def test_subnet(spark, ip, prefix, want):
    assert one(spark, ip, lambda c: net.subnet_of(c, prefix)) == want


def test_ipv6_digits(spark):
    assert one(spark, "::ffff:10.0.0.1", net.ipv6_hex) == "0" * 20 + "ffff0a000001"
    assert one(spark, "1:2:3:4:5:6:7:8", net.ipv6_hex) == "00010002000300040005000600070008"
    assert one(spark, "1:2:3:4:5:6:7", net.ipv6_hex) is None


@pytest.mark.parametrize("mac,want", [
    ("0:1c:23:4:56:78", "00:1c:23:04:56:78"), ("00-1C-23-04-56-78", "00:1c:23:04:56:78"),
    ("001c.2304.5678", "00:1c:23:04:56:78"), ("001C23045678", "00:1c:23:04:56:78"),
    ("zz", None), ("0:1c:23:4:56", None), ("", None)])
def test_mac(spark, mac, want):
    assert one(spark, mac, net.normalize_mac) == want


def test_local_mac(spark):
    assert one(spark, "02:00:00:00:00:01", net.is_locally_administered) is True
    assert one(spark, "00:1b:54:00:00:01", net.is_locally_administered) is False
    assert one(spark, "?", net.is_locally_administered) is False
    assert one(spark, "00:1b:54:00:00:01", net.oui_of) == "001B54"


def test_pseudonyms_keep_shape_and_identity(spark):
    v4 = one(spark, "10.0.0.1", lambda c: net.pseudonymise_ip(c, "s"))
    assert v4.startswith("100.64.") and v4 == one(spark, "10.0.0.1", lambda c: net.pseudonymise_ip(c, "s"))
    assert v4 != one(spark, "10.0.0.1", lambda c: net.pseudonymise_ip(c, "t"))
    assert one(spark, "fe80::1", lambda c: net.pseudonymise_ip(c, "s")).startswith("100::")


def hello(name: bytes, pad: bytes = b"") -> bytes:
    sni = b"\x00\x00" + (len(name) + 5).to_bytes(2, "big") + (len(name) + 3).to_bytes(2, "big") + b"\x00" + len(name).to_bytes(2, "big") + name
    ext = pad + sni
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + len(ext).to_bytes(2, "big") + ext
    return b"\x16\x03\x01" + (len(body) + 4).to_bytes(2, "big") + b"\x01" + len(body).to_bytes(3, "big") + body


def test_payload_helpers(spark):
    other = b"\x00\x0b\x00\x02\x01\x00"
    rows = [(1, bytearray(hello(b"example.com"))), (2, bytearray(hello(b"a.bc", other))),
            (3, bytearray(b"GET / HTTP/1.1")), (4, bytearray(b"")), (5, bytearray(hello(b"x" * 9)[:70])),
            (6, bytearray(b"\x16" + bytes(60)))]
    out = {r.id: r for r in net.enrich_packets(spark.createDataFrame(rows, "id int, payload binary")).collect()}
    assert [out[i].tls_sni_len for i in (1, 2, 3, 4, 6)] == [11, 4, 0, 0, 0]
    assert [out[i].is_http_request for i in (1, 3, 4)] == [False, True, False]
    assert out[4].payload_entropy == 0.0 and out[3].payload_entropy > 2


@pytest.mark.parametrize("score,want", [(0.95, "critical"), (0.9499, "high"), (0.8, "high"), (0.55, "medium"),
                                        (0.3, "low"), (0.29, "info")])
def test_severity(spark, score, want):
    assert one(spark, score, severity_of, "double") == want


def test_ranks(spark):
    got = [one(spark, s, severity_rank) for s in ("none", "info", "low", "medium", "high", "critical")]
    assert got == [0, 1, 2, 3, 4, 5]


def record(**kw):
    base = {n: 0.0 for n in CONNECTION_NUMERIC} | {"flow_id": "f", "src_ip": "a", "dst_ip": "b"}
    return tuple((base | kw)[n] for n in CONNECTION_FIELDS)


def features(spark, *records):
    schema = ", ".join(f"{n} {'string' if n in ('flow_id', 'src_ip', 'dst_ip') else 'double'}" for n in CONNECTION_FIELDS)
    return [r.asDict() for r in extract_features(spark.createDataFrame(list(records), schema), ()).collect()]


def test_features_known_values(spark):
    f = features(spark, record(duration=2.0, orig_bytes=1000.0, resp_bytes=3000.0, orig_pkts=4.0, resp_pkts=6.0,
                               syn_count=2.0, dst_port=443.0, src_port=50000.0, protocol=6.0, iat_mean=0.2,
                               iat_std=0.1, pkt_size_min=40.0, pkt_size_max=1500.0, tls_sni_len=11.0, tls_present=1.0))[0]
    assert len(f) == 47 and tuple(f) == FEATURE_NAMES
    assert math.isclose(f["log_total_bytes"], math.log1p(4000)) and f["bytes_per_pkt"] == 400
    assert math.isclose(f["log_bytes_per_sec"], math.log1p(2000)) and f["syn_rate"] == 0.2
    assert f["is_https_port"] == 1 and f["dst_port_wellknown"] == 1 and f["src_port_ephemeral"] == 1
    assert math.isclose(f["iat_cv"], 0.1 / (0.2 + 1e-9)) and f["pkt_size_range"] == 1460
    assert math.isclose(f["resp_orig_byte_ratio"], 3000 / 1001)


def test_features_survive_bad_input(spark):
    nan, inf = float("nan"), float("inf")
    zero, bad, clipped = features(spark, record(), record(dst_port=nan, iat_mean=nan, iat_std=inf, orig_bytes=inf, payload_entropy=-inf),
                                  record(dst_port=70000.0, src_port=-5.0, duration=-1.0))
    assert all(math.isfinite(v) for v in zero.values()) and zero["bytes_per_pkt"] == 0
    assert all(math.isfinite(v) for v in bad.values()) and bad["dst_port_ephemeral"] == 0 and bad["iat_cv"] == 0
    assert math.isclose(clipped["log_dst_port"], math.log1p(65535)) and clipped["duration"] == 0


def test_label_does_not_leak(spark):
    a, b = features(spark, record(label=0.0, orig_bytes=5.0), record(label=1.0, orig_bytes=5.0))
    assert a == b


def test_schema_is_enforced(spark):
    with pytest.raises(SchemaMismatch):
        as_connections(spark.createDataFrame([("x",)], "flow_id string"))
    row = fill_partial(spark.createDataFrame([("x", 3)], "flow_id string, src_port int")).first()
    assert row.src_port == 3.0 and row.dst_ip == "" and row.duration == 0.0


def test_device_types(spark):
    def kind(hint, os_hint, host, vendor):
        df = spark.createDataFrame([(hint, os_hint, host, vendor)], "a string, b string, c string, d string")
        return df.select(devices.device_type(*[F.col(c) for c in "abcd"]).alias("r")).first()["r"]

    assert kind("Router ", "", "", "") == "router"
    assert kind("unknown", "linux server", "", "Cisco") == "unknown"
    assert kind("gadget", "", "core-sw-1", "") == "switch"
    assert kind("", "", "edge-fw", "") == "firewall"
    assert kind("", None, None, "Espressif") == "iot"
    assert kind("", "", "", "nobody") == "unknown"


def test_snmp_types_and_vendors(spark):
    def kind(descr, services):
        df = spark.createDataFrame([(descr, services)], "a string, b string")
        return df.select(devices.snmp_device_type(F.col("a"), F.col("b")).alias("r")).first()["r"]

    assert kind("Cisco Catalyst router", None) == "switch" and kind("Linux box", "6") == "server"
    assert kind("", "6") == "switch" and kind("", "4") == "router" and kind("", "72") == "server"
    assert kind(None, "abc") == "unknown"
    assert one(spark, ".1.3.6.1.4.1.9.1.1208", devices.enterprise_vendor) == "Cisco"
    assert one(spark, "enterprises.2636.1", devices.enterprise_vendor) == "Juniper"
    assert one(spark, "1.2.3", devices.enterprise_vendor) == ""
