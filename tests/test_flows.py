import random

import pytest
from pyspark.sql import functions as F

from netlumen.functions.features import extract_features
from netlumen.operators import flows
from netlumen.plans import inputs
from netlumen.plans.catalog_flows import MERGE_ORDER
from netlumen.plans.registry import r6, r6_plain
from netlumen.schemas import PACKET

BASE = 1_700_000_000.0
FIN, SYN, RST, ACK = 1, 2, 4, 16
A, B = ("10.0.0.1", 5000), ("10.0.0.2", 80)


def packets(spark, rows):
    """rows: (ts offset, from_a, length, flags)"""
    data = []
    for i, (ts, from_a, length, flags) in enumerate(rows):
        s, d = (A, B) if from_a else (B, A)
        data.append((i, BASE + ts, s[0], d[0], s[1], d[1], 6, length, flags, 0, False))
    return spark.createDataFrame(data, PACKET)


def segments(spark, rows, **kw):
    out = flows.segments(packets(spark, rows), flows.Timeouts(**kw)).orderBy("event_id").collect()
    return [r.segment for r in out]


def test_both_directions_are_one_flow(spark):
    rec = flows.flow_records(flows.segments(packets(
        spark, [(0, True, 60, SYN), (0.01, False, 60, SYN | ACK), (0.02, True, 500, ACK), (0.03, False, 1500, ACK)]))).collect()
    assert len(rec) == 1
    r = rec[0]
    assert (r.src_ip, r.dst_port, r.orig_pkts, r.resp_pkts, r.orig_bytes, r.resp_bytes) == ("10.0.0.1", 80.0, 2, 2, 560, 1560)
    assert r.syn_count == 2 and r.ack_count == 3 and abs(r.duration - 0.03) < 1e-6
    assert abs(r.iat_mean - 0.01) < 1e-6 and r.pkt_size_max == 1500


def test_rst_closes(spark):
    assert segments(spark, [(0, True, 60, SYN), (1, False, 60, RST), (2, True, 60, SYN)]) == [1, 1, 2]


def test_one_fin_does_not_close_two_do(spark):
    assert segments(spark, [(0, True, 60, SYN), (1, True, 60, FIN), (2, True, 60, ACK)]) == [1, 1, 1]
    assert segments(spark, [(0, True, 60, SYN), (1, True, 60, FIN), (2, False, 60, FIN), (3, True, 60, ACK)]) == [1, 1, 1, 2]


def test_idle_and_active_timeouts(spark):
    assert segments(spark, [(0, True, 60, ACK), (14.9, True, 60, ACK), (29.9, True, 60, ACK)]) == [1, 1, 2]
    every = [(10.0 * i, True, 60, ACK) for i in range(30)]
    # The packet at the timeout belongs to the segment it ends.
    assert segments(spark, every) == [1] * 13 + [2] * 13 + [3] * 4


def sequential(rows, idle, active):
    seg, since, fins, last, closed, out = 0, None, set(), None, True, []
    for ts, from_a, _, flags in rows:
        if closed or ts - last >= idle:
            seg, since, fins, closed = seg + 1, ts, set(), False
        last = ts
        if flags & FIN:
            fins.add(from_a)
        closed = bool(flags & RST) or len(fins) == 2 or ts - since >= active
        out.append(seg)
    return out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_hot_conversation_equals_sequential_fold(spark, batch):
    rng = random.Random(9)
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice([0.1, 0.5, 2.0, 4.0])
        rows.append((round(t, 1), rng.random() < 0.5, 100, FIN if rng.random() < 0.02 else ACK))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = flows.segments(packets(spark, rows), flows.Timeouts(idle=15, active=20, rows=200))
        got = [r.segment for r in out.orderBy("event_id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sequential([(BASE + a, b, c, d) for a, b, c, d in rows], 15, 20)


def test_input_order_does_not_matter(spark, sf):
    p = inputs.packets(spark, sf)
    pick = lambda df: sorted(map(tuple, flows.flow_records(flows.segments(df)).collect()))
    assert pick(p) == pick(p.orderBy(F.rand(5)).repartition(7))


def test_eviction_keeps_the_most_recent(spark):
    df = spark.createDataFrame([(f"c{i}", float(i)) for i in range(30)], "flow_id string, t1 double")
    assert {r.flow_id for r in flows.evicted(df, 25).collect()} == {f"c{i}" for i in range(5)}


def test_merge_is_weighted_and_associative(spark, sf):
    conns = inputs.connections(spark, sf)
    once = flows.merge_partials(conns, MERGE_ORDER)
    halves = flows.merge_partials(conns.filter("tls_sni_len < 24"), MERGE_ORDER).unionByName(
        flows.merge_partials(conns.filter("tls_sni_len >= 24"), MERGE_ORDER))
    twice = flows.merge_partials(halves, MERGE_ORDER)
    cols = ["flow_id", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("orig_bytes", "iat_mean", "pkt_size_std", "emit_ts", "duration")]]
    assert sorted(map(tuple, once.select(*cols).collect())) == sorted(map(tuple, twice.select(*cols).collect()))


def test_merged_records_make_features(spark, sf):
    merged = flows.merge_partials(inputs.connections(spark, sf), MERGE_ORDER)
    assert extract_features(merged).count() == merged.count()


def test_merge_sorts_records_once(spark, sf):
    """Input splits are not sorted before the shuffle."""
    executed = flows.merge_partials(inputs.connections(spark, sf), MERGE_ORDER)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Sort [flow_id") == 1 and executed.count("Exchange") == 1


def test_crowded_and_nameless_flows_merge_alike(spark, sf):
    conns = inputs.connections(spark, sf).filter("orig_bytes % 5 = 0")
    hot, nameless = (conns.withColumn("flow_id", F.lit(x).cast("string")).limit(40) for x in ("hot", None))
    rows = conns.unionByName(hot).unionByName(nameless)
    cols = ["flow_id", "src_ip", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("orig_bytes", "iat_mean", "start_ts", "label")]]
    pick = lambda crowd: sorted(map(str, flows.merge_partials(rows, MERGE_ORDER, crowd=crowd).select(*cols).collect()))
    found = flows._crowded(rows, 30)
    assert {r.flow_id for r in rows.filter(found).select("flow_id").distinct().collect()} == {"hot", None}
    assert flows._crowded(conns, 30) is None
    assert pick(30) == pick(10**6) and len(pick(30)) == conns.select("flow_id").distinct().count() + 2


def test_plain_rounding_gives_the_same_doubles(spark):
    rng = random.Random(4)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-324, -1e-7, 0.5e-6, 1.5e-6, 2.5e-6 - 1e-9, 1e15, -1e300, 2.0 ** 50 / 1e6]
    some = [f() for _ in range(3000) for f in (
        lambda: rng.uniform(-1, 1) * 10 ** rng.randint(-9, 12), lambda: (rng.randint(-10**9, 10**9) + 0.5) / 1e6 - 1e-9,
        lambda: rng.randint(0, 10**16) / 1e6)]
    rows = spark.createDataFrame([(x,) for x in odd + some], "x double").select(r6("x").alias("a"), r6_plain("x").alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]
