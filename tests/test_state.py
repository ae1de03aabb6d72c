import math
import random

import pytest
from pyspark.sql import functions as F

from netlumen.operators import correlate, rollups, state

EVENTS = "event_id long, flow_id string, node_id string, ts double, score double"


def events(spark, rows):
    return spark.createDataFrame([(i, f"f{i}", n, float(t), float(s)) for i, (n, t, s) in enumerate(rows)], EVENTS)


def at(spark, rows, ts, **kw):
    out = state.state_at(events(spark, rows), F.lit(float(ts)), d=state.Decay(**kw)).collect()
    return {r.node_id: r for r in out}


def test_peak_is_held_then_halves(spark):
    rows = [("n", 0, 0.96)]
    kw = {"half_life": 10.0, "dwell": 30.0}
    assert at(spark, rows, 29, **kw)["n"].score == pytest.approx(0.96)
    assert at(spark, rows, 40, **kw)["n"].score == pytest.approx(0.48)
    assert at(spark, rows, 50, **kw)["n"].score == pytest.approx(0.24)
    assert at(spark, rows, 40, **kw)["n"].severity == "low"


def test_faded_device_disappears(spark):
    assert at(spark, [("n", 0, 0.9)], 120, half_life=5.0, dwell=5.0) == {}


def test_ranking(spark):
    st = state.state_at(events(spark, [("a", 1, 0.35), ("b", 2, 0.99), ("c", 3, 0.62)]), F.lit(4.0))
    assert [r.node_id for r in state.ranked(st).collect()] == ["b", "c", "a"]


def sequential(rows, d):
    """The fold the closed form replaces."""
    score, last, out = {}, {}, []
    for n, t, s in rows:
        gap = max(t - last[n], 0.0) if n in last else 0.0
        score[n] = max(score.get(n, 0.0) * 0.5 ** (max(gap - d.dwell, 0.0) / d.half_life), s)
        last[n] = t
        out.append(score[n])
    return out


@pytest.mark.parametrize("per_task", [100, 1000, None])
def test_timeline_equals_sequential_fold_for_a_hot_device(spark, per_task):
    rng, t, rows = random.Random(4), 0.0, []
    for _ in range(3000):
        t += rng.choice([0.5, 3.0, 60.0, 200.0])
        rows.append(("hot" if rng.random() < 0.7 else f"n{rng.randrange(20)}", t, rng.uniform(0.05, 1.0)))
    d = state.Decay(rows=per_task)
    got = [r.score for r in state.score_timeline(events(spark, rows), d=d).orderBy("event_id").collect()]
    assert max(abs(a - b) for a, b in zip(got, sequential(rows, d))) < 1e-9


def test_state_only_cools_without_alerts(spark):
    rows = [("n", 0, 0.97), ("n", 50, 0.5)]
    scores = [at(spark, rows, t).get("n") for t in (60, 120, 200, 300, 400)]
    values = [r.score if r else 0.0 for r in scores]
    assert values == sorted(values, reverse=True)


def test_acknowledgement_clears(spark):
    ev = events(spark, [("n", 0, 0.97), ("n", 100, 0.4), ("m", 0, 0.9)])
    acks = spark.createDataFrame([("n", 50.0)], "node_id string, ts double")
    st = {r.node_id: r for r in state.state_after_acks(ev, acks, F.lit(101.0)).collect()}
    assert st["n"].score == pytest.approx(0.4) and st["n"].alert_count == 1 and st["m"].alert_count == 1


def test_changes_only_when_a_band_is_left(spark):
    line = state.score_timeline(events(spark, [("n", 0, 0.96)]))
    out = [(r.tick, r.severity) for r in state.severity_changes(line, 2.0).orderBy("tick").collect()]
    assert [s for _, s in out] == ["high", "medium", "low", "info", "none"]
    fall = lambda b: 30 + 120 * math.log2(0.96 / b)
    for (tick, _), bound in zip(out, (0.95, 0.8, 0.55, 0.3, 0.05)):
        assert 0 <= tick - fall(bound) <= 2.0 + 1e-9


def test_window_count_and_recent_lists(spark):
    ev = events(spark, [("n", t, 0.5) for t in (0, 100, 299, 300, 301, 650)])
    got = [r.alert_count_window for r in state.rolling_count(ev).orderBy("event_id").collect()]
    assert got == [1, 2, 3, 4, 4, 1]
    seen = spark.createDataFrame([("n", float(i), i, p) for i, p in enumerate("abcadefb")],
                                 "node_id string, ts double, event_id long, p string")
    assert state.most_recent_distinct(seen, F.col("p")).first()["items"] == ["b", "f", "e", "d", "a"]


NODES = ("id string, name string, ip string, ips array<string>, mac string, device_type string, "
         "subnet string, tags array<string>, ord long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([
        ("h1", "h1", "10.0.0.5", ["10.0.0.5", "10.0.9.9"], "00:1b:54:00:00:01", "server", "10.0.0.0/24", ["asset:A1"], 1),
        ("h2", "h2", "10.0.0.5", [], None, "server", "10.0.0.0/24", [], 2),
        ("sw", "sw", "10.0.0.2", [], None, "switch", "10.0.0.0/24", [], 3),
        ("rt", "rt", "10.0.0.1", [], None, "router", "10.0.0.0/24", [], 4),
        ("fw", "fw", "10.1.0.1", [], None, "firewall", "10.0.0.0/8", [], 5),
        ("r6", "r6", "2001:db8::1", [], None, "router", "2001:db8::/64", [], 6),
        ("bad", "bad", "1.1.1.1", [], None, "router", "somewhere", [], 7)], NODES)


def attribute(spark, nodes, src, dst, **kw):
    row = spark.createDataFrame([(src, dst, 0.9)], "src_ip string, dst_ip string, score double")
    return correlate.attribute_alerts(row, nodes, **kw).first()


@pytest.mark.parametrize("src,dst,node,peer,method", [
    ("10.0.0.5", "8.8.8.8", "h1", None, "ip"),                 # first claimant of an address
    ("8.8.8.8", "10.0.9.9", "h1", None, "ip"),                 # secondary address, internal end
    ("10.0.0.77", "8.8.8.8", "rt", None, "subnet"),            # best gateway of the first subnet
    ("10.200.0.1", "10.0.0.2", "fw", "sw", "subnet"),          # wider subnet; source first inside
    ("2001:db8::99", "8.8.8.8", "r6", None, "subnet"),
    ("8.8.4.4", "8.8.8.8", None, None, "unresolved"),
    ("junk", "10.0.0.2", "sw", None, "ip")])
def test_attribution_rules(spark, nodes, src, dst, node, peer, method):
    r = attribute(spark, nodes, src, dst)
    assert (r.node_id, r.peer_node_id, r.correlation) == (node, peer, method)


def test_unresolved_address_and_preference(spark, nodes):
    assert attribute(spark, nodes, "9.9.9.9", "192.168.1.1").unresolved_ip == "192.168.1.1"
    assert attribute(spark, nodes, "9.9.9.9", "8.8.8.8").unresolved_ip == "9.9.9.9"
    assert attribute(spark, nodes, "10.0.0.5", "10.0.0.2", prefer="destination").node_id == "sw"
    with pytest.raises(ValueError):
        attribute(spark, nodes, "a", "b", prefer="neither")


def test_hardware_address_beats_everything(spark, nodes):
    row = spark.createDataFrame([("10.0.0.2", "8.8.8.8", 0.5, "00-1B-54-00-00-01", None), ("10.0.0.2", "8.8.8.8", 0.5, None, "A1"),
                                 ("10.0.0.2", "10.0.0.1", 0.5, None, None)],
                                "src_ip string, dst_ip string, score double, mac string, asset_tag string")
    got = sorted((r.correlation, r.node_id, r.peer_node_id) for r in correlate.attribute_alerts(row, nodes).collect())
    assert got == [("asset", "h1", None), ("ip", "sw", "rt"), ("mac", "h1", None)]


def test_rollup_dims(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "x string, y int")
    got = {(r.dim, r.value): r.n for r in rollups.counts_by(df, {"x": "x", "y": "y"}, total=True).collect()}
    assert got == {("x", "a"): 2, ("x", None): 1, ("y", "1"): 1, ("y", "2"): 2, ("total", None): 3}
