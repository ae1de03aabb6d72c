import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netlumen.operators import scan, stats


def hot_table(n=4000, seed=3):
    """One key holds two thirds of the rows; values repeat heavily."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.66, "hot", rng.integers(0, 40, n).astype(str))
    return pd.DataFrame({"k": key, "t": np.round(rng.random(n) * 5000, 2), "id": np.arange(n),
                         "v": np.round(rng.lognormal(0, 2, n) * rng.choice([1, -1], n), 2)})


def test_running_matches_plain_windows(spark):
    pdf = hot_table()
    out = scan.running(spark.createDataFrame(pdf), ["k"], ["t", "id"], rows=300,
                       sums={"s": F.col("id")}, maxes={"m": F.col("v")}, lags={"p": F.col("t")})
    got = out.toPandas().sort_values("id", ignore_index=True)
    ordered = pdf.sort_values(["k", "t", "id"])
    g = ordered.groupby("k")
    want = ordered.assign(s=g["id"].cumsum(), m=g["v"].cummax(), p=g["t"].shift()).sort_values("id", ignore_index=True)
    assert (got["s"] == want["s"]).all() and (got["m"] == want["m"]).all()
    pd.testing.assert_series_equal(got["p"], want["p"])


def test_global_rank(spark):
    pdf = hot_table()
    got = scan.global_rank(spark.createDataFrame(pdf), ["t", "id"], "rn", "n", rows=300).toPandas()
    want = pdf.sort_values(["t", "id"])["id"].tolist()
    assert got.sort_values("rn")["id"].tolist() == want and set(got["n"]) == {len(pdf)}


def test_exact_quantiles_with_hot_group(spark):
    pdf = hot_table()
    qs = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = scan.exact_quantiles(spark.createDataFrame(pdf), "v", qs, ["k"], per_e=16).toPandas()
    for k, part in pdf.groupby("k"):
        mine = got[got.k == k].set_index("q")["value"]
        for q in qs:
            assert np.isclose(mine[q], np.quantile(part["v"], q)), (k, q)


def test_values_at_ranks(spark):
    pdf = hot_table(1500)
    sizes = pdf.groupby("k").size()
    asked = [(k, int(r)) for k, n in sizes.items() for r in {0, n // 3, n - 1}]
    ranks = spark.createDataFrame(asked, "k string, rank long")
    for r in scan.values_at_ranks(spark.createDataFrame(pdf), "v", ranks, ["k"], per_e=8).collect():
        assert r.value == sorted(pdf[pdf.k == r.k]["v"])[r["rank"]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), q=st.floats(0, 1))
def test_quantile_property(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = scan.exact_quantiles(df, "v", (q,)).first()["value"]
    assert np.isclose(got, np.quantile(values, q), rtol=1e-9, atol=1e-9)


def test_bootstrap_interval_covers_the_point_estimate(spark):
    rng = np.random.default_rng(5)
    base, treat = rng.normal(10, 2, 400), rng.normal(5, 1, 401)
    df = spark.createDataFrame([("a", float(v)) for v in base] + [("b", float(v)) for v in treat], "arm string, v double")
    ci = stats.bootstrap_medians_ci(df, "arm", "v", "a", "b", resamples=500).first()
    again = stats.bootstrap_medians_ci(df, "arm", "v", "a", "b", resamples=500).first()
    plain = [1 - np.median(rng.choice(treat, 401)) / np.median(rng.choice(base, 400)) for _ in range(1500)]
    assert ci == again and ci.lower < 1 - np.median(treat) / np.median(base) < ci.upper
    assert abs(ci.lower - np.quantile(plain, 0.025)) < 0.02 and abs(ci.upper - np.quantile(plain, 0.975)) < 0.02


def test_one_instant_of_all_rows_is_split(spark):
    """A range holds about as many rows as asked for, whatever key, instant or value they share."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.lit(1.0).alias("t"), "id")
    dealt = scan.ranges(df, ["k"], ["t", "id"], 1000)
    sizes = [r["count"] for r in dealt.groupBy("_slice").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3000
    got = scan.running(df, ["k"], ["t", "id"], sums={"n": F.lit(1)}, rows=1000)
    assert got.filter("n <> id + 1").count() == 0
    ranked = scan.global_rank(df, [F.desc("t"), F.desc("id")], rows=1000)
    assert ranked.filter("rn <> 20000 - id").count() == 0


def test_quantiles_from_counts(spark):
    pdf = hot_table()
    counts = spark.createDataFrame(pdf).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("k") == "hot").cast("long")).alias("h"))
    got = scan.histogram_quantiles(counts, "v", {"a": ("n", 0.5), "b": ("h", 0.99), "c": ("n", 0.0)}).first()
    hot = pdf[pdf.k == "hot"].v
    assert np.allclose([got.a, got.b, got.c], [pdf.v.median(), hot.quantile(0.99), pdf.v.min()])
    assert stats.nearest_rank(spark.createDataFrame(pdf), "v", 0.95).first()["value"] == sorted(pdf.v)[int(len(pdf) * 0.95)]


def test_quantile_joins_broadcast_ranks_only(spark):
    """Exploded rows look small to Spark; the side that holds them must not be broadcast."""
    rows = spark.range(2000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(30)))).withColumn(
        "v", (F.col("id") * (F.col("k") + 1)).cast("double"))
    ranks = spark.createDataFrame([(k, 7) for k in range(31)], "k int, rank long")
    for out in (scan.exact_quantiles(rows, "v", (0.5,), ["k"]), scan.values_at_ranks(rows, "v", ranks, ["k"])):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "LeftSemi" in plan and "BuildLeft" not in plan
    got = scan.exact_quantiles(rows, "v", (0.5,), ["k"]).toPandas().set_index("k")["value"]
    assert got.to_dict() == {k: 999.5 * (k + 1) for k in range(31)}
