import json

import pytest
from pyspark.sql import functions as F

from netlumen.functions.features import extract_features
from netlumen.operators import augment, metrics
from netlumen.plans import inputs, training


@pytest.fixture(scope="module")
def conns(spark, sf):
    """Attacks send little and are reset, so that there is something to learn."""
    c = inputs.connections(spark, sf)
    attack = F.col("label") == 1
    return c.filter("label >= 0").withColumns({
        "rst_count": F.when(attack, F.col("orig_pkts")).otherwise(0.0),
        "orig_bytes": F.when(attack, F.col("orig_bytes") / 50).otherwise(F.col("orig_bytes"))})


def test_train_store_load_score(spark, conns, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    meta = training.train(conns, path, trees=8, iterations=25)
    assert meta["metrics"]["recall"] > 0.93 and meta["metrics"]["fpr"] < 0.05
    total = meta["n_train"] + meta["n_test"]
    assert total == conns.count() and abs(meta["n_train"] / total - 0.75) < 0.01
    model, stored = training.load(spark, path)
    alerts = training.detect(conns, model, training.threshold_of(stored))
    assert alerts.filter("score < threshold").count() == 0 and alerts.count() > 0
    assert training.score_connections(conns.limit(0), model).count() == 0
    assert training.threshold_of(stored, 0.9) == 0.9
    monkeypatch.setenv("NETLUMEN_THRESHOLD", "0.7")
    assert training.threshold_of(stored) == 0.7


def test_a_row_cap_is_for_fitting_only(spark, conns, tmp_path):
    meta = training.train(conns, str(tmp_path / "m"), trees=2, models=("rf",), max_rows=200)
    n, m = conns.count(), meta["metrics"]
    assert meta["n_train"] == 200 and abs(meta["n_test"] / n - 0.25) < 0.01
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == meta["n_test"]


def test_missing_and_mismatched_models(spark, conns, tmp_path):
    with pytest.raises(training.ModelMissing):
        training.load(spark, str(tmp_path / "none"))
    path = str(tmp_path / "m")
    meta = training.train(conns, path, trees=2, models=("rf",))
    meta["feature_names"] = meta["feature_names"][:-1]
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/metadata")
    with pytest.raises(training.FeatureMismatch):
        training.load(spark, path)


def test_hand_computed_metrics(spark):
    y, s = [1, 1, 1, 0, 0, 0, 0], [.9, .8, .2, .7, .1, .1, .1]
    df = spark.createDataFrame(list(zip(map(float, y), s)), "label double, score double")
    r = metrics.confusion(df, F.lit(0.5)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 3) and r.precision == pytest.approx(2 / 3) and r.fpr == 0.25
    assert metrics.auc_ap(metrics.score_curve(df)).first().roc_auc == pytest.approx(11 / 12)
    empty = metrics.confusion(df.filter("label = 5"), F.lit(0.5)).first()
    assert empty.f1 == 0 and empty.accuracy == 0
    single = metrics.auc_ap(metrics.score_curve(df.filter("label = 1"))).first()
    assert single.roc_auc is None and single.pr_auc is None


def test_operating_points_are_monotone(spark, sf):
    out = metrics.operating_points(metrics.score_curve(inputs.alerts(spark, sf))).collect()
    for kind in ("detection_at_fpr", "fpr_at_detection"):
        rates = [r.rate for r in sorted((r for r in out if r.kind == kind), key=lambda r: r["at"])]
        assert rates == sorted(rates)


def test_augmentation_keeps_rows_and_invariants(spark, conns):
    out = augment.blend_opposite(conns, 0.3)
    assert out.count() == conns.count()
    assert out.groupBy("label").count().orderBy("label").collect() == conns.groupBy("label").count().orderBy("label").collect()
    # Partial records share ids, so compare as multisets of ids.
    assert out.select("flow_id").exceptAll(conns.select("flow_id")).isEmpty()
    touched = augment.blend_opposite(conns, 1.0)
    assert touched.filter("pkt_size_mean < 40 OR pkt_size_mean > 1500 OR orig_bytes < 40 * orig_pkts OR "
                          "(protocol <> 6 AND ack_count > 0) OR payload_entropy > 4.5").isEmpty()
    drifted = augment.drift(conns, 0.5)
    assert drifted.count() == conns.count() and extract_features(drifted).count() == conns.count()
    assert sorted(augment.drift(conns, 0.5).select("orig_bytes").collect()) == sorted(drifted.repartition(9).select("orig_bytes").collect())


def test_mix_errors_and_defaults():
    assert sum(augment.normalised_mix({"a": 3, "b": 1}, ("a", "b")).values()) == pytest.approx(1)
    assert augment.normalised_mix({"a": 2}, ("a", "b")) == {"a": 1.0, "b": 0.0}
    with pytest.raises(ValueError):
        augment.normalised_mix({"a": 0}, ("a", "b"))


def test_only_the_edge_of_a_split_is_ranked(spark, monkeypatch):
    """Labels of few and many rows, equal keys at the cut, and shares that take all or none."""
    ranked = []
    running = augment.running
    monkeypatch.setattr(augment, "running", lambda df, *a, **b: ranked.append(df.count()) or running(df, *a, **b))
    rows = spark.range(9000).select(F.concat(F.lit("f"), F.floor(F.col("id") / 2).cast("string")).alias("flow_id"),
                                    F.when(F.col("id") < 3, 1.0).otherwise(0.0).alias("label"), "id")
    for share, want in ((0.75, {0.0: 6747, 1.0: 2}), (1.0, {0.0: 8997, 1.0: 3}), (0.0, {})):
        got = augment.stratified_split(rows, train=share)
        assert got.columns == ["flow_id", "label", "id", "is_train"] and got.count() == 9000
        assert {r["label"]: r["count"] for r in got.filter("is_train").groupBy("label").count().collect()} == want
        order = got.filter("label = 0").groupBy("is_train").agg(F.min(augment.shuffled(20240917, "flow_id")).alias("a"),
                                                                F.max(augment.shuffled(20240917, "flow_id")).alias("b"))
        ends = {r["is_train"]: r for r in order.collect()}
        assert len(ends) < 2 or ends[True]["b"] <= ends[False]["a"]
    assert max(ranked) < 100


def test_least_hashed_rows(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("flow_id"), "id")
    want = {r["id"] for r in rows.orderBy(F.xxhash64(F.lit(5), "flow_id"), "flow_id").limit(700).collect()}
    assert {r["id"] for r in training.least_hashed(rows, 700, 5).collect()} == want
    assert training.least_hashed(rows, 9000, 5).count() == 5000


def test_a_sweep_numbers_its_pool_once(spark, conns, monkeypatch):
    """The hardest cell's blends hold the others'; each cell is what it is alone."""
    calls = []
    running = augment.running
    monkeypatch.setattr(augment, "running", lambda df, *a, **b: calls.append(len(df.columns)) or running(df, *a, **b))
    grid = metrics.difficulty_grid(conns, (0.0, 0.3, 0.6), (0.0,), F.col("log_total_bytes"))
    assert calls and len(calls) == 1 and calls[0] < len(conns.columns)
    for h in (0.3, 0.6):
        alone = extract_features(augment.blend_opposite(conns, h)).select(F.round("log_total_bytes", 9).alias("s"))
        cell = grid.filter(F.col("hardness") == h).select(F.round("score", 9).alias("s"))
        assert alone.exceptAll(cell).count() == 0 and cell.exceptAll(alone).count() == 0
