"""Detectors are fitted on the whole training part, however many rows it has."""

import pytest
from pyspark.sql import functions as F

from netlumen.plans import catalog_ml, inputs, training


@pytest.fixture
def many(spark, sf):
    """Ten copies of the labelled connections: more rows than a model was once fitted on."""
    c = inputs.connections(spark, sf).filter("label >= 0")
    copies = c.crossJoin(spark.range(10).withColumnRenamed("id", "_k"))
    return copies.withColumn("flow_id", F.concat("flow_id", F.lit("-"), F.col("_k").cast("string"))).drop("_k")


@pytest.fixture
def fitted_on(monkeypatch, many):
    """How many rows reach the fits of a query; small models, as only the rows matter."""
    rows, balanced, forest, mlp = [], training.balanced, training.forest, training.mlp
    monkeypatch.setattr(training, "balanced", lambda df: rows.append(df.count()) or balanced(df))
    monkeypatch.setattr(training, "forest", lambda seed, trees: forest(seed, 1))
    monkeypatch.setattr(training, "mlp", lambda seed, iterations: mlp(seed, 2))
    monkeypatch.setattr(catalog_ml.inputs, "connections", lambda spark, sf: many)
    return rows


def test_train_detector_fits_on_all_training_rows(spark, sf, many, fitted_on):
    out = catalog_ml.reg.queries["train_detector"](spark, sf).collect()
    assert len(out) == 2 and fitted_on[0] > 20_000 and abs(fitted_on[0] - 0.75 * many.count()) <= 2


def test_detect_connections_fits_on_all_training_rows(spark, sf, many, fitted_on):
    out = catalog_ml.reg.queries["detect_connections"](spark, sf)
    assert fitted_on[0] > 20_000 and abs(fitted_on[0] - 0.75 * many.count()) <= 2
    assert out.columns == ["flow_id", "src_ip", "dst_ip", "score", "threshold", "label"]
