"""The node table of a stored forest against the library that fitted it."""

import pytest
from pyspark.sql import functions as F

from netlumen.functions.features import FEATURE_NAMES, extract_features
from netlumen.operators import forest
from netlumen.plans import inputs, training
from netlumen.session import scratch_path

SCHEMA = "tree int, node int, feature int, threshold double, lo int, hi int, p double"


def test_scores_of_a_stored_forest(spark, sf):
    rows = inputs.connections(spark, sf).filter("label >= 0").withColumn("_y", F.col("label"))
    feats = extract_features(rows, keep=("flow_id", "_y")).withColumnRenamed("_y", "label").withColumn("weight", F.lit(1.0))
    model, path = training.forest(seed=5, trees=7).fit(feats), scratch_path(spark, "forest")
    model.write().save(path)
    nodes = forest.stored_nodes(spark, path)
    assert nodes.select("tree").distinct().count() == 7
    out = forest.forest_scores(model.transform(feats), nodes, FEATURE_NAMES, name="mine")
    theirs = training.vector_to_array("probability")[1]
    gap = out.select(F.max(F.abs(F.col("mine") - theirs)).alias("gap"), F.count("mine").alias("n")).first()
    assert gap["gap"] < 1e-9 and gap["n"] == feats.count() > 0


def test_forest_edges(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,)], "a double")
    tree = [(0, 0, 0, 1.0, 1, 2, None), (0, 1, None, None, None, None, 0.25), (0, 2, None, None, None, None, 0.75)]
    score = lambda nodes, **kw: forest.forest_scores(rows, spark.createDataFrame(nodes, SCHEMA), ["a"], **kw)
    assert [r["score"] for r in score(tree).collect()] == [0.25, 0.75, 0.75]
    assert [r["score"] for r in score(tree, depth=1).collect()] == [0.25, 0.75, 0.75]
    assert [r["score"] for r in score([]).collect()] == [None] * 3
    lone = [(3, 0, None, None, None, None, 0.5)]
    assert [r["score"] for r in score(tree + lone).collect()] == [0.375, 0.625, 0.625]
    with pytest.raises(Exception, match="without a gap"):
        score([tree[0], tree[2]]).collect()
    chain = [(0, 0, 0, 0.0, 1, 1, None), (0, 1, 0, 0.0, 2, 2, None), (0, 2, None, None, None, None, 0.5)]
    with pytest.raises(Exception, match="deeper than"):
        score(chain, depth=1).collect()
