"""A stored forest as a table of nodes, and scoring with it as one column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, feature, threshold, lo, hi, p) of the forest in a saved pipeline: what
    a node asks and where it sends a row, or, at a leaf (feature NULL), the share of
    attacks among the rows it was fitted on."""
    data = spark.read.parquet(f"{path}/stages/*RandomForest*/data")
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    weight = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    return data.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, n["leftChild"]).alias("lo"), F.when(inner, n["rightChild"]).alias("hi"),
        F.try_divide(F.get(n["impurityStats"], F.lit(1)), weight).alias("p"))


def forest_scores(rows: DataFrame, nodes: DataFrame, features: Sequence[str], depth: int = 30,
                  name: str = "score") -> DataFrame:
    """``rows`` with the mean over all trees of ``p`` at the leaf each row falls to.

    A node's number is its place in its tree, the root is 0. The forest reaches the tasks as
    one value, whose size the rows a model is fitted on bound; rows are not shuffled. A value
    at or under the threshold goes to ``lo``, any other, and NULL, to ``hi``. A tree deeper
    than ``depth`` (1 or more) or with a number missing fails loudly; a forest without trees gives NULL.
    """
    fields = ("node", "feature", "threshold", "lo", "hi", "p")
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("n"))
    whole = F.element_at("n", -1)["node"] == F.size("n") - 1
    trees = trees.select("tree", F.when(whole, F.col("n")).otherwise(
        F.raise_error(F.lit("a tree's nodes are not numbered from 0 without a gap"))).alias("n"))
    forest = trees.agg(F.array_sort(F.collect_list(F.struct("tree", "n")))).scalar()

    def leaf(tree: Column, values: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            to = F.when(F.get(values, at["feature"]) <= at["threshold"], at["lo"]).otherwise(at["hi"])
            return F.when(at["feature"].isNull(), at).otherwise(F.get(tree["n"], to))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.get(tree["n"], F.lit(0)), step)
        deep = F.raise_error(F.lit(f"a tree is deeper than {depth}")).cast("double")
        return F.transform(F.array(end), lambda e: F.when(e["feature"].isNull(), e["p"]).otherwise(deep))[0]

    # Bound once per row: a plain array would be built again at every step.
    given = F.array(F.array(*[F.col(f).cast("double") for f in features]))
    votes = F.transform(given, lambda v: F.transform(F.col("_forest"), lambda t: leaf(t, v)))[0]
    mean = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(votes), F.lit(0))
    return rows.withColumn("_forest", forest).withColumn(name, mean).drop("_forest")
