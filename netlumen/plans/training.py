"""Train, calibrate, select and store a detector; load it and score with it."""

from __future__ import annotations

import json
import os
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlumen.functions.features import FEATURE_NAMES, extract_features
from netlumen.operators import metrics
from netlumen.operators.augment import stratified_split
from netlumen.operators.scan import UP_TO
from netlumen.session import materialize

# Network shape and forest size.
HIDDEN = (64, 32)
TREES, MIN_LEAF = 200, 2
# Spark's own limit; deeper trees are not offered.
MAX_DEPTH = 30


class ModelMissing(FileNotFoundError):
    pass


class FeatureMismatch(ValueError):
    pass


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="raw_features")


def mlp(seed: int, iterations: int = 100) -> Pipeline:
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(
        labelCol="label", featuresCol="features", layers=[len(FEATURE_NAMES), *HIDDEN, 2],
        maxIter=iterations, seed=seed, blockSize=256)
    return Pipeline(stages=[_assembler(), scaler, net])


def forest(seed: int, trees: int = TREES) -> Pipeline:
    rf = RandomForestClassifier(
        labelCol="label", featuresCol="raw_features", weightCol="weight", numTrees=trees,
        minInstancesPerNode=MIN_LEAF, featureSubsetStrategy="sqrt", maxDepth=MAX_DEPTH,
        maxMemoryInMB=1024, seed=seed)
    return Pipeline(stages=[_assembler(), rf])


def balanced(df: DataFrame) -> DataFrame:
    """Row weights that give both labels the same total."""
    counts = df.agg(F.struct(F.count(F.lit(1)).alias("n"),
                             F.sum((F.col("label") == 1).cast("long")).alias("a"))).scalar()
    rows = df.withColumn("_c", counts)
    mine = F.when(F.col("label") == 1, F.col("_c.a")).otherwise(F.col("_c.n") - F.col("_c.a"))
    return rows.withColumn("weight", F.col("_c.n") / (2.0 * mine)).drop("_c")


def score(model: PipelineModel, features: DataFrame, keep=("flow_id", "label")) -> DataFrame:
    """P(attack) per row; an empty table stays empty."""
    out = model.transform(features)
    names = [c for c in keep if c in features.columns]
    return out.select(*names, vector_to_array("probability")[1].alias("score"))


def evaluate(scored: DataFrame, target_recall: float, max_fpr: float) -> dict:
    """Metrics at the chosen threshold, as plain numbers."""
    scored = materialize(scored, "scores")
    curve = materialize(metrics.score_curve(scored), "curve")
    pick = metrics.choose_threshold(curve, target_recall, max_fpr).first()
    row = metrics.confusion(scored, F.lit(pick["threshold"])).first().asDict()
    areas = metrics.auc_ap(curve).first().asDict()
    points = [r.asDict() for r in metrics.operating_points(curve).collect()]
    return {**row, **areas, "threshold": pick["threshold"], "threshold_rule": pick["rule"],
            "operating_points": points}


def _labelled_features(rows: DataFrame) -> DataFrame:
    return extract_features(rows.withColumn("_y", F.col("label")), keep=("flow_id", "_y")).withColumnRenamed("_y", "label")


def least_hashed(df: DataFrame, n: int, seed: int, key: str = "flow_id") -> DataFrame:
    """The ``n`` rows of least key hash. Counts per hash prefix leave hardly more than ``n``
    rows to be sorted, so the one task that puts them together reads no more than that."""
    hashed = df.withColumns({"_h": F.xxhash64(F.lit(seed), key), "_p": F.shiftright(F.xxhash64(F.lit(seed), key), 48)})
    # 65,536 prefixes at most.
    upto = F.sum("_n").over(Window.orderBy("_p").rowsBetween(*UP_TO))
    counts = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", upto.alias("_upto"))
    last = counts.filter(F.col("_upto") >= n).agg(F.min("_p")).scalar()
    near = hashed.withColumn("_last", last).filter(F.coalesce(F.col("_p") <= F.col("_last"), F.lit(True)))
    return near.orderBy("_h", key).limit(n).select(*df.columns)


def train(connections: DataFrame, out: str, seed: int = 20240917, target_recall: float = 0.97,
          max_fpr: float = 0.015, margin: float = 0.002, trees: int = TREES,
          iterations: int = 100, models: tuple[str, ...] = ("mlp", "rf"), max_rows: int | None = None) -> dict:
    """Fits the candidates on a stratified split, calibrates each on the held-out part,
    keeps the cheaper one unless the other gains more than ``margin`` F1, stores it. All rows
    of the training part are fitted on, unless a caller asks for ``max_rows``, those of least
    id hash; the threshold and all figures come from the whole held-out part."""
    split = stratified_split(connections.filter(F.col("label").isin(0.0, 1.0)), seed=seed)
    # Only what is fitted on or scored is turned into features and written.
    held = materialize(_labelled_features(split.filter("NOT is_train")), "held")
    fit = split.filter("is_train")
    fit = _labelled_features(fit if max_rows is None else least_hashed(fit, max_rows, seed))
    fit = materialize(balanced(materialize(fit, "fit")), "fit-weighted")
    builders = {"mlp": lambda: mlp(seed, iterations), "rf": lambda: forest(seed, trees)}
    results, fitted = {}, {}
    for name in models:
        started = time.time()
        fitted[name] = builders[name]().fit(fit)
        results[name] = evaluate(score(fitted[name], held), target_recall, max_fpr)
        results[name]["fit_seconds"] = time.time() - started
    chosen = models[0]
    if len(models) > 1 and results["rf"]["f1"] - results["mlp"]["f1"] > margin:
        chosen = "rf"
    elif len(models) > 1:
        chosen = "mlp"
    meta = {
        "version": 1, "model": chosen, "feature_names": list(FEATURE_NAMES),
        "n_features": len(FEATURE_NAMES), "threshold": results[chosen]["threshold"],
        "target_recall": target_recall, "max_fpr": max_fpr, "metrics": results[chosen],
        "candidates": results, "n_train": fit.count(), "n_test": held.count()}
    fitted[chosen].write().overwrite().save(f"{out}/model")
    spark = connections.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{out}/metadata")
    return meta


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """Model and metadata; refuses a missing model and another feature list."""
    try:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        model = PipelineModel.load(f"{path}/model")
    except Exception as error:  # noqa: BLE001 - the readers raise several kinds
        raise ModelMissing(f"no usable model under {path}") from error
    if tuple(meta["feature_names"]) != FEATURE_NAMES:
        raise FeatureMismatch("the model was trained on another feature list")
    return model, meta


def threshold_of(meta: dict, override: float | None = None) -> float:
    """Argument, then the NETLUMEN_THRESHOLD variable, then the stored value."""
    if override is not None:
        return float(override)
    from_env = os.environ.get("NETLUMEN_THRESHOLD")
    return float(from_env) if from_env else float(meta["threshold"])


def detect(connections: DataFrame, model: PipelineModel, threshold: float) -> DataFrame:
    """Alerts of a connection table or stream."""
    from netlumen.functions.severity import to_alerts

    return to_alerts(score_connections(connections, model), threshold)


def score_connections(connections: DataFrame, model: PipelineModel) -> DataFrame:
    """Identity columns and score per connection."""
    carried = ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "emit_ts", "label")
    feats = extract_features(connections, keep=carried)
    return score(model, feats, keep=carried)
