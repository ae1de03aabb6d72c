"""Detector quality: confusion counts, curves, operating points, latency, throughput.

Curves are cumulative counts over distinct scores, highest first. Equal scores are
combined before any shuffle and the cumulation is sliced by score, so neither a
popular score nor the number of distinct scores ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.functions.features import extract_features
from netlumen.operators import augment
from netlumen.operators.scan import global_rank, histogram_quantiles, running
from netlumen.session import materialize

# Budgets and targets the operating-point table reports.
FPR_BUDGETS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
DETECTION_TARGETS = (0.95, 0.96, 0.97, 0.98, 0.99)
TARGET_RECALL, MAX_FPR = 0.97, 0.015


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, threshold: Column, by: Sequence[str] = (), y: str = "label",
              score: str = "score") -> DataFrame:
    """One row (per group): tp, fp, fn, tn and the rates derived from them."""
    flagged, attack = F.col(score) >= threshold, F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    counts = df.groupBy(*by).agg(
        n(flagged & attack).alias("tp"), n(flagged & ~attack).alias("fp"),
        n(~flagged & attack).alias("fn"), n(~flagged & ~attack).alias("tn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({
        "precision": precision, "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def score_curve(df: DataFrame, by: Sequence[str] = (), y: str = "label",
                score: str = "score") -> DataFrame:
    """Per distinct score: cumulative true and false positives at or above it, with
    ``p`` and ``n`` the totals of the group."""
    by = list(by)
    attack = (F.col(y) == 1).cast("long")
    points = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(attack).alias("tp_here"), F.sum(1 - attack).alias("fp_here"))
    key = by or []
    curve = running(points, key, [F.desc("score")],
                    sums={"tp": F.col("tp_here"), "fp": F.col("fp_here")})
    totals = df.groupBy(*by).agg(F.sum(attack).alias("p"), F.sum(1 - attack).alias("n"))
    if by:
        curve = curve.join(totals, by)
    else:
        curve = (curve.withColumn("_t", totals.select(F.struct("p", "n")).scalar())
                 .withColumns({"p": F.col("_t.p"), "n": F.col("_t.n")}).drop("_t"))
    return curve.withColumns({"tpr": ratio(F.col("tp"), F.col("p")),
                              "fpr": ratio(F.col("fp"), F.col("n"))})


def auc_ap(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC area (trapezoids) and average precision; NULL when only one class occurs."""
    area = F.sum(F.col("fp_here") * (F.col("tp") - F.col("tp_here") / 2.0))
    ap = F.sum(F.col("tp_here") * F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
    p, n = F.max("p"), F.max("n")
    both = (p > 0) & (n > 0)
    return curve.groupBy(*by).agg(
        F.when(both, F.try_divide(area, p.cast("double") * n)).alias("roc_auc"),
        F.when(both, F.try_divide(ap, p.cast("double"))).alias("pr_auc"))


def thin_curve(curve: DataFrame, points: int = 200) -> DataFrame:
    """Every k-th point of the curve, the first included, so that about ``points`` stay."""
    ranked = global_rank(curve, [F.desc("score")], "rn", "m")
    stride = F.greatest(F.floor(F.col("m") / points), F.lit(1))
    return ranked.filter((F.col("rn") - 1) % stride == 0).select("score", "fpr", "tpr")


def operating_points(curve: DataFrame, budgets: Sequence[float] = FPR_BUDGETS,
                     targets: Sequence[float] = DETECTION_TARGETS) -> DataFrame:
    """Detection at each false-positive budget and false positives at each detection
    target. One pass of conditional aggregates; a budget below the first point yields
    detection 0 and no threshold."""
    aggs = []
    for i, b in enumerate(budgets):
        ok = F.col("fpr") <= b
        aggs += [F.coalesce(F.max(F.when(ok, F.col("tpr"))), F.lit(0.0)).alias(f"b{i}"),
                 F.min(F.when(ok, F.col("score"))).alias(f"bt{i}")]
    for i, t in enumerate(targets):
        ok = F.col("tpr") >= t
        aggs += [F.min(F.when(ok, F.col("fpr"))).alias(f"t{i}"),
                 F.max(F.when(ok, F.col("score"))).alias(f"tt{i}")]
    one = curve.agg(*aggs)
    line = lambda kind, limit, value, thr: F.struct(
        F.lit(kind).alias("kind"), F.lit(float(limit)).alias("at"),
        F.col(value).alias("rate"), F.col(thr).alias("threshold"))
    lines = [line("detection_at_fpr", b, f"b{i}", f"bt{i}") for i, b in enumerate(budgets)]
    lines += [line("fpr_at_detection", t, f"t{i}", f"tt{i}") for i, t in enumerate(targets)]
    return one.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def choose_threshold(curve: DataFrame, target_recall: float = TARGET_RECALL,
                     max_fpr: float = MAX_FPR) -> DataFrame:
    """Best F1 within the recall target and the false-positive budget; failing that
    within the recall target; failing that overall. The lowest threshold wins a tie."""
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    f1 = ratio(2 * precision * F.col("tpr"), precision + F.col("tpr"))
    key = F.struct(f1.alias("f1"), (-F.col("score")).alias("s"))
    meets = F.col("tpr") >= target_recall
    best = curve.agg(F.max(F.when(meets & (F.col("fpr") <= max_fpr), key)).alias("a"),
                     F.max(F.when(meets, key)).alias("b"), F.max(key).alias("c"))
    pick = F.coalesce("a", "b", "c")
    rule = (F.when(F.col("a").isNotNull(), "recall+fpr budget")
            .when(F.col("b").isNotNull(), "recall target only (fpr budget unmet)")
            .otherwise("max f1 (recall target unmet)"))
    return best.select((-pick["s"]).alias("threshold"), pick["f1"].alias("f1"), rule.alias("rule"))


def per_class(df: DataFrame, cls: str, threshold: Column, y: str = "label",
              score: str = "score") -> DataFrame:
    flagged = (F.col(score) >= threshold).cast("long")
    return df.groupBy(F.col(cls).alias("class")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(flagged).alias("flagged"),
        F.avg(flagged).alias("flagged_rate"), (F.avg(y) > 0.5).alias("is_attack"))


def join_truth(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores whose flow has a known class; others are ignored."""
    return scores.join(truth, "flow_id")


def merge_truth(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def latency_stats(df: DataFrame, latency_s: str, arrival: Sequence[str],
                  warmup: float = 0.01) -> DataFrame:
    """Latency in ms over all finite non-negative rows, and again past the warm-up,
    the first ``warmup`` share of rows in arrival order (at least one row). The rows are
    ranked once and counted by value once; all ranks come from those counts."""
    ms = F.col(latency_s) * 1000.0
    ok = df.withColumn("_ms", ms).filter(
        F.col("_ms").isNotNull() & ~F.isnan("_ms") & (F.col("_ms") >= 0)
        & (F.col("_ms") != float("inf")))
    ranked = global_rank(ok.select("_ms", *arrival), list(arrival), "_rank", "_m")
    cut = F.greatest(F.floor(F.col("_m") * warmup), F.lit(1))
    steady = (F.col("_rank") > cut).cast("long")
    values = materialize(ranked.groupBy("_ms").agg(F.count(F.lit(1)).alias("_n"), F.sum(steady).alias("_s")), "latencies")
    facts = values.agg(F.sum("_n").alias("count"), (F.sum(F.col("_ms") * F.col("_n")) / F.sum("_n")).alias("mean_ms"),
                       F.max("_ms").alias("max_ms"),
                       F.max(F.when(F.col("_n") > F.col("_s"), F.col("_ms"))).alias("warmup_max_ms"),
                       F.max(F.when(F.col("_s") > 0, F.col("_ms"))).alias("steady_max_ms"))
    ranks = histogram_quantiles(values, "_ms", {
        "p50_ms": ("_n", 0.5), "p90_ms": ("_n", 0.9), "p99_ms": ("_n", 0.99), "steady_p99_ms": ("_s", 0.99)})
    return facts.withColumn("_q", ranks.select(F.struct("*")).scalar()).select(
        *facts.columns, *[f"_q.{c}" for c in ranks.columns])


def throughput(df: DataFrame, start: str, end: str, generated: Column, target_rate: float,
               detection: Column | None = None, detection_target: float = 0.95,
               bounded: Column | None = None) -> DataFrame:
    """Offered and sustained rates, loss, and whether the acceptance targets hold."""
    facts = df.agg(F.count(F.lit(1)).alias("scored"),
                   F.greatest(F.max(end) - F.min(end), F.lit(1e-9)).alias("window_s"),
                   F.greatest(F.max(start) - F.min(start), F.lit(1e-9)).alias("offer_s"))
    facts = facts.withColumn("generated", generated)
    out = facts.withColumns({
        "offered_rate": F.col("generated") / F.col("offer_s"),
        "sustained_rate": F.col("scored") / F.col("window_s"),
        "loss_rate": F.greatest(F.lit(0.0), 1 - F.col("scored") / F.greatest("generated", F.lit(1)))})
    steady = bounded if bounded is not None else F.lit(True)
    out = out.withColumn("throughput_pass", (F.col("sustained_rate") >= target_rate) & steady)
    if detection is not None:
        out = out.withColumn("detection_pass", detection >= detection_target)
    return out


def backlog(samples: DataFrame, value: str, order: Sequence[str],
            slack: float = 5000.0) -> DataFrame:
    """Whether a queue keeps growing: its last third averages more than its first
    third plus ``slack``."""
    ranked = global_rank(samples, list(order), "_r", "_m")
    third = F.greatest(F.floor(F.col("_m") / 3), F.lit(1))
    out = ranked.agg(
        F.max(value).alias("max_backlog"), F.avg(value).alias("mean_backlog"),
        F.max_by(value, "_r").alias("final_backlog"),
        F.avg(F.when(F.col("_r") <= third, F.col(value))).alias("first_third"),
        F.avg(F.when(F.col("_r") > F.col("_m") - third, F.col(value))).alias("last_third"))
    return out.withColumn("bounded", F.col("last_third") <= F.col("first_third") + slack)


def sweep(df: DataFrame, cell: Sequence[str], threshold: Column) -> DataFrame:
    """Detection metrics of every parameter cell of a swept, scored table, with the
    detection rate at one false positive in a hundred."""
    curve = materialize(score_curve(df, cell), "sweep-curve")
    at_budget = curve.groupBy(*cell).agg(F.coalesce(
        F.max(F.when(F.col("fpr") <= 0.01, F.col("tpr"))), F.lit(0.0)).alias("detection_at_fpr_1pct"))
    return confusion(df, threshold, cell).join(auc_ap(curve, cell), list(cell)).join(at_budget, list(cell))


def difficulty_grid(connections: DataFrame, hardness: Sequence[float], drifts: Sequence[float],
                    scorer: Column) -> DataFrame:
    """(hardness, drift, label, score): the labelled connections once per grid cell, blended
    toward the opposite label, then drifted, then scored by ``scorer`` over their features.
    Cells blend and drift alike wherever they run, so one cell of the grid stands alone. What
    the hardest cell blends is worked out and written once and holds the others' blends."""
    out, hardest = None, max(hardness, default=0.0)
    blends = materialize(augment.opposite_blends(connections, hardest), "sweep-blend") if hardest > 0 else None
    for h in hardness:
        blended = augment.blend_opposite(connections, h, moved=blends)
        for d in drifts:
            moved = augment.drift(blended, d).withColumn("_y", F.col("label"))
            scored = extract_features(moved, keep=("_y",)).select(
                F.lit(float(h)).alias("hardness"), F.lit(float(d)).alias("drift"),
                F.col("_y").alias("label"), scorer.alias("score"))
            out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("a sweep needs at least one hardness and one drift")
    return out


def select_model(candidates: DataFrame, cheap: str, costly: str, margin: float) -> DataFrame:
    """The cheaper model unless the other's F1 is more than ``margin`` higher."""
    f1 = lambda name: F.max(F.when(F.col("model") == name, F.col("f1")))
    both = candidates.agg(f1(cheap).alias("cheap_f1"), f1(costly).alias("costly_f1"))
    gain = F.col("costly_f1") - F.col("cheap_f1")
    return both.withColumns({
        "gain": gain, "chosen": F.when(gain > margin, costly).otherwise(cheap)})


def dataset_summary(df: DataFrame, cls: str, y: str = "label") -> DataFrame:
    """Rows, attacks and share of the table per class, with a total row (class NULL)."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("rows"),
                                 F.sum((F.col(y) == 1).cast("long")).alias("attacks"))
    total = counts.agg(F.sum("rows")).scalar()
    rolled = counts.rollup(cls).agg(F.sum("rows").alias("rows"), F.sum("attacks").alias("attacks"))
    return rolled.withColumn("_n", total).select(
        F.col(cls).alias("class"), "rows", "attacks",
        (F.col("rows") / F.col("_n")).alias("share"),
        (F.col("attacks") / F.col("rows")).alias("attack_share"))
