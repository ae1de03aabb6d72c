"""Detector quality, latency, throughput and summary statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with
from netlumen.operators import metrics, stats
from netlumen.plans import inputs
from netlumen.plans.registry import Registry, r6, sql6

reg = Registry()
THR = 0.2158



def rates_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    p = "coalesce(tp / nullif(tp + fp, 0), 0e0)"
    r = "coalesce(tp / nullif(tp + fn, 0), 0e0)"
    return (f"SELECT {k}tp, fp, fn, tn, {sql6(p)} AS precision, {sql6(r)} AS recall, "
            f"{sql6(f'coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0e0)')} AS f1, "
            f"{sql6('coalesce(fp / nullif(fp + tn, 0), 0e0)')} AS fpr, "
            f"{sql6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy FROM {source}")


def counts_sql(source: str, keys: str = "", thr: str = f"{THR}e0") -> str:
    k, g = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    c = lambda cond: f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"
    return (f"(SELECT {k}{c(f'score >= {thr} AND label = 1')} AS tp, {c(f'score >= {thr} AND label <> 1')} AS fp, "
            f"{c(f'score < {thr} AND label = 1')} AS fn, {c(f'score < {thr} AND label <> 1')} AS tn FROM {source}{g})")


_ROUND = ("precision", "recall", "f1", "fpr", "accuracy")


def _rounded(df, names=_ROUND):
    return df.withColumns({n: r6(n) for n in names})


@reg.query("confusion", duck_with("fx_alerts") + rates_sql(counts_sql("fx_alerts")))
def confusion(spark, sf):
    return _rounded(metrics.confusion(inputs.alerts(spark, sf), F.lit(THR)))


def curve_ctes(source: str = "fx_alerts", key: str = "") -> tuple[str, ...]:
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    return (
        f"""pts AS (SELECT {k}score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tph,
 CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS fph FROM {source} GROUP BY {k}score)""",
        f"""cum AS (SELECT *, CAST(sum(tph) OVER w AS BIGINT) AS tp, CAST(sum(fph) OVER w AS BIGINT) AS fp,
 CAST(sum(tph) OVER ({part}) AS DOUBLE) AS p, CAST(sum(fph) OVER ({part}) AS DOUBLE) AS n FROM pts
 WINDOW w AS ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""",
        """curve AS (SELECT *, CASE WHEN p > 0 THEN tp / p ELSE 0e0 END AS tpr, CASE WHEN n > 0 THEN fp / n ELSE 0e0 END AS fpr FROM cum)""")


_AUC = ("sum(fph * (tp - tph / 2e0)) / max(p) / max(n)", "sum(tph * (CAST(tp AS DOUBLE) / (tp + fp))) / max(p)")


@reg.query("score_curve", duck_with("fx_alerts", *curve_ctes()) +
           f"SELECT {sql6('score')} AS score, score AS raw, tp, fp, {sql6('tpr')} AS tpr, {sql6('fpr')} AS fpr FROM curve")
def score_curve(spark, sf):
    curve = metrics.score_curve(inputs.alerts(spark, sf))
    return curve.select(r6("score").alias("score"), F.col("score").alias("raw"), "tp", "fp",
                        r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@reg.query("roc_curve", duck_with("fx_alerts", *curve_ctes()) + f"""SELECT {sql6('score')} AS score, {sql6('fpr')} AS fpr, {sql6('tpr')} AS tpr
 FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS m FROM curve) WHERE (rn - 1) % greatest(m // 200, 1) = 0""")
def roc_curve(spark, sf):
    thin = metrics.thin_curve(metrics.score_curve(inputs.alerts(spark, sf)))
    return thin.select(r6("score").alias("score"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@reg.query("auc_ap", duck_with("fx_alerts", *curve_ctes()) +
           f"SELECT {sql6(_AUC[0])} AS roc_auc, {sql6(_AUC[1])} AS pr_auc FROM curve")
def auc_ap(spark, sf):
    out = metrics.auc_ap(metrics.score_curve(inputs.alerts(spark, sf)))
    return out.select(r6("roc_auc").alias("roc_auc"), r6("pr_auc").alias("pr_auc"))


def _points_sql() -> str:
    b = ", ".join(f"({x}e0)" for x in metrics.FPR_BUDGETS)
    t = ", ".join(f"({x}e0)" for x in metrics.DETECTION_TARGETS)
    return duck_with("fx_alerts", *curve_ctes()) + f"""SELECT 'detection_at_fpr' AS kind, v AS at, {sql6('coalesce(max(tpr), 0e0)')} AS rate, {sql6('min(score)')} AS threshold
 FROM (VALUES {b}) q(v) LEFT JOIN curve ON fpr <= v GROUP BY v
 UNION ALL SELECT 'fpr_at_detection', v, {sql6('min(fpr)')}, {sql6('max(score)')} FROM (VALUES {t}) q(v) LEFT JOIN curve ON tpr >= v GROUP BY v"""


@reg.query("operating_points", _points_sql())
def operating_points(spark, sf):
    out = metrics.operating_points(metrics.score_curve(inputs.alerts(spark, sf)))
    return out.select("kind", "at", r6("rate").alias("rate"), r6("threshold").alias("threshold"))


_F1 = "coalesce(2 * (CAST(tp AS DOUBLE) / (tp + fp)) * tpr / nullif((CAST(tp AS DOUBLE) / (tp + fp)) + tpr, 0), 0e0)"


def _choose_sql(recall: float, fpr: float) -> str:
    tier = f"CASE WHEN tpr >= {recall}e0 AND fpr <= {fpr}e0 THEN 1 WHEN tpr >= {recall}e0 THEN 2 ELSE 3 END"
    return duck_with("fx_alerts", *curve_ctes()) + f"""SELECT {sql6('score')} AS threshold, {sql6('f1')} AS f1,
 CASE tier WHEN 1 THEN 'recall+fpr budget' WHEN 2 THEN 'recall target only (fpr budget unmet)' ELSE 'max f1 (recall target unmet)' END AS rule
 FROM (SELECT score, {_F1} AS f1, {tier} AS tier FROM curve) ORDER BY tier, f1 DESC, score LIMIT 1"""


def _choose(recall, fpr):
    def run(spark, sf):
        out = metrics.choose_threshold(metrics.score_curve(inputs.alerts(spark, sf)), recall, fpr)
        return out.select(r6("threshold").alias("threshold"), r6("f1").alias("f1"), "rule")
    return run


reg.query("choose_threshold", _choose_sql(0.97, 0.015))(_choose(0.97, 0.015))
reg.query("choose_threshold_in_budget", _choose_sql(0.30, 0.5))(_choose(0.30, 0.5))


@reg.query("per_class", duck_with("fx_alerts") + f"""SELECT dst_port AS class, count(*) AS count,
 CAST(sum(CASE WHEN score >= {THR}e0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
 {sql6(f'avg(CASE WHEN score >= {THR}e0 THEN 1e0 ELSE 0e0 END)')} AS flagged_rate, avg(label) > 0.5e0 AS is_attack FROM fx_alerts GROUP BY 1""")
def per_class(spark, sf):
    out = metrics.per_class(inputs.alerts(spark, sf), "dst_port", F.lit(THR))
    return out.withColumn("flagged_rate", r6("flagged_rate"))


@reg.query("truth_join", duck_with("fx_alerts") + """SELECT class, count(*) AS count FROM fx_alerts a JOIN (
 SELECT concat('a', event_id) AS flow_id, event_type AS class FROM events WHERE event_type IN ('error', 'signup')
 UNION ALL SELECT concat('a', event_id), event_type FROM events WHERE event_type = 'click') t ON t.flow_id = a.flow_id GROUP BY class""")
def truth_join(spark, sf):
    """Two workers' truth tables merged; scores without a truth row are ignored."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("a"), "event_id").alias("flow_id"), F.col("event_type").alias("class"))
    truth = metrics.merge_truth(events.filter(F.col("class").isin("error", "signup")),
                                events.filter(F.col("class") == "click"))
    scores = inputs.alerts(spark, sf).select("flow_id", "score")
    return metrics.join_truth(scores, truth).groupBy("class").agg(F.count(F.lit(1)).alias("count"))


_MS = "(emit_ts - start_ts) * 1000e0"


@reg.query("latency_stats", duck_with(
    "fx_connections",
    f"ok AS (SELECT {_MS} AS ms, row_number() OVER (ORDER BY start_ts, orig_bytes, payload_entropy, duration) AS rn, count(*) OVER () AS m FROM fx_connections)",
    "ph AS (SELECT *, rn > greatest(floor(m * 0.01e0), 1) AS steady FROM ok)") + f"""SELECT count(*) AS count, {sql6('avg(ms)')} AS mean_ms,
 {sql6('quantile_cont(ms, 0.5)')} AS p50_ms, {sql6('quantile_cont(ms, 0.9)')} AS p90_ms, {sql6('quantile_cont(ms, 0.99)')} AS p99_ms,
 {sql6('max(ms)')} AS max_ms, {sql6('max(CASE WHEN NOT steady THEN ms END)')} AS warmup_max_ms,
 {sql6('quantile_cont(CASE WHEN steady THEN ms END, 0.99)')} AS steady_p99_ms, {sql6('max(CASE WHEN steady THEN ms END)')} AS steady_max_ms FROM ph""")
def latency_stats(spark, sf):
    df = inputs.connections(spark, sf).withColumn("latency", F.col("emit_ts") - F.col("start_ts"))
    out = metrics.latency_stats(
        df, "latency", ["start_ts", "orig_bytes", "payload_entropy", "duration"])
    return out.select("count", *[r6(c).alias(c) for c in out.columns if c != "count"])


@reg.query("throughput", duck_with("fx_connections") + f"""SELECT count(*) AS scored, {sql6('max(emit_ts) - min(emit_ts)')} AS window_s,
 (SELECT count(*) FROM lineitem) AS generated, {sql6('count(*) / (max(start_ts) - min(start_ts))')} AS offered_rate,
 {sql6('count(*) / (max(emit_ts) - min(emit_ts))')} AS sustained_rate, 0e0 AS loss_rate,
 count(*) / (max(emit_ts) - min(emit_ts)) >= 10000 AS throughput_pass FROM fx_connections""")
def throughput(spark, sf):
    conns = inputs.connections(spark, sf)
    generated = conns.agg(F.count(F.lit(1))).scalar()
    out = metrics.throughput(conns, "start_ts", "emit_ts", generated, 10_000)
    return out.select("scored", r6("window_s").alias("window_s"), "generated",
                      r6("offered_rate").alias("offered_rate"),
                      r6("sustained_rate").alias("sustained_rate"),
                      r6("loss_rate").alias("loss_rate"), "throughput_pass")


@reg.query("backlog_bounded", f"""SELECT max(v) AS max_backlog, {sql6('avg(v)')} AS mean_backlog, arg_max(v, rn) AS final_backlog,
 {sql6('avg(CASE WHEN rn <= third THEN v END)')} AS first_third, {sql6('avg(CASE WHEN rn > m - third THEN v END)')} AS last_third,
 avg(CASE WHEN rn > m - third THEN v END) <= avg(CASE WHEN rn <= third THEN v END) + 5000 AS bounded FROM (
 SELECT *, greatest(m // 3, 1) AS third FROM (SELECT value AS v, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS m FROM events))""")
def backlog_bounded(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = metrics.backlog(events, "value", ["event_id"])
    return out.select("max_backlog", r6("mean_backlog").alias("mean_backlog"), "final_backlog",
                      r6("first_third").alias("first_third"), r6("last_third").alias("last_third"),
                      "bounded")


_CELL = "CASE event_type WHEN 'click' THEN 0e0 WHEN 'view' THEN 0.05e0 ELSE 0.1e0 END AS hardness, CASE WHEN dst_port < 1024 THEN 0e0 ELSE 0.4e0 END AS drift"


AREAS_SQL = f"""CASE WHEN max(p) > 0 AND max(n) > 0 THEN {sql6('sum(fph * (tp - tph / 2e0)) / nullif(max(p), 0) / nullif(max(n), 0)')} END AS roc_auc,
 CASE WHEN max(p) > 0 AND max(n) > 0 THEN {sql6('sum(tph * (CAST(tp AS DOUBLE) / (tp + fp))) / nullif(max(p), 0)')} END AS pr_auc"""


def rounded_rates(df, *more):
    return _rounded(df, (*_ROUND, *more))


@reg.query("cell_metrics", duck_with(
    "fx_alerts", f"cells AS (SELECT *, {_CELL} FROM fx_alerts)", *curve_ctes("cells", "hardness, drift")) +
    "SELECT c.*, a.roc_auc, a.pr_auc, a.detection_at_fpr_1pct FROM (" + rates_sql(counts_sql("cells", "hardness, drift"), "hardness, drift") +
    f""") c JOIN (SELECT hardness, drift, {AREAS_SQL},
 {sql6('coalesce(max(CASE WHEN fpr <= 0.01e0 THEN tpr END), 0e0)')} AS detection_at_fpr_1pct FROM curve GROUP BY 1, 2) a ON a.hardness = c.hardness AND a.drift = c.drift""")
def cell_metrics(spark, sf):
    cells = inputs.alerts(spark, sf).withColumns({
        "hardness": F.when(F.col("event_type") == "click", 0.0)
        .when(F.col("event_type") == "view", 0.05).otherwise(0.1),
        "drift": F.when(F.col("dst_port") < 1024, 0.0).otherwise(0.4)})
    out = metrics.sweep(cells, ["hardness", "drift"], F.lit(THR))
    return rounded_rates(out, "roc_auc", "pr_auc", "detection_at_fpr_1pct")


@reg.query("model_select", duck_with("fx_alerts") + f"""SELECT {sql6('c')} AS cheap_f1, {sql6('k')} AS costly_f1, {sql6('k - c')} AS gain,
 CASE WHEN k - c > 0.002e0 THEN 'rf' ELSE 'mlp' END AS chosen FROM (SELECT max(CASE WHEN m = 'mlp' THEN f1 END) AS c, max(CASE WHEN m = 'rf' THEN f1 END) AS k FROM (
 SELECT m, 2e0 * tp / (2 * tp + fp + fn) AS f1 FROM {counts_sql("(SELECT *, CASE WHEN dst_port < 1024 THEN 'mlp' ELSE 'rf' END AS m FROM fx_alerts)", "m")}))""")
def model_select(spark, sf):
    scored = inputs.alerts(spark, sf).withColumn(
        "model", F.when(F.col("dst_port") < 1024, "mlp").otherwise("rf"))
    out = metrics.select_model(metrics.confusion(scored, F.lit(THR), ["model"]), "mlp", "rf", 0.002)
    return out.select(r6("cheap_f1").alias("cheap_f1"), r6("costly_f1").alias("costly_f1"),
                      r6("gain").alias("gain"), "chosen")


@reg.query("dataset_summary", duck_with("fx_alerts") + f"""SELECT event_type AS class, count(*) AS rows, CAST(sum(label) AS BIGINT) AS attacks,
 {sql6('count(*) / (SELECT count(*) FROM fx_alerts)')} AS share, {sql6('sum(label) / count(*)')} AS attack_share FROM fx_alerts GROUP BY ROLLUP (event_type)""")
def dataset_summary(spark, sf):
    out = metrics.dataset_summary(inputs.alerts(spark, sf), "event_type")
    return out.withColumns({"share": r6("share"), "attack_share": r6("attack_share")})


@reg.query("median_summary", f"""SELECT event_type, count(*) AS n, {sql6('avg(value)')} AS mean, {sql6('stddev_samp(value)')} AS stdev,
 max(value) AS max, {sql6('quantile_cont(value, 0.5)')} AS median FROM events GROUP BY event_type""")
def median_summary(spark, sf):
    out = stats.summary(spark.read.parquet(f"{sf}/events.parquet"), "value", ["event_type"])
    return out.withColumns({"mean": r6("mean"), "stdev": r6("stdev"), "median": r6("median")})


@reg.query("p95_nearest_rank", "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS m FROM events) WHERE rn - 1 = floor(m * 0.95e0)")
def p95_nearest_rank(spark, sf):
    return stats.nearest_rank(spark.read.parquet(f"{sf}/events.parquet"), "value", 0.95)


@reg.query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    """Interval of the median improvement of 'click' over 'view' values."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return stats.bootstrap_medians_ci(events, "event_type", "value", "view", "click")


_GRID = {"slope": (0.02, 0.035, 0.06), "base": (0.3, 0.45, 0.7), "m": (1.2, 1.35, 1.5)}


def _grid_sql(body: str) -> str:
    vals = [", ".join(f"({v}e0)" for v in vs) for vs in _GRID.values()]
    return f"""WITH grid AS (SELECT * FROM (VALUES {vals[0]}) a(slope), (VALUES {vals[1]}) b(base), (VALUES {vals[2]}) c(m)),
cells AS (SELECT slope, base, m, quantile_cont(m + value * slope, 0.5) AS bm, quantile_cont(m + base + value * slope / 4, 0.5) AS tm
 FROM events, grid GROUP BY 1, 2, 3), done AS (SELECT *, CASE WHEN bm > 0 THEN (bm - tm) / bm ELSE 0e0 END AS improvement FROM cells)
""" + body


def _grid(spark, sf):
    value = F.col("value")
    return stats.grid_sensitivity(
        spark.read.parquet(f"{sf}/events.parquet"),
        lambda p: (p["m"] + value * p["slope"], p["m"] + p["base"] + value * p["slope"] / 4), _GRID)


@reg.query("grid_sensitivity", _grid_sql(
    f"SELECT slope, base, m, {sql6('bm')} AS baseline_median, {sql6('tm')} AS treatment_median, {sql6('improvement')} AS improvement FROM done"))
def grid_sensitivity(spark, sf):
    out = _grid(spark, sf)
    return out.withColumns({c: r6(c) for c in ("baseline_median", "treatment_median", "improvement")})


@reg.query("grid_summary", _grid_sql(
    f"SELECT {sql6('min(improvement)')} AS min, {sql6('max(improvement)')} AS max, {sql6('avg(CASE WHEN improvement >= 0.4e0 THEN 1e0 ELSE 0e0 END)')} AS share_above, count(*) AS cells, {sql6('quantile_cont(improvement, 0.5)')} AS median FROM done"))
def grid_summary(spark, sf):
    out = stats.grid_summary(_grid(spark, sf))
    return out.withColumns({c: r6(c) for c in ("min", "max", "share_above", "median")})


_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


@reg.query("latency_histogram", duck_with("fx_connections") + f"""SELECT le, CAST(sum(CASE WHEN duration <= le THEN 1 ELSE 0 END) AS BIGINT) AS count,
 {sql6('sum(duration)')} AS sum FROM fx_connections, (VALUES {', '.join(f'({b}e0)' for b in _BOUNDS)}, (CAST('inf' AS DOUBLE))) b(le) GROUP BY le""")
def latency_histogram(spark, sf):
    out = stats.bucket_histogram(inputs.connections(spark, sf), "duration", _BOUNDS)
    return out.withColumn("sum", r6("sum"))
