"""Training, scoring and the report document."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with, spark_view
from netlumen.functions.features import linear_score
from netlumen.operators import forest, metrics
from netlumen.plans import inputs, training
from netlumen.plans.catalog_flows import SCORER, SCORER_BIAS, SCORER_THRESHOLD, _Z
from netlumen.plans.catalog_metrics import AREAS_SQL, THR, counts_sql, curve_ctes, rates_sql, rounded_rates
from netlumen.plans.catalog_sources import mixed_sql, normal_sql, unit_sql
from netlumen.plans.registry import Registry, r6, sql6
from netlumen.session import scratch_path
from netlumen.sources import topology_io

reg = Registry()


@reg.query("train_detector")
def train_detector(spark, sf):
    """Both candidates on the labelled connections; one row of held-out quality each."""
    meta = training.train(inputs.connections(spark, sf), scratch_path(spark, "model"))
    rows = [(name, m["recall"], m["precision"], m["f1"], m["fpr"], m["roc_auc"], m["threshold"],
             m["threshold_rule"], name == meta["model"]) for name, m in meta["candidates"].items()]
    return spark.createDataFrame(
        rows, "model string, recall double, precision double, f1 double, fpr double, roc_auc double, "
        "threshold double, rule string, chosen boolean")


@reg.query("detect_connections")
def detect_connections(spark, sf):
    """Train, store, load again, score every connection and keep the alerts."""
    conns, path = inputs.connections(spark, sf), scratch_path(spark, "model")
    training.train(conns, path)
    model, meta = training.load(spark, path)
    out = training.detect(conns, model, training.threshold_of(meta))
    return out.select("flow_id", "src_ip", "dst_ip", "score", "threshold", "label")


# The features the fixture's forest asks for.
_ASKED = ("duration", "orig_bytes", "dst_port", "payload_entropy", "ack_count")


@reg.query("forest_scores", duck_with(
    "fx_forest fx_connections", f"""walk AS (SELECT rid, flow_id, start_ts, {', '.join(_ASKED)}, tree, 0 AS node
 FROM (SELECT *, row_number() OVER () AS rid FROM fx_connections), (SELECT DISTINCT tree FROM fx_forest) UNION ALL
 SELECT rid, flow_id, start_ts, {', '.join(_ASKED)}, w.tree, CASE WHEN (CASE feature {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_ASKED))} END) <= threshold THEN lo ELSE hi END
 FROM walk w JOIN fx_forest f ON f.tree = w.tree AND f.node = w.node WHERE f.feature IS NOT NULL)""", recursive=True) +
    f"""SELECT flow_id, {sql6('start_ts')} AS start_ts, {sql6('duration')} AS duration, {sql6('avg(p)')} AS score FROM walk w
 JOIN fx_forest f ON f.tree = w.tree AND f.node = w.node AND f.feature IS NULL GROUP BY rid, flow_id, start_ts, duration""")
def forest_scores(spark, sf):
    """Every connection scored by the forest of the node table."""
    rows = inputs.connections(spark, sf).select("flow_id", "start_ts", *_ASKED)
    out = forest.forest_scores(rows, spark_view(spark, sf, "fx_forest"), _ASKED)
    return out.select("flow_id", r6("start_ts").alias("start_ts"), r6("duration").alias("duration"), r6("score").alias("score"))


@reg.query("benchmark_report", duck_with("fx_alerts fx_connections") + f"""SELECT d.tp, d.fp, d.fn, d.tn, t.scored, {sql6('t.rate')} AS sustained_rate, {sql6('l.p50')} AS p50_ms, k.classes
 FROM {counts_sql('fx_alerts')} d, (SELECT count(*) AS scored, count(*) / (max(emit_ts) - min(emit_ts)) AS rate FROM fx_connections) t,
 (SELECT quantile_cont((emit_ts - start_ts) * 1000e0, 0.5) AS p50 FROM fx_connections) l, (SELECT count(DISTINCT dst_port) AS classes FROM fx_alerts) k""")
def benchmark_report(spark, sf):
    alerts, conns = inputs.alerts(spark, sf), inputs.connections(spark, sf)
    timed = conns.withColumn("latency", F.col("emit_ts") - F.col("start_ts"))
    doc = topology_io.report(
        metrics.confusion(alerts, F.lit(THR)),
        metrics.latency_stats(timed, "latency", ["start_ts", "orig_bytes", "payload_entropy", "duration"]),
        metrics.throughput(conns, "start_ts", "emit_ts", conns.agg(F.count(F.lit(1))).scalar(), 10_000),
        metrics.per_class(alerts, "dst_port", F.lit(THR)), {"threshold": str(THR)})
    return doc.select("detection.tp", "detection.fp", "detection.fn", "detection.tn", "throughput.scored",
                      r6("throughput.sustained_rate").alias("sustained_rate"),
                      r6("latency.p50_ms").alias("p50_ms"),
                      F.size("per_class").cast("long").alias("classes"))


# The grid of the sweep, and what the scorer reads of a row.
HARDNESS, DRIFTS = (0.0, 0.05, 0.1), (0.0, 0.4)
_VOLUMES = ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")
_BLENDED = {
    "orig_pkts": f"greatest(round_even({mixed_sql('orig_pkts')}, 0), 1e0)",
    "resp_pkts": f"greatest(round_even({mixed_sql('resp_pkts')}, 0), 0e0)",
    "payload_entropy": "least(greatest((1 - w) * payload_entropy + w * p_payload_entropy, 0e0), 4.5e0)",
    "protocol": "CASE WHEN take < w THEN p_protocol ELSE protocol END"}
_BLENDED |= {f"{d}_bytes": f"greatest({mixed_sql(d + '_bytes')}, 40 * {_BLENDED[d + '_pkts']})" for d in ("orig", "resp")}
_READ = (*_VOLUMES, "payload_entropy", "protocol")


@reg.query("difficulty_sweep", duck_with(
    "fx_connections", "lab AS (SELECT *, CASE WHEN label > 0.5 THEN 1 ELSE 0 END AS y FROM fx_connections WHERE label >= 0)",
    f"""drawn AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY substr(sha256('11:' || flow_id), 1, 16), flow_id, start_ts, orig_bytes, payload_entropy, duration) AS no,
 (SELECT count(*) FROM lab) - count(*) OVER (PARTITION BY y) AS m, {unit_sql(12)} AS pick, {unit_sql(13)} AS ask, 0.2e0 + 0.5e0 * {unit_sql(14)} AS w, {unit_sql(15)} AS take FROM lab)""",
    f"hs AS (SELECT unnest([{', '.join(f'{h}e0' for h in HARDNESS)}]) AS hardness)",
    f"""met AS (SELECT hardness, a.*, b.flow_id IS NOT NULL AS hit, {', '.join(f'b.{c} AS p_{c}' for c in _READ)} FROM hs, drawn a
 LEFT JOIN drawn b ON a.pick < hardness AND b.y = 1 - a.y AND b.no = floor(a.ask * a.m) + 1)""",
    f"mixed AS (SELECT hardness, flow_id, label, {', '.join(f'CASE WHEN hit THEN {_BLENDED[c]} ELSE {c} END AS {c}' for c in _READ)} FROM met)",
    f"""moved AS (SELECT hardness, drift, label, protocol, {', '.join(f'{c} * exp(drift * {normal_sql(c)}) AS {c}' for c in _READ[:-1])}
 FROM mixed, (SELECT unnest([{', '.join(f'{d}e0' for d in DRIFTS)}]) AS drift))""",
    f"cells AS (SELECT hardness, drift, label, {sql6(f'1e0 / (1e0 + exp(-({_Z})))')} AS score FROM moved)",
    *curve_ctes("cells", "hardness, drift")) +
    "SELECT c.*, a.roc_auc, a.pr_auc, a.detection_at_fpr_1pct FROM (" +
    rates_sql(counts_sql("cells", "hardness, drift", f"{SCORER_THRESHOLD}e0"), "hardness, drift") +
    f""") c JOIN (SELECT hardness, drift, {AREAS_SQL},
 {sql6('coalesce(max(CASE WHEN fpr <= 0.01e0 THEN tpr END), 0e0)')} AS detection_at_fpr_1pct FROM curve GROUP BY 1, 2) a ON a.hardness = c.hardness AND a.drift = c.drift""")
def difficulty_sweep(spark, sf):
    """Quality on copies of the labelled connections, blended and drifted ever more."""
    rows = inputs.connections(spark, sf).filter(F.col("label") >= 0)
    grid = metrics.difficulty_grid(rows, HARDNESS, DRIFTS, r6(linear_score(SCORER, SCORER_BIAS)))
    out = metrics.sweep(grid, ["hardness", "drift"], F.lit(SCORER_THRESHOLD))
    return rounded_rates(out, "roc_auc", "pr_auc", "detection_at_fpr_1pct")
