"""Streams fed file by file, held to the batch operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netlumen.operators import flows, state
from netlumen.plans import inputs
from netlumen.schemas import CONNECTION_NUMERIC
from netlumen.streaming import jobs, stateful


def in_files(df, path, order, n):
    """Writes a table as n files in time order; each becomes one micro-batch."""
    rows = df.orderBy(order).toPandas()
    step = math.ceil(len(rows) / n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(rows.iloc[i * step:(i + 1) * step], df.schema)
        part.coalesce(1).write.parquet(f"{path}/part={i:03d}")
    return df.schema


def source(spark, path, schema):
    return jobs.file_stream(spark, f"{path}/part=*", schema, files_per_batch=1)


def test_flow_assembly_over_batches_equals_batch(spark, sf, tmp_path):
    packets = inputs.packets(spark, sf)
    schema = in_files(packets, str(tmp_path / "in"), "ts", 4)
    out = jobs.run_bounded(source(spark, str(tmp_path / "in"), schema), "ts",
                           lambda rows: stateful.assemble_flows(rows, "0 seconds"), "f")
    streamed = {r.flow_id: r for r in out.collect()}
    segmented = flows.segments(packets)
    reasons = {r.flow_id: r.reason for r in flows.close_reasons(segmented).collect()}
    batch = {r.flow_id: r for r in flows.flow_records(segmented).collect()}
    # The closing event lets out what is still open, so nothing is left behind.
    assert streamed.keys() == batch.keys() and len(streamed) == out.count()
    for f in batch:
        assert streamed[f].reason == reasons[f]
        for c in CONNECTION_NUMERIC:
            assert math.isclose(streamed[f][c], batch[f][c], rel_tol=1e-6, abs_tol=1e-4), (f, c)


def test_a_long_conversation_over_batches_equals_batch(spark, tmp_path):
    """Segments that go on from batch to batch, closed by time, by FINs and by RST."""
    rng, rows, t = random.Random(5), [], 1000.0
    for i in range(600):
        t += rng.choice([0.25, 1.0, 4.0, 16.0] if rng.random() < 0.1 else [0.25, 1.0, 4.0])
        low = rng.random() < 0.5
        ends = ("10.0.0.1", "10.0.0.2", 5000, 80) if low else ("10.0.0.2", "10.0.0.1", 80, 5000)
        flags = rng.choice([16] * 40 + [17, 17, 4])
        rows.append((i, t, *ends, 6, rng.randint(40, 1500), flags, i % 9, i % 11 == 0))
    packets = spark.createDataFrame(rows, inputs.packets(spark, "/root/testdata/sf0.001").schema)
    schema = in_files(packets, str(tmp_path / "in"), "ts", 5)
    out = jobs.run_bounded(source(spark, str(tmp_path / "in"), schema), "ts",
                           lambda p: stateful.assemble_flows(p, "0 seconds"), "long").collect()
    batch = {r.flow_id: r for r in flows.flow_records(flows.segments(packets)).collect()}
    assert {r.flow_id for r in out} == batch.keys() and len(out) == len(batch) > 20
    for r in out:
        for c in CONNECTION_NUMERIC:
            assert math.isclose(r[c], batch[r.flow_id][c], rel_tol=1e-6, abs_tol=1e-4), (r.flow_id, c)


def test_late_rows_are_parted_off_and_counted(spark, tmp_path):
    df = spark.createDataFrame([(0, 100.0), (0, 50.0), (1, 95.0), (1, 80.0), (1, 300.0), (2, 285.0), (2, 295.0), (2, None)], "part int, ts double")
    folder = str(tmp_path / "in")
    split = jobs.LateRows(jobs.file_stream(spark, f"{folder}/d-*", "ts double"), "ts", 10.0, "parted")
    for i in range(3):
        df.filter(F.col("part") == i).select("ts").write.parquet(f"{folder}/d-{i}")
        split.run()
    assert sorted((r.batch, r.rows, r.late, r.watermark) for r in split.counts().collect()) == [
        (0, 2, 0, None), (1, 3, 1, 90.0), (2, 3, 1, 290.0)]
    assert sorted(r.ts for r in split.late().collect()) == [80.0, 285.0]
    assert split.in_time().count() == 6


def alerts(spark, rows):
    data = [(i, f"f{i}", n, float(t), float(s), a, None, "9.9.9.9", 443) for i, (n, t, s, a) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, flow_id string, node_id string, ts double, score double, "
                                       "is_ack boolean, peer_node_id string, dst_ip string, dst_port int")


def run_states(spark, df, path, n):
    schema = in_files(df, path, "event_id", n)
    out = jobs.run_to_table(stateful.live_states(source(spark, path, schema), "0 seconds"), "s")
    return sorted(((r.at, r.node_id, r.cause, r.severity, round(r.score, 6), r.alert_count) for r in out.collect()))


def test_live_state_cools_without_input_and_honours_acks(spark, tmp_path):
    df = alerts(spark, [("n", 100, 0.96, False), ("m", 101, 0.9, False), ("m", 102, 0.0, True), ("m", 103, 0.4, False),
                        ("z", 5000, 0.5, False), ("z", 5001, 0.5, False)])
    got = run_states(spark, df, str(tmp_path / "in"), 3)
    n = [g for g in got if g[1] == "n"]
    assert [g[2] for g in n] == ["alert"] + ["cooling"] * 5
    assert [g[3] for g in n] == ["critical", "high", "medium", "low", "info", "none"]
    fall = lambda b: 130 + 120 * math.log2(0.96 / b)
    for g, bound in zip(n[1:], (0.95, 0.8, 0.55, 0.3, 0.05)):
        assert abs(g[0] - fall(bound)) < 0.01
    m = [g for g in got if g[1] == "m"]
    assert [(g[2], g[3], g[5]) for g in m[:3]] == [("alert", "high", 1), ("ack", "none", 1), ("alert", "low", 1)]


def test_live_state_equals_batch_scores(spark, sf, tmp_path):
    ev = inputs.state_events(spark, sf).withColumn("is_ack", F.lit(False)).select(
        "event_id", "flow_id", "node_id", "ts", "score", "is_ack", "peer_node_id", "dst_ip", "dst_port")
    schema = in_files(ev, str(tmp_path / "in"), "ts", 3)
    out = jobs.run_to_table(stateful.live_states(source(spark, str(tmp_path / "in"), schema), "0 seconds"), "s")
    got = {r.flow_id: r.score for r in out.filter("cause = 'alert'").collect()}
    want = {r.flow_id: r.score for r in state.score_timeline(ev).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_late_rows_do_not_break_assembly(spark, tmp_path):
    p = spark.createDataFrame([(1, 10.0, "a", "b", 1, 2, 6, 60, 2, 0, False), (2, 11.0, "c", "d", 1, 2, 6, 60, 2, 0, False),
                               (3, 5.0, "a", "b", 1, 2, 6, 60, 16, 0, False), (4, 400.0, "c", "d", 1, 2, 6, 60, 16, 0, False)],
                              inputs.packets(spark, "/root/testdata/sf0.001").schema)
    schema = in_files(p, str(tmp_path / "in"), "event_id", 4)
    out = jobs.run_to_table(stateful.assemble_flows(source(spark, str(tmp_path / "in"), schema), "0 seconds"), "late").collect()
    # The packet behind the watermark is dropped; the flow it belongs to still closes.
    assert sorted((r.src_ip, r.orig_pkts, r.reason) for r in out) == [("a", 1, "idle"), ("c", 1, "idle")]


def test_sinks_and_progress(spark, sf, tmp_path):
    conns = inputs.connections(spark, sf).withColumn("score", F.least(F.col("payload_entropy") / 4, F.lit(1.0)))
    schema = in_files(conns.limit(400), str(tmp_path / "in"), "flow_id", 2)
    sink = jobs.scores_and_alerts_sink(str(tmp_path / "alerts"), str(tmp_path / "scores"), 0.5)
    query = jobs.start(source(spark, str(tmp_path / "in"), schema), sink, str(tmp_path / "cp"))
    query.awaitTermination()
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert scores.count() == 400
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == scores.filter("score >= 0.5").count()
    progress = jobs.progress_table(spark, query)
    assert progress.agg(F.sum("rows")).first()[0] == 400
    # A restart from the same checkpoint finds nothing new.
    again = jobs.start(source(spark, str(tmp_path / "in"), schema), sink, str(tmp_path / "cp"))
    again.awaitTermination()
    assert sum(r["rows"] for r in jobs.progress_rows(again)) == 0


def test_ticket_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "high"), ("b", "low"), ("c", "critical")], "node_id string, severity string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.start(jobs.file_stream(spark, str(tmp_path / "in")), jobs.ticket_sink(str(tmp_path / "t"), "high"), str(tmp_path / "cp")).awaitTermination()
    assert {r.node_id for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a", "c"}


def test_unbounded_output_needs_no_trigger(spark, sf, tmp_path):
    with pytest.raises(Exception):
        jobs.run_to_table(jobs.running_counts(jobs.file_stream(spark, f"{sf}/events.parquet"), "event_type"), "x", "append")


def test_streams_read_tables_of_one_file_and_of_many(spark, sf, tmp_path):
    folder = str(tmp_path / "events.parquet")
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(folder)
    for path in (f"{sf}/events.parquet", folder, folder + "/"):
        out = jobs.run_to_table(jobs.file_stream(spark, path).select("event_id"), "as-stream")
        assert out.count() == out.distinct().count() == 1000, path


def test_stream_merge_state_holds_asked_columns_only(spark, sf, monkeypatch):
    """What the query does not return is neither aggregated, nor kept in state, nor written."""
    from netlumen.plans import catalog_stream

    seen = {}

    def bounded(stream, ts, job, label):
        seen["plan"] = str(job(inputs.connections(spark, sf))._jdf.queryExecution().sparkPlan())
        return stream.sparkSession.createDataFrame([], "flow_id string, orig_bytes double, tls_sni_len double, duration double")

    monkeypatch.setattr(catalog_stream.jobs, "run_bounded", bounded)
    assert catalog_stream.stream_merge(spark, sf).columns == ["flow_id", "orig_bytes", "tls_sni_len", "duration"]
    assert "sum(orig_bytes" in seen["plan"] and "resp_bytes" not in seen["plan"] and "pkt_size_mean" not in seen["plan"]


def test_flows_leave_python_in_few_columns(spark):
    """A column of a frame costs the same for one flow as for thousands, and each conversation has its own frame."""
    import pandas as pd

    class Handle:
        body = None
        exists = lambda self: self.body is not None
        get, clear = lambda self: self.body, lambda self: setattr(self, "body", None)
        update, registerTimer = lambda self, v: setattr(self, "body", v), lambda self, at: None
        getValueState = lambda self, *a: self

    rows = pd.DataFrame([(1, 10.0, "a", "b", None, 2, 6, 60, 2, 0, False, True, "h"), (2, 11.0, "b", "a", 2, None, 6, 70, 4, 0, True, False, "h"),
                         (3, 12.0, "a", "b", 1, 2, 6, 80, 16, 0, False, True, "h")],
                        columns=["event_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "tcp_flags",
                                 "tls_sni_len", "is_http_request", "from_low", "key_hash"])
    keeper = stateful.FlowAssembler()
    keeper.init(Handle())
    frames = list(keeper.handleInputRows(("k",), iter([rows]), None))
    assert [list(f.columns) for f in frames] == [["flow_id", "src_ip", "dst_ip", "reason", "numbers"]]
    packed = spark.createDataFrame([(*f[:4], [float(x) for x in f[4]]) for f in frames[0].itertuples(index=False)], stateful._FLOW_PACKED)
    out = stateful._unpacked(packed)
    assert out.schema == stateful.FLOW_OUTPUT
    r = out.first()
    assert (r.flow_id, r.reason, r.src_port, r.dst_port, r.orig_bytes, r.resp_bytes, r.rst_count) == ("c-h-1", "closed", None, 2.0, 60.0, 70.0, 1.0)
