"""Streaming jobs: sources, stateless detection, roll-ups, sinks, progress."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.operators.correlate import attribute_alerts
from netlumen.operators.flows import merge_partials
from netlumen.operators.rollups import latest_per
from netlumen.operators.views import ticket_rule
from netlumen.session import scratch_path
from netlumen.streaming.stateful import event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def file_stream(spark: SparkSession, path: str, schema=None, files_per_batch: int | None = None,
                fmt: str = "parquet") -> DataFrame:
    """A table as an append stream: a folder of files, or one file. ``files_per_batch``
    bounds a micro-batch."""
    schema = schema or spark.read.format(fmt).load(path).schema
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    return reader.load(f"{path[:-1]}[{path[-1]}]" if _is_file(spark, path) else path)


def _is_file(spark: SparkSession, path: str) -> bool:
    """A streaming source takes a single file only as the match of a pattern."""
    if set(path) & set("*?[{"):
        return False
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str,
          mode: str = "append", trigger: str | None = None):
    """Starts a query. ``sink`` is a folder for parquet or a function per micro-batch.
    Without a trigger interval it works off what is there and ends. A checkpoint in the
    shared folder lets a restarted driver continue where this one stopped."""
    stream.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    if isinstance(sink, str):
        return writer.format("parquet").option("path", sink).start()
    return writer.foreachBatch(sink).start()


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Works off a bounded stream and returns what it wrote. Update and complete output
    keeps the last version of each micro-batch under its number."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    if mode == "append":
        start(stream, out, checkpoint).awaitTermination()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            # A retried micro-batch replaces its own folder, so nothing is written twice.
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        start(stream, keep, checkpoint, mode).awaitTermination()
    return spark.read.schema(_with_batch(stream, mode)).parquet(out)


# Later than any event, and still a timestamp to pandas: the year 2200.
END = 7258118400.0


class Closing:
    """A second source beside a bounded stream that ends it: once all input is worked off,
    one event at the end of time moves the watermark past the last row, so that timers
    fire and windows and sessions come out. The event has no other column, and what it
    opens itself is never due. A stream that goes on must not be closed."""

    def __init__(self, stream: DataFrame, ts: str):
        spark = stream.sparkSession
        self.ts, self.schema = ts, stream.schema
        self.folder = scratch_path(spark, "closing")
        spark.createDataFrame([], self.schema).write.parquet(self.folder)
        self.stream = stream.unionByName(file_stream(spark, self.folder, self.schema))

    def close(self) -> None:
        spark = self.stream.sparkSession
        row = [END if f.name == self.ts else None for f in self.schema]
        loose = type(self.schema)([type(f)(f.name, f.dataType, True) for f in self.schema])
        spark.createDataFrame([tuple(row)], loose).write.mode("append").parquet(self.folder)


def run_bounded(stream: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Works off a bounded stream with a stateful ``job`` and lets out what is still open:
    the same query is started again from its checkpoint with the closing event."""
    spark = stream.sparkSession
    closing = Closing(stream, ts)
    out = job(closing.stream)
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    start(out, path, checkpoint).awaitTermination()
    closing.close()
    start(out, path, checkpoint).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


class LateRows:
    """Parts a stream into rows in time and rows behind the watermark, and counts both per
    micro-batch: the second output beside a stateful job, whose own operators drop late
    rows without a word. The job reads what is in time.

    The watermark of a batch is the greatest time of the batches before it less the
    lateness, as in the stateful operators. A retried batch replaces its own folders and
    reads only what earlier ones wrote."""

    def __init__(self, stream: DataFrame, ts: str, lateness_s: float, label: str):
        self.stream, self.ts, self.lateness_s = stream, ts, lateness_s
        self.path = scratch_path(stream.sparkSession, label)
        self.checkpoint = scratch_path(stream.sparkSession, f"{label}-checkpoint")

    def run(self) -> None:
        """Works off what has arrived since the last run."""
        start(self.stream, self._part, self.checkpoint).awaitTermination()

    def _part(self, batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            last = self.counts().filter(F.col("batch") < number).agg(F.max("last")).first()[0] if number else None
            mark = None if last is None else last - self.lateness_s
            late = F.lit(False) if mark is None else F.coalesce(F.col(self.ts) < mark, F.lit(False))
            kept.filter(~late).write.mode("overwrite").parquet(f"{self.path}/in-time/batch={number}")
            kept.filter(late).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
            kept.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(late.cast("long")), F.lit(0)).alias("late"),
                     F.max(self.ts).cast("double").alias("last"), F.lit(mark).cast("double").alias("watermark")
                     ).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")
        finally:
            kept.unpersist()

    def _read(self, name: str, schema) -> DataFrame:
        return self.stream.sparkSession.read.schema(schema).parquet(f"{self.path}/{name}")

    def counts(self) -> DataFrame:
        """(rows, late, last, watermark, batch)."""
        return self._read("counts", "rows long, late long, last double, watermark double, batch long")

    def in_time(self) -> DataFrame:
        return self._read("in-time", self.stream.schema.add("batch", "long"))

    def late(self) -> DataFrame:
        return self._read("late", self.stream.schema.add("batch", "long"))


def _with_batch(stream: DataFrame, mode: str):
    return stream.schema if mode == "append" else stream.schema.add("batch", "long")


def detect_stream(connections: DataFrame, scorer: Column, threshold: float, now: Column | None = None) -> DataFrame:
    """Features, score and threshold in one stateless stage; ``scorer`` is a column over
    the features. ``training.detect`` does the same with a fitted model."""
    from netlumen.functions.features import extract_features
    from netlumen.functions.severity import to_alerts

    carried = ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "emit_ts", "label")
    return to_alerts(extract_features(connections, keep=carried).withColumn("score", scorer), threshold, now)


def scores_and_alerts_sink(alerts_path: str, scores_path: str | None, threshold: float,
                           now: Callable[[], Column] | None = None):
    """Writes alerts, and every score too when asked, from one pass over the batch."""
    from netlumen.functions.severity import to_alerts

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            to_alerts(kept, threshold, now() if now else None).write.mode("overwrite").parquet(
                f"{alerts_path}/batch={number}")
            if scores_path:
                kept.select("flow_id", "score", "label", "emit_ts").write.mode("overwrite").parquet(
                    f"{scores_path}/batch={number}")
        finally:
            kept.unpersist()

    return write


def merge_stream(records: DataFrame, order: Sequence[str], lateness: str, gap: str = "2 minutes",
                 ts: str = "start_ts") -> DataFrame:
    """Partial records of a flow arriving within ``gap`` of each other become one. Rows
    more than ``lateness`` behind are dropped here: part them off with ``late_rows``."""
    timed = event_time(records, ts).withWatermark("event_time", lateness)
    session = F.session_window("event_time", gap).alias("_session")
    return merge_partials(timed, list(order), extra_keys=[session])


def enrich_sink(read_nodes: Callable[[], DataFrame], path: str):
    """Attributes each micro-batch with the topology as it is at that moment."""
    def write(batch: DataFrame, number: int) -> None:
        attribute_alerts(batch, read_nodes()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_sink(path: str, key: str = "node_id", order: Sequence[str] = ("at",)):
    """Per micro-batch only the newest row of each device."""
    def write(batch: DataFrame, number: int) -> None:
        latest_per(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ticket_sink(path: str, floor: str):
    """Opens a ticket row for every state change at or above a severity."""
    def write(batch: DataFrame, number: int) -> None:
        ticket_rule(batch, floor).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def running_counts(alerts: DataFrame, column: str) -> DataFrame:
    """Ever-growing counts per value; update mode writes only the values that a batch
    changed, complete mode all of them."""
    return alerts.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def window_counts(alerts: DataFrame, lateness: str, width: str = "60 seconds", slide: str | None = None,
                  ts: str = "detected_at") -> DataFrame:
    """Alerts per tumbling or sliding window of event time."""
    timed = event_time(alerts, ts).withWatermark("event_time", lateness)
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return timed.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        (F.unix_micros("w.start") / 1e6).alias("from_s"), "n")


def idle_sessions(packets: DataFrame, lateness: str, idle: str = "15 seconds") -> DataFrame:
    """Conversations cut at idle gaps only: packets and bytes per session."""
    from netlumen.operators.flows import keyed

    timed = event_time(keyed(packets)).withWatermark("event_time", lateness)
    return timed.groupBy("flow_key", F.session_window("event_time", idle).alias("w")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"),
        F.min("ts").alias("start_ts")).drop("w")


def deduplicated(alerts: DataFrame, lateness: str, ts: str = "detected_at") -> DataFrame:
    """Redelivered alerts once, as long as they come within the lateness."""
    timed = event_time(alerts, ts).withWatermark("event_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["flow_id", ts])


def progress_rows(query) -> list[dict]:
    """What each micro-batch did: rows, rates, duration, state size."""
    out = []
    for p in query.recentProgress:
        body = json.loads(p.json) if hasattr(p, "json") else p
        out.append({
            "batch": body["batchId"], "rows": body.get("numInputRows", 0),
            "input_rate": float(body.get("inputRowsPerSecond") or 0.0),
            "processed_rate": float(body.get("processedRowsPerSecond") or 0.0),
            "trigger_ms": body.get("durationMs", {}).get("triggerExecution", 0),
            "state_rows": sum(s.get("numRowsTotal", 0) for s in body.get("stateOperators", []))})
    return out


def progress_table(spark: SparkSession, query) -> DataFrame:
    """The kept progress reports (a bounded list) as a table."""
    return spark.createDataFrame(
        progress_rows(query) or [], "batch long, rows long, input_rate double, "
        "processed_rate double, trigger_ms long, state_rows long")
