"""Public flow datasets and exporter logs as connection tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.schemas import (CONNECTION_FIELDS, CONNECTION_NUMERIC, CONNECTION_STRINGS,
                               fill_partial)

# Protocol numbers; states that stand in for flag counts.
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "sctp": 132}
SYN_STATES, RST_STATES = ("INT", "REQ", "CON", "FIN"), ("RST", "CLO")
# Class names without categories, in id order; the class of a row without a label.
TWO_CLASSES, NO_LABEL = ("normal", "attack"), "0.0"
# Export columns of the CIC files, with the divisor to base units.
CIC_COLUMNS = {
    "dst_port": ("destination_port", 1), "duration": ("flow_duration", 1e6),
    "orig_bytes": ("total_length_of_fwd_packets", 1),
    "resp_bytes": ("total_length_of_bwd_packets", 1),
    "orig_pkts": ("total_fwd_packets", 1), "resp_pkts": ("total_backward_packets", 1),
    "iat_mean": ("flow_iat_mean", 1e6), "iat_std": ("flow_iat_std", 1e6),
    "iat_min": ("flow_iat_min", 1e6), "iat_max": ("flow_iat_max", 1e6),
    "pkt_size_mean": ("average_packet_size", 1), "pkt_size_std": ("packet_length_std", 1),
    "pkt_size_min": ("min_packet_length", 1), "pkt_size_max": ("max_packet_length", 1),
    **{f"{f}_count": (f"{f}_flag_count", 1) for f in ("syn", "ack", "fin", "rst", "psh", "urg")},
}


def find_files(spark: SparkSession, path: str, patterns: Sequence[str]) -> list[str]:
    """Files matching any pattern, each once, on whatever filesystem ``path`` names."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(path)
    if fs.getFileStatus(root).isFile():
        return [path]
    seen: dict[str, None] = {}
    for pattern in patterns:
        for status in fs.globStatus(hadoop(os.path.join(path, pattern))) or []:
            seen.setdefault(status.getPath().toString())
    if not seen:
        raise FileNotFoundError(f"no file matching {tuple(patterns)} under {path}")
    return list(seen)


def _clean(name: str) -> str:
    return name.strip().lower().replace("/", "_").replace(" ", "_")


def read_csvs(spark: SparkSession, files: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Union by cleaned column name; every cell stays text until it is mapped. Files with
    the same heading line are one read; a heading is asked of a task that stops after it,
    so that no file is read twice. A file without a line is left out."""
    groups: dict[str, list[str]] = {}
    for file in files:
        first = spark.read.option("encoding", encoding).text(file).first()
        if first is not None:
            groups.setdefault(first["value"], []).append(file)
    out = None
    for alike in sorted(sorted(g) for g in groups.values()):
        df = spark.read.option("header", True).option("encoding", encoding).csv(alike)
        df = df.toDF(*[_clean(c) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no heading line in any file")
    return out


def _number(df: DataFrame, name: str, missing: float = 0.0) -> Column:
    """Numeric cell; empty, NaN and infinite read as 0, an absent column and a cell that
    is no number as ``missing``."""
    if name not in df.columns:
        return F.lit(float(missing))
    cell = F.trim(F.col(f"`{name}`").cast("string"))
    value = cell.try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    text = value.isNull() & (F.coalesce(cell, F.lit("")) != "")
    return F.coalesce(F.when(finite, value), F.when(text, F.lit(float(missing))), F.lit(0.0))


def _with_class(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Adds class_id: the place of the class among ``names`` or, without, among the sorted
    class names of the table (dozens, read once as one array)."""
    if names is None:
        known = df.agg(F.array_sort(F.collect_set("class"))).scalar()
    else:
        known = F.array(*map(F.lit, names))
    return df.withColumn("class_id", (F.array_position(known, F.col("class")) - 1).cast("int"))


def _connections(df: DataFrame, columns: dict[str, Column], label: Column, cls: Column,
                 names: Sequence[str] | None = None) -> DataFrame:
    raw = df.select(*[c.cast("double").alias(n) for n, c in columns.items()],
                    label.cast("double").alias("label"), cls.alias("class"))
    full = _with_class(raw, names)
    given = [n for n in full.columns if n in CONNECTION_NUMERIC]
    rest = [n for n in CONNECTION_NUMERIC if n not in given]
    # Fields a dataset does not carry stay zero or empty rather than being invented.
    filled = full.select(
        *[F.lit("").alias(n) for n in CONNECTION_STRINGS],
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in given],
        *[F.lit(0.0).alias(n) for n in rest], "class", "class_id")
    return filled.select(*CONNECTION_FIELDS, "class", "class_id")


def unsw_connections(df: DataFrame) -> DataFrame:
    """UNSW-NB15 rows (cleaned names) as connection records."""
    n = lambda c: _number(df, c)
    text = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    protos = F.create_map(*[F.lit(x) for k, v in PROTOCOLS.items() for x in (k, float(v))])
    sip, dip = n("sinpkt") / 1000.0, n("dinpkt") / 1000.0           # milliseconds
    sm, dm = n("smean"), n("dmean")
    either = lambda a, b: F.when(b > 0, b).otherwise(a)
    columns = {
        "protocol": (F.coalesce(F.try_element_at(protos, F.lower(text("proto"))), F.lit(0.0))
                     if "proto" in df.columns else F.lit(6.0)),
        "src_port": n("sport"), "dst_port": n("dsport" if "dsport" in df.columns else "dport"),
        "duration": n("dur"), "orig_bytes": n("sbytes"), "resp_bytes": n("dbytes"),
        "orig_pkts": n("spkts"), "resp_pkts": n("dpkts"),
        "iat_mean": F.when(dip > 0, (sip + dip) / 2.0).otherwise(sip),
        "iat_std": F.abs(sip - dip) / 2.0, "iat_min": F.least(sip, either(sip, dip)),
        "iat_max": F.greatest(sip, dip),
        "pkt_size_mean": F.when(sm + dm > 0, (sm + dm) / 2.0).otherwise(sm),
        "pkt_size_std": F.abs(sm - dm) / 2.0, "pkt_size_min": F.least(sm, either(sm, dm)),
        "pkt_size_max": F.greatest(sm, dm),
    }
    if "state" in df.columns:
        state = F.upper(text("state"))
        columns |= {"syn_count": state.isin(*SYN_STATES), "rst_count": state.isin(*RST_STATES),
                    "fin_count": state == "FIN"}
    if "service" in df.columns:
        service = F.lower(text("service"))
        columns |= {"http_present": F.contains(service, F.lit("http")),
                    "tls_present": service.rlike("ssl|tls")}
    label = n("label") if "label" in df.columns else F.col("attack_cat").isNotNull()
    cls = (F.trim(F.coalesce("attack_cat", F.lit("Normal"))) if "attack_cat" in df.columns
           else F.when(label.cast("double") == 1, "attack").otherwise("normal"))
    return _connections(df, columns, label, cls, None if "attack_cat" in df.columns else TWO_CLASSES)


def cic_connections(df: DataFrame) -> DataFrame:
    """CIC-IDS-2017 rows (cleaned names) as connection records."""
    if "label" not in df.columns:
        raise ValueError("CIC-IDS CSV has no Label column")
    columns = {"protocol": _number(df, "protocol", 6.0),
               "src_port": _number(df, "source_port", 50_000.0)}
    columns |= {name: _number(df, source) / F.lit(float(unit))
                for name, (source, unit) in CIC_COLUMNS.items()}
    cls = F.coalesce(F.trim("label"), F.lit(NO_LABEL))
    return _connections(df, columns, F.upper(cls) != "BENIGN", cls)


def load_unsw(spark: SparkSession, path: str) -> DataFrame:
    return unsw_connections(read_csvs(spark, find_files(spark, path, ("UNSW*.csv", "*.csv"))))


def load_cic(spark: SparkSession, path: str) -> DataFrame:
    files = find_files(spark, path, ("*.pcap_ISCX.csv", "*.csv"))
    return cic_connections(read_csvs(spark, files, "ISO-8859-1"))


def load_dataset(spark: SparkSession, kind: str, path: str | None = None) -> DataFrame:
    loaders = {"unsw": load_unsw, "cic": load_cic,
               "connections": lambda s, p: s.read.parquet(p)}
    if kind.lower() not in loaders:
        raise ValueError(f"unknown dataset {kind!r}")
    if not path:
        raise ValueError(f"a path is required for dataset {kind!r}")
    return loaders[kind.lower()](spark, path)


def zeek_connections(df: DataFrame, tls: DataFrame | None = None) -> DataFrame:
    """Zeek connection log rows as connection records. Flag counts come from the history
    text, upper case for the originator; the SNI length from the TLS log when given."""
    num = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    history = F.coalesce("history", F.lit(""))
    count = lambda letters: F.regexp_count(history, F.lit(f"[{letters}]")).cast("double")
    protos = F.create_map(*[F.lit(x) for k, v in PROTOCOLS.items() for x in (k, float(v))])
    rows = df.select(
        F.col("uid").alias("flow_id"), F.col("`id.orig_h`").alias("src_ip"),
        F.col("`id.resp_h`").alias("dst_ip"), num("id.orig_p").alias("src_port"),
        num("id.resp_p").alias("dst_port"),
        F.coalesce(F.try_element_at(protos, F.lower("proto")), F.lit(0.0)).alias("protocol"),
        num("ts").alias("start_ts"), (num("ts") + F.coalesce(num("duration"), F.lit(0.0))).alias("emit_ts"),
        *[num(c).alias(c) for c in ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        count("SsHh").alias("syn_count"), count("AaHh").alias("ack_count"),
        count("Ff").alias("fin_count"), count("Rr").alias("rst_count"),
        F.lit(-1.0).alias("label"))
    if tls is not None:
        names = tls.groupBy("uid").agg(F.max(F.length("server_name")).cast("double").alias("tls_sni_len"))
        rows = rows.join(names.withColumnRenamed("uid", "flow_id"), "flow_id", "left").withColumn(
            "tls_present", F.when(F.col("tls_sni_len").isNotNull(), 1.0).otherwise(0.0))
    return fill_partial(rows)


_ZEEK = ("uid", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "ts", "duration", "orig_bytes",
         "resp_bytes", "orig_pkts", "resp_pkts", "history")


def _zeek_log(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A log as JSON lines or as tab-separated lines under a ``#fields`` line. A file's
    columns come from its own ``#fields``; unset and empty fields are NULL."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    json_row = F.from_json("value", ", ".join(f"`{c}` string" for c in columns))
    as_json = lines.filter(F.startswith(F.ltrim("value"), F.lit("{"))).select(json_row.alias("r")).select("r.*")
    heads = lines.filter(F.startswith("value", F.lit("#fields\t"))).groupBy("file").agg(
        F.max(F.split("value", "\t")).alias("names"))
    cells = lines.filter(~F.startswith("value", F.lit("#")) & F.contains("value", F.lit("\t"))
                         & ~F.startswith(F.ltrim("value"), F.lit("{"))).join(heads, "file")
    # The heading has "#fields" before the first name, so positions are one further.
    cell = lambda c: F.get(F.split("value", "\t"), F.array_position("names", c).cast("int") - 2)
    tabbed = cells.select(*[F.when(~cell(c).isin("-", "(empty)"), cell(c)).alias(c) for c in columns])
    return as_json.unionByName(tabbed)


def read_zeek(spark: SparkSession, path: str, tls_path: str | None = None) -> DataFrame:
    """Connection log, JSON lines or tab-separated, with the TLS log beside it when there
    is one."""
    conn = _zeek_log(spark, path, _ZEEK)
    tls = _zeek_log(spark, tls_path, ("uid", "server_name")) if tls_path else None
    return zeek_connections(conn, tls)
