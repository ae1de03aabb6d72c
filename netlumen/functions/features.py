"""The 47 per-connection features as one projection of native expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.schemas import require_columns, CONNECTION_NUMERIC

# Feature order a trained model depends on.
FEATURE_NAMES = (
    "duration", "log_total_bytes", "log_orig_bytes", "log_resp_bytes",
    "log_total_pkts", "log_orig_pkts", "log_resp_pkts", "bytes_per_pkt",
    "log_bytes_per_sec", "log_pkts_per_sec", "resp_orig_byte_ratio", "resp_orig_pkt_ratio",
    "syn_rate", "ack_rate", "fin_rate", "rst_rate", "psh_rate", "urg_rate",
    "iat_mean", "iat_std", "iat_min", "iat_max", "iat_cv",
    "pkt_size_mean", "pkt_size_std", "pkt_size_min", "pkt_size_max", "pkt_size_range",
    "payload_entropy", "is_tcp", "is_udp", "is_icmp",
    "dst_port_wellknown", "dst_port_registered", "dst_port_ephemeral", "log_dst_port",
    "src_port_ephemeral", "is_http_port", "is_https_port", "is_ssh_port", "is_dns_port",
    "is_rdp_port", "is_smb_port", "tls_present", "log_tls_sni_len", "http_present",
    "log_http_req_count",
)

# Destination ports of each service flag.
SERVICE_PORTS = {
    "is_http_port": (80, 8080), "is_https_port": (443,), "is_ssh_port": (22,),
    "is_dns_port": (53,), "is_rdp_port": (3389,), "is_smb_port": (445, 139),
}


def scrub(value: Column) -> Column:
    """NaN, infinities and NULL become 0."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.coalesce(F.when(bad, F.lit(0.0)).otherwise(value), F.lit(0.0))


def _floor0(name: str) -> Column:
    return F.greatest(F.col(name), F.lit(0.0))


def _known(name: str) -> Column:
    """NaN orders above every number in Spark, so it must not reach a comparison."""
    return F.nanvl(F.col(name), F.lit(None).cast("double"))


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def feature_columns() -> dict[str, Column]:
    orig_bytes, resp_bytes = _floor0("orig_bytes"), _floor0("resp_bytes")
    orig_pkts, resp_pkts = _floor0("orig_pkts"), _floor0("resp_pkts")
    nbytes, npkts = orig_bytes + resp_bytes, orig_pkts + resp_pkts
    per_pkt = F.greatest(npkts, F.lit(1.0))
    duration = _floor0("duration")
    seconds = F.greatest(duration, F.lit(1e-3))
    iat_mean, iat_std = _floor0("iat_mean"), _floor0("iat_std")
    size_min, size_max = _floor0("pkt_size_min"), _floor0("pkt_size_max")
    protocol = _known("protocol")
    port_range = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(65535.0))
    # least/greatest skip NULL, so an unknown port is restored to NULL afterwards.
    dst, src = _known("dst_port"), _known("src_port")
    dst_port = F.when(dst.isNotNull(), port_range(dst))
    src_port = F.when(src.isNotNull(), port_range(src))

    out = {
        "duration": duration,
        "log_total_bytes": F.log1p(nbytes),
        "log_orig_bytes": F.log1p(orig_bytes),
        "log_resp_bytes": F.log1p(resp_bytes),
        "log_total_pkts": F.log1p(npkts),
        "log_orig_pkts": F.log1p(orig_pkts),
        "log_resp_pkts": F.log1p(resp_pkts),
        "bytes_per_pkt": nbytes / per_pkt,
        "log_bytes_per_sec": F.log1p(nbytes / seconds),
        "log_pkts_per_sec": F.log1p(npkts / seconds),
        "resp_orig_byte_ratio": resp_bytes / (orig_bytes + 1.0),
        "resp_orig_pkt_ratio": resp_pkts / (orig_pkts + 1.0),
    }
    for flag in ("syn", "ack", "fin", "rst", "psh", "urg"):
        out[f"{flag}_rate"] = F.col(f"{flag}_count") / per_pkt
    out.update({
        "iat_mean": iat_mean,
        "iat_std": iat_std,
        "iat_min": _floor0("iat_min"),
        "iat_max": _floor0("iat_max"),
        "iat_cv": iat_std / (iat_mean + 1e-9),
        "pkt_size_mean": F.col("pkt_size_mean"),
        "pkt_size_std": F.col("pkt_size_std"),
        "pkt_size_min": size_min,
        "pkt_size_max": size_max,
        "pkt_size_range": F.greatest(size_max - size_min, F.lit(0.0)),
        "payload_entropy": F.col("payload_entropy"),
        "is_tcp": _flag(protocol == 6),
        "is_udp": _flag(protocol == 17),
        "is_icmp": _flag(protocol == 1),
        "dst_port_wellknown": _flag(dst_port < 1024),
        "dst_port_registered": _flag((dst_port >= 1024) & (dst_port < 49152)),
        "dst_port_ephemeral": _flag(dst_port >= 49152),
        "log_dst_port": F.log1p(dst_port),
        "src_port_ephemeral": _flag(src_port >= 49152),
    })
    for name, ports in SERVICE_PORTS.items():
        out[name] = _flag(dst_port.isin(*[float(p) for p in ports]))
    out.update({
        "tls_present": _flag(_known("tls_present") > 0),
        "log_tls_sni_len": F.log1p(_floor0("tls_sni_len")),
        "http_present": _flag(_known("http_present") > 0),
        "log_http_req_count": F.log1p(_floor0("http_req_count")),
    })
    return {name: scrub(out[name]) for name in FEATURE_NAMES}


def extract_features(connections: DataFrame, keep: tuple[str, ...] = ("flow_id",),
                     dtype: str = "double") -> DataFrame:
    """47 feature columns next to the ``keep`` columns. Names in ``keep`` that are
    also features must be renamed by the caller first. The label is never a feature."""
    require_columns(connections, CONNECTION_NUMERIC[:-1], "connection table")
    features = feature_columns()
    return connections.select(*keep, *[c.cast(dtype).alias(n) for n, c in features.items()])


def linear_score(weights: Mapping[str, float], bias: float) -> Column:
    """Logistic score of a weighted sum of features."""
    z = F.lit(float(bias))
    for name, weight in weights.items():
        z = z + F.col(name) * F.lit(float(weight))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def labels_of(connections: DataFrame) -> DataFrame:
    return connections.select("flow_id", F.col("label").cast("double").alias("label"))


def standardise(features: DataFrame, names=FEATURE_NAMES, keep=("flow_id",)) -> DataFrame:
    """Zero mean, unit population deviation; constant columns keep deviation 1.
    The moments are one row, read as scalar subqueries: no second shuffle."""
    moments = features.agg(F.struct(*[
        F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(n) for n in names
    ]).alias("z")).scalar()
    with_moments = features.withColumn("_z", moments)
    return with_moments.select(*keep, *[
        ((F.col(n) - F.col(f"_z.{n}.m"))
         / F.when(F.col(f"_z.{n}.s") > 0, F.col(f"_z.{n}.s")).otherwise(F.lit(1.0))).alias(n)
        for n in names
    ])
