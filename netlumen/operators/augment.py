"""Harder training data: drift, blending toward the opposite label, class mixes.

Randomness is a seeded hash of the flow id, so a row gets the same draw whatever the
partitioning and however often a task is retried.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlumen.operators.scan import UP_TO, running
from netlumen.session import materialize

# Spread of the lognormal drift per column, columns per blend kind.
DRIFT = {"orig_bytes": 1.0, "resp_bytes": 1.0, "duration": 0.8, "orig_pkts": 0.6, "resp_pkts": 0.6,
         "iat_mean": 0.8, "iat_std": 0.9, "pkt_size_mean": 0.3, "pkt_size_std": 0.5,
         "payload_entropy": 0.15}
GEOMETRIC = ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "syn_count",
             "ack_count", "fin_count", "rst_count", "psh_count", "urg_count", "iat_std",
             "pkt_size_std")
LINEAR = ("payload_entropy",)
SWAPPED = ("protocol", "src_port", "dst_port", "tls_present", "tls_sni_len", "http_present",
           "http_req_count")
TIES = ("start_ts", "orig_bytes", "payload_entropy", "duration")     # tell partial records of a flow apart
FLAGS = ("syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count")


def unit(seed: int, *parts: Column | str) -> Column:
    """Uniform draw in (0, 1): 52 bits of the SHA-256 of ``seed:part:...``, which any engine
    can repeat."""
    bits = F.conv(F.substring(_hashed(seed, *parts), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2 ** 52))


def _hashed(seed: int, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def shuffled(seed: int, key: str) -> Column:
    """A column whose order is a seeded shuffle of the keys."""
    return F.substring(_hashed(seed, key), 1, 16)


def normal(seed: int, *parts: Column | str) -> Column:
    u, v = unit(seed, *parts), unit(seed + 1, *parts)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def drift(df: DataFrame, amount: float, seed: int = 7, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Multiplies volumes and timings by lognormal factors, then re-derives the extremes
    of the inter-arrival time. Amount 0 changes nothing."""
    if amount <= 0:
        return df
    shifted = df.withColumns({
        name: F.col(name) * F.exp(normal(seed + 10 * i, *key) * (amount * sigma))
        for i, (name, sigma) in enumerate(DRIFT.items())})
    return shifted.withColumns({
        "iat_min": F.greatest(F.col("iat_mean") - 2 * F.col("iat_std"), F.lit(0.0)),
        "iat_max": F.col("iat_mean") + 3 * F.col("iat_std")})


def restore_invariants(df: DataFrame) -> DataFrame:
    """Counts within packets, bytes at least 40 per packet, no flags off TCP, sizes in
    40..1500, inter-arrival facts derived from duration."""
    # The engine rounds ties to even here, like the arrays the rule was written for.
    op, rp = F.greatest(F.rint("orig_pkts"), F.lit(1.0)), F.greatest(F.rint("resp_pkts"), F.lit(0.0))
    out = df.withColumns({"orig_pkts": op, "resp_pkts": rp})
    pkts = F.col("orig_pkts") + F.col("resp_pkts")
    out = out.withColumns({
        "orig_bytes": F.greatest("orig_bytes", 40.0 * F.col("orig_pkts")),
        "resp_bytes": F.greatest("resp_bytes", 40.0 * F.col("resp_pkts")),
        **{f: F.when(F.col("protocol") == 6, F.least(F.col(f), pkts)).otherwise(0.0) for f in FLAGS}})
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    iat = F.greatest("duration", F.lit(0.0)) / F.greatest(pkts - 1.0, F.lit(1.0))
    istd = F.greatest("iat_std", F.lit(0.0))
    mean = clip((F.col("orig_bytes") + F.col("resp_bytes")) / F.greatest(pkts, F.lit(1.0)), 40.0, 1500.0)
    sstd = F.greatest("pkt_size_std", F.lit(0.0))
    return out.withColumns({
        "iat_mean": iat, "iat_min": F.greatest(iat - 2.0 * istd, F.lit(0.0)),
        "iat_max": iat + 3.0 * istd, "pkt_size_mean": mean,
        "pkt_size_min": clip(mean - 1.8 * sstd, 40.0, 1500.0),
        "pkt_size_max": clip(mean + 2.2 * sstd, 40.0, 1500.0),
        "payload_entropy": clip(F.col("payload_entropy"), 0.0, 4.5)})


def blend_with(df: DataFrame, weight: Column, take: Column, partner: str = "p") -> DataFrame:
    """Moves each row ``weight`` of the way toward its partner, a struct column."""
    other = lambda n: F.col(f"{partner}.{n}")
    floor = lambda c: F.log(F.greatest(c, F.lit(1e-6)))
    mixed = {n: F.exp((1 - weight) * floor(F.col(n)) + weight * floor(other(n))) for n in GEOMETRIC}
    mixed |= {n: (1 - weight) * F.col(n) + weight * other(n) for n in LINEAR}
    mixed |= {n: F.when(take, other(n)).otherwise(F.col(n)) for n in SWAPPED}
    return restore_invariants(df.withColumns(mixed))


def _opposites(df: DataFrame, hardness: float, seed: int) -> tuple[DataFrame, Column]:
    """``df`` with its label's side ``_y`` and the other side's size ``_m``, and which rows a
    blend of ``hardness`` moves."""
    sizes = df.agg(F.struct(F.sum((F.col("label") > 0.5).cast("long")).alias("a"),
                            F.count(F.lit(1)).alias("n"))).scalar()
    marked = df.withColumns({"_y": (F.col("label") > 0.5).cast("int"), "_z": sizes}).withColumn(
        "_m", F.when(F.col("_y") == 1, F.col("_z.n") - F.col("_z.a")).otherwise(F.col("_z.a")))
    return marked, (unit(seed + 1, "flow_id") < hardness) & (F.col("_m") > 0)


def opposite_blends(df: DataFrame, hardness: float, weights: tuple[float, float] = (0.2, 0.7),
                    seed: int = 11) -> DataFrame:
    """The rows that a blend of ``hardness`` moves, moved, with the draw ``_pick`` below
    which a hardness must lie to leave a row alone: what a smaller one moves is among them.

    The pool is numbered in hash order with a sliced scan of the columns that a partner
    gives, and a picked row asks for one number, so the partner join has unique keys on the
    pool side.
    """
    marked, picked = _opposites(df, hardness, seed)
    given = [*GEOMETRIC, *LINEAR, *SWAPPED]
    narrow = df.select(*dict.fromkeys(["flow_id", *TIES, *given]), shuffled(seed, "flow_id").alias("_h"),
                       (F.col("label") > 0.5).cast("int").alias("_y"))
    pool = running(narrow, ["_y"], ["_h", "flow_id", *TIES], sums={"_no": F.lit(1)})
    chosen = marked.filter(picked).withColumns({
        "_ask": F.floor(unit(seed + 2, "flow_id") * F.col("_m")) + 1,
        "_other": 1 - F.col("_y")})
    partners = pool.select(F.col("_y").alias("_other"), F.col("_no").alias("_ask"), F.struct(*given).alias("p"))
    joined = chosen.join(partners, ["_other", "_ask"])
    low, high = weights
    weight = F.lit(low) + (high - low) * unit(seed + 3, "flow_id")
    blended = blend_with(joined.withColumn("_w", weight), F.col("_w"),
                         unit(seed + 4, "flow_id") < F.col("_w"))
    return blended.select(*df.columns, unit(seed + 1, "flow_id").alias("_pick"))


def blend_opposite(df: DataFrame, hardness: float, weights: tuple[float, float] = (0.2, 0.7),
                   seed: int = 11, moved: DataFrame | None = None) -> DataFrame:
    """Blends a seeded share of the rows toward a random row of the other label. ``moved``
    may give :func:`opposite_blends` of the same table, weights and seed, for this hardness
    or a larger one."""
    if hardness <= 0:
        return df
    moved = opposite_blends(df, hardness, weights, seed) if moved is None else moved
    marked, picked = _opposites(df, hardness, seed)
    return marked.filter(~picked).select(*df.columns).unionByName(
        moved.filter(F.col("_pick") < hardness).select(*df.columns))


def normalised_mix(mix: Mapping[str, float], classes: Sequence[str]) -> dict[str, float]:
    """Shares over ``classes``, absent ones 0, summing to 1."""
    full = {c: float(mix.get(c, 0.0)) for c in classes}
    total = sum(full.values())
    if total <= 0:
        raise ValueError("class mix sums to zero")
    return {c: v / total for c, v in full.items()}


def resample_mix(df: DataFrame, cls: str, mix: Mapping[str, float], rows: int,
                 seed: int = 3) -> DataFrame:
    """Up to ``rows`` rows with the wanted class shares, in seeded hash order per class."""
    hashed = df.withColumn("_h", shuffled(seed, "flow_id"))
    ranked = running(hashed, [cls], ["_h", "flow_id"], sums={"_r": F.lit(1)})
    quota = F.create_map(*[F.lit(x) for c, p in mix.items() for x in (c, int(rows * p))])
    return ranked.filter(F.col("_r") <= F.coalesce(F.try_element_at(quota, cls), F.lit(0))).select(*df.columns)


def stratified_split(df: DataFrame, label: str = "label", key: str = "flow_id",
                     train: float = 0.75, seed: int = 20240917) -> DataFrame:
    """Adds ``is_train``: exactly the leading share of every label in hash order. Counts per
    label and hash prefix say in which prefix the share ends; only that one's rows are ranked
    (and written, so that every use sees equal rows parted alike)."""
    hashed = df.filter(F.col(label).isNotNull()).withColumn("_h", shuffled(seed, key)).withColumn(
        "_p", F.substring("_h", 1, 3))
    whole = Window.partitionBy(label)
    upto = F.sum("_n").over(whole.orderBy("_p").rowsBetween(*UP_TO))
    counts = hashed.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n")).select(
        label, "_p", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"),
        F.floor(F.sum("_n").over(whole) * train).alias("_want"))
    # One row per label; a share that takes all rows ends in no prefix.
    ends = materialize(counts.filter((F.col("_before") <= F.col("_want")) & (F.col("_want") < F.col("_upto"))).select(
        label, F.col("_p").alias("_at"), (F.col("_want") - F.col("_before")).alias("_left")), "split-ends")
    placed = hashed.join(ends, label, "left")
    ranked = running(placed.filter("_p = _at"), [label], ["_h", key], sums={"_r": F.lit(1)})
    edge = materialize(ranked.select(*df.columns, (F.col("_r") <= F.col("_left")).alias("is_train")), "split-edge")
    rest = placed.filter(F.coalesce(F.col("_p") != F.col("_at"), F.lit(True)))
    return rest.select(*df.columns, F.coalesce(F.col("_p") < F.col("_at"), F.lit(True)).alias("is_train")).unionByName(edge)
