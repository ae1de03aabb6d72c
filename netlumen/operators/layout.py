"""Deterministic positions: districts on a ring, hosts on discs, infrastructure above."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlumen.functions.net import stable_unit
from netlumen.operators.scan import running
from netlumen.operators.topology import both_ways
from netlumen.session import materialize

# Height per layer, layer per device type, the golden angle.
LAYER_HEIGHT = {0: 0.0, 1: 15.0, 2: 30.0, 3: 46.0}
LAYER_OF_TYPE = {"router": 3, "firewall": 3, "switch": 1, "wireless_ap": 1}
GOLDEN_ANGLE = math.pi * (3.0 - math.sqrt(5.0))
AGGREGATORS = ("switch", "wireless_ap")


def layers(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``layer``: by type, and 2 for a switch or access point with at least two
    distinct switch or access-point neighbours."""
    base = F.lit(0)
    for kind, layer in LAYER_OF_TYPE.items():
        base = F.when(F.col("device_type") == kind, layer).otherwise(base)
    infra = nodes.filter(F.col("device_type").isin(*AGGREGATORS)).select("id")
    edges = both_ways(links).select("id", "peer")
    edges = (edges.join(infra, "id", "left_semi")
             .join(infra.withColumnRenamed("id", "peer"), "peer", "left_semi").distinct())
    wide = edges.groupBy("id").agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") >= 2)
    out = nodes.join(wide, "id", "left")
    return out.withColumn("layer", F.when(F.col("_d").isNotNull(), 2).otherwise(base)).drop("_d")


def district_centers(hosts: DataFrame, spread: float) -> DataFrame:
    """(subnet, n, cx, cz): subnets in name order on a ring that grows with the root of
    the host count; a single subnet sits in the middle."""
    # One row per subnet from here on.
    sizes = hosts.groupBy("subnet").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    i = F.row_number().over(Window.orderBy("subnet")) - 1
    count, total = F.count(F.lit(1)).over(whole), F.sum("n").over(whole)
    sizes = sizes.withColumns({"_i": i, "_c": count, "_t": total})
    radius = F.lit(spread) * F.sqrt("_t") / 2.0
    angle = F.lit(2 * math.pi) * F.col("_i") / F.col("_c")
    alone = F.col("_c") == 1
    return sizes.select("subnet", "n", F.when(alone, 0.0).otherwise(radius * F.cos(angle)).alias("cx"),
                        F.when(alone, 0.0).otherwise(radius * F.sin(angle)).alias("cz"))


def place_hosts(hosts: DataFrame, centers: DataFrame, spread: float, jitter: float) -> DataFrame:
    """Even spiral over the district disc, in id order, with a little stable jitter."""
    ranked = running(hosts, ["subnet"], ["id"], sums={"_rn": F.lit(1)})
    rows = ranked.join(centers, "subnet")
    i = F.col("_rn") - 1
    radius = F.lit(spread) * F.sqrt(F.greatest("n", F.lit(1))) / 2.2
    r = radius * F.sqrt((i + 0.5) / F.col("n"))
    theta = F.lit(GOLDEN_ANGLE) * i
    one = F.col("n") <= 1
    dx = F.when(one, 0.0).otherwise(r * F.cos(theta))
    dz = F.when(one, 0.0).otherwise(r * F.sin(theta))
    shake = lambda axis, size: (stable_unit(F.concat("id", F.lit(axis))) - 0.5) * size
    return rows.select(
        *hosts.columns, (F.col("cx") + dx + shake("x", jitter)).alias("x"),
        (F.lit(LAYER_HEIGHT[0]) + shake("y", jitter * 2)).alias("y"),
        (F.col("cz") + dz + shake("z", jitter)).alias("z"))


def _place_tier(tier: DataFrame, placed: DataFrame, edges: DataFrame, centers: DataFrame,
                layer: int, spread: float) -> DataFrame:
    """Positions of one infrastructure tier. Devices of a tier are placed in id order
    and anchor on their earlier neighbours too, so they are placed in rounds: each
    round takes every device whose earlier neighbours in the tier have a position."""
    ids = tier.select("id")
    near = edges.join(ids, "id", "left_semi")
    below = near.join(placed.select(F.col("id").alias("peer"), "x", "z"), "peer").groupBy("id").agg(
        F.sum("x").alias("_lx"), F.sum("z").alias("_lz"), F.count(F.lit(1)).alias("_ln"))
    deps = near.join(ids.withColumnRenamed("id", "peer"), "peer", "left_semi").filter(
        F.col("peer") < F.col("id")).select("id", "peer")
    need = deps.groupBy("id").agg(F.count(F.lit(1)).alias("_need"))
    seats = running(tier, [], ["id"], sums={"_rn": F.lit(1)})
    seats = seats.withColumn("_c", tier.agg(F.count(F.lit(1))).scalar())
    angle = F.lit(2 * math.pi) * (F.col("_rn") - 1) / F.greatest(F.col("_c"), F.lit(1))
    spine = spread * 1.2 * (layer - 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    base = (seats.join(below, "id", "left").join(need, "id", "left")
            .join(centers.select("subnet", "cx", "cz"), "subnet", "left"))
    base = materialize(base.select(
        "id", zero("_lx"), zero("_lz"), zero("_ln"), zero("_need"),
        F.coalesce("cx", F.lit(spine) * F.cos(angle)).alias("_fx"),
        F.coalesce("cz", F.lit(spine) * F.sin(angle)).alias("_fz")), f"tier-{layer}")
    have = F.col("_ln") > 0
    done = base.filter(F.col("_need") == 0).select(
        "id", F.when(have, F.col("_lx") / F.col("_ln")).otherwise(F.col("_fx")).alias("x"),
        F.when(have, F.col("_lz") / F.col("_ln")).otherwise(F.col("_fz")).alias("z"))
    waiting = base.filter(F.col("_need") > 0)
    if waiting.isEmpty():
        return done
    deps, done = materialize(deps, f"tier-links-{layer}"), materialize(done, f"placed-{layer}")
    while True:
        got = deps.join(done.withColumnRenamed("id", "peer"), "peer").groupBy("id").agg(
            F.sum("x").alias("_sx"), F.sum("z").alias("_sz"), F.count(F.lit(1)).alias("_sn"))
        ready = (waiting.join(got, "id").filter(F.col("_sn") == F.col("_need"))
                 .join(done.select("id"), "id", "left_anti"))
        n = F.col("_ln") + F.col("_sn")
        step = materialize(ready.select(
            "id", ((F.col("_lx") + F.col("_sx")) / n).alias("x"),
            ((F.col("_lz") + F.col("_sz")) / n).alias("z")), f"round-{layer}")
        if step.isEmpty():
            return done
        done = done.unionByName(step)


def compute_layout(nodes: DataFrame, links: DataFrame, spread: float = 9.0,
                   jitter: float = 0.35) -> DataFrame:
    """Adds layer, x, y, z. Infrastructure sits over the mean of its already placed
    neighbours, tier by tier; without any it takes its district, else a ring."""
    # Devices and infrastructure edges are read many times below: write them once.
    tiered = materialize(layers(nodes, links), "layers")
    names = [*tiered.columns, "x", "y", "z"]
    hosts = tiered.filter(F.col("layer") == 0).withColumn(
        "_subnet", F.col("subnet")).withColumn(
        "subnet", F.coalesce(F.nullif("subnet", F.lit("")), F.lit("unknown")))
    centers = district_centers(hosts, spread)
    placed = place_hosts(hosts, centers, spread, jitter).withColumn("subnet", F.col("_subnet"))
    placed = materialize(placed.select(*names), "hosts")
    infra = tiered.filter(F.col("layer") > 0).select("id")
    edges = both_ways(links).select("id", "peer").join(infra, "id", "left_semi").distinct()
    edges = materialize(edges, "infra-edges")
    for layer in (1, 2, 3):
        tier = tiered.filter(F.col("layer") == layer)
        at = _place_tier(tier, placed, edges, centers, layer, spread)
        rows = tier.join(at, "id").withColumn("y", F.lit(LAYER_HEIGHT[layer]))
        placed = placed.unionByName(rows.select(*names))
    return placed


def bounds(nodes: DataFrame) -> DataFrame:
    """Axis-aligned bounds, centre and half the largest extent (1 when it is 0)."""
    box = nodes.agg(*[f(F.col(c)).alias(f"{p}_{c}") for p, f in (("min", F.min), ("max", F.max))
                      for c in "xyz"])
    filled = box.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in box.columns])
    half = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]) / 2
    return filled.select(
        "*", *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"center_{c}") for c in "xyz"],
        F.when(half == 0, F.lit(1.0)).otherwise(half).alias("radius"))
