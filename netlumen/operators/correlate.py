"""Attribute an alert (two addresses) to a device of the topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlumen.functions.net import is_internal, normalize_mac, prefix_key
from netlumen.functions.severity import severity_of

# How well a device type stands in for its whole subnet.
GATEWAY_RANK = {"router": 3, "firewall": 3, "switch": 2, "wireless_ap": 1}
PREFERENCES = ("internal", "source", "destination")


def _addresses(nodes: DataFrame):
    own = F.array(F.col("ip"))
    if "ips" in nodes.columns:
        own = F.concat(own, F.coalesce("ips", F.array().cast("array<string>")))
    return own


def address_index(nodes: DataFrame) -> DataFrame:
    """address -> node id; of several claimants the first node wins."""
    return (nodes.select(F.explode(_addresses(nodes)).alias("addr"), "id", "ord")
            .filter(F.col("addr") != "")
            .groupBy("addr").agg(F.min_by("id", "ord").alias("node_id")))


def mac_index(nodes: DataFrame) -> DataFrame:
    return (nodes.filter(F.col("mac") != "").groupBy("mac")
            .agg(F.min_by("id", "ord").alias("node_id")))


def asset_index(nodes: DataFrame) -> DataFrame:
    """Asset tags are node tags of the form ``asset:<identifier>``."""
    tag = F.explode("tags").alias("tag")
    return (nodes.select(tag, "id", "ord").filter(F.startswith("tag", F.lit("asset:")))
            .groupBy(F.substr("tag", F.lit(7)).alias("asset"))
            .agg(F.min_by("id", "ord").alias("node_id")))


def subnet_gateways(nodes: DataFrame) -> DataFrame:
    """One gateway per subnet: the most infrastructural device, first on ties.
    ``idx`` is the order in which subnets are tried."""
    rank = F.lit(0)
    for kind, value in GATEWAY_RANK.items():
        rank = F.when(F.col("device_type") == kind, F.lit(value)).otherwise(rank)
    infra = nodes.filter((F.col("subnet") != "") & (rank > 0))
    per_subnet = infra.groupBy("subnet").agg(
        F.min_by("id", F.struct((-rank).alias("r"), "ord")).alias("gateway_id"),
        F.min("ord").alias("idx"))
    address = F.substring_index("subnet", "/", 1)
    bits = F.coalesce(F.expr("try_cast(get(split(subnet, '/'), 1) as int)"),
                      F.when(F.contains("subnet", F.lit(":")), 128).otherwise(32))
    return (per_subnet.withColumn("prefix_len", bits)
            .withColumn("network", prefix_key(address, F.col("prefix_len")))
            .filter(F.col("network").isNotNull()))


def resolve_addresses(addresses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (addr) -> (addr, node_id, method, internal): exact address first, then
    the gateway of a containing subnet.

    Containment is an equi join: an unmatched address is expanded into one network
    name per prefix length that occurs among the gateways, a scalar subquery of at
    most 161 numbers, instead of being compared with every subnet.
    """
    gateways = subnet_gateways(nodes)
    lengths = gateways.agg(F.array_sort(F.collect_set("prefix_len")).alias("p")).scalar()
    exact = addresses.join(address_index(nodes), "addr", "left").withColumn(
        "_p", F.when(F.col("node_id").isNull(), lengths))
    tried = exact.select("addr", "node_id", F.explode_outer("_p").alias("_p"))
    tried = tried.withColumn("network", prefix_key(F.col("addr"), F.col("_p")))
    found = tried.join(gateways.select("network", "gateway_id", "idx"), "network", "left")
    return found.groupBy("addr").agg(
        F.max("node_id").alias("_exact"), F.min_by("gateway_id", "idx").alias("_gw"),
    ).select(
        "addr", F.coalesce("_exact", "_gw").alias("node_id"),
        F.when(F.col("_exact").isNotNull(), "ip").when(F.col("_gw").isNotNull(), "subnet")
        .otherwise("unresolved").alias("method"),
        is_internal(F.col("addr")).alias("internal"))


def attribute_alerts(alerts: DataFrame, nodes: DataFrame, prefer: str = "internal") -> DataFrame:
    """Adds node_id, peer_node_id, correlation, unresolved_ip and severity.

    Each distinct address is resolved once. Joins carry no broadcast hint: Spark
    broadcasts a side only below its size threshold and splits skewed partitions
    otherwise. ``alerts`` may carry ``mac`` and ``asset_tag``, which take precedence.
    """
    if prefer not in PREFERENCES:
        raise ValueError(f"prefer must be one of {PREFERENCES}")
    ends = alerts.select(F.explode(F.array("src_ip", "dst_ip")).alias("addr")).distinct()
    resolved = resolve_addresses(ends.filter(F.col("addr").isNotNull()), nodes)
    src = resolved.select(F.col("addr").alias("src_ip"), F.col("node_id").alias("_sn"),
                          F.col("method").alias("_sm"), F.col("internal").alias("_si"))
    dst = resolved.select(F.col("addr").alias("dst_ip"), F.col("node_id").alias("_dn"),
                          F.col("method").alias("_dm"), F.col("internal").alias("_di"))
    out = alerts.join(src, "src_ip", "left").join(dst, "dst_ip", "left")
    src_in, dst_in = F.coalesce("_si", F.lit(False)), F.coalesce("_di", F.lit(False))
    sn, dn = F.col("_sn"), F.col("_dn")
    if prefer == "source":
        dst_first = F.lit(False)
    elif prefer == "destination":
        dst_first = F.lit(True)
    else:
        dst_first = ~(src_in & sn.isNotNull()) & dst_in & dn.isNotNull()
    take_dst = F.when(dst_first, dn.isNotNull()).otherwise(sn.isNull() & dn.isNotNull())
    node = F.when(take_dst, dn).otherwise(sn)
    peer = F.when(take_dst, sn).otherwise(F.when(sn.isNotNull(), dn))
    method = (F.when(take_dst, F.col("_dm")).when(sn.isNotNull(), F.col("_sm"))
              .otherwise("unresolved"))
    out = out.withColumns({"node_id": node, "peer_node_id": peer, "correlation": method})
    # A hit on hardware address or asset tag overrides both ends and names no peer.
    for column, index, label in (("asset_tag", asset_index, "asset"), ("mac", mac_index, "mac")):
        if column not in alerts.columns:
            continue
        key = "asset" if column == "asset_tag" else "mac"
        hits = index(nodes).select(F.col(key).alias("_hk"), F.col("node_id").alias("_hn"))
        want = normalize_mac(F.col("mac")) if column == "mac" else F.col(column)
        out = out.join(hits, want == F.col("_hk"), "left")
        found = F.col("_hn").isNotNull()
        out = out.withColumns({
            "peer_node_id": F.when(~found, F.col("peer_node_id")),
            "correlation": F.when(found, label).otherwise(F.col("correlation")),
            "node_id": F.coalesce("_hn", "node_id"),
        }).drop("_hk", "_hn")
    missing = F.when(src_in | ~dst_in, F.col("src_ip")).otherwise(F.col("dst_ip"))
    return out.select(*alerts.columns, "node_id", "peer_node_id", "correlation",
                      F.when(F.col("node_id").isNull(), missing).alias("unresolved_ip"),
                      severity_of(F.col("score")).alias("severity"))


def unresolved_report(attributed: DataFrame, top: int | None = None) -> DataFrame:
    """Alerts per address no device accounts for, most frequent first."""
    counts = (attributed.filter(F.col("node_id").isNull())
              .groupBy(F.col("unresolved_ip").alias("ip"))
              .agg(F.count(F.lit(1)).alias("alerts")))
    return counts if top is None else counts.orderBy(F.desc("alerts"), "ip").limit(top)


def correlation_stats(attributed: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: index sizes and unresolved totals."""
    lost = F.col("node_id").isNull()
    # Distinct addresses are counted after a map-side combine on the address.
    per_ip = attributed.filter(lost).groupBy("unresolved_ip").agg(F.count(F.lit(1)).alias("n"))
    return per_ip.agg(
        F.count(F.lit(1)).alias("unresolved_addresses"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("unresolved_alerts"),
    ).withColumns({
        "indexed_ips": address_index(nodes).agg(F.count(F.lit(1))).scalar(),
        "indexed_macs": mac_index(nodes).agg(F.count(F.lit(1))).scalar(),
        "subnets": subnet_gateways(nodes).agg(F.count(F.lit(1))).scalar(),
    })
