"""Sightings to devices, links and facts about the resulting graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.functions import devices
from netlumen.functions.net import is_locally_administered, normalize_mac, subnet_of
from netlumen.schemas import HOST_OBSERVATION, INFRA_TYPES
from netlumen.session import materialize
from netlumen.sources.oui import with_vendor

# Tags that name a role rather than a team.
ROLE_TAGS = ("infrastructure", "access", "distribution", "core", "wireless")


def observations(df: DataFrame) -> DataFrame:
    """The fixed observation layout; absent columns are empty."""
    out = []
    for field in HOST_OBSERVATION:
        value = (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def identify(obs: DataFrame) -> DataFrame:
    """Adds ``identity``, the key of the device a sighting belongs to.

    A sighting keeps its own key once an earlier (or this) sighting established it;
    a key is established by the first sighting under it whose host name is empty or
    new. Before that, the sighting joins the device its host name is known for. Both
    facts are aggregates over ``ord``, so no order of execution is involved.
    """
    host = F.lower(F.trim(F.coalesce("hostname", F.lit(""))))
    keyed = obs.withColumns({
        "_key": devices.observation_key(F.col("mac"), F.col("ip"), F.col("hostname")),
        "_host": host})
    names = (keyed.filter(F.col("_host") != "").groupBy("_host")
             .agg(F.min(F.struct("ord", "_key")).alias("_first")))
    # Most sightings have no name; they skip the join instead of meeting in one task.
    nameless = keyed.filter(F.col("_host") == "").withColumn(
        "_first", F.lit(None).cast(names.schema["_first"].dataType))
    known = keyed.filter(F.col("_host") != "").join(names, "_host", "left").unionByName(nameless)
    opens = (F.col("_host") == "") | (F.col("ord") == F.col("_first.ord"))
    keys = known.filter(opens).groupBy("_key").agg(F.min("ord").alias("_since"))
    placed = known.join(keys, "_key", "left")
    own = F.coalesce(F.col("_since") <= F.col("ord"), F.lit(False))
    return placed.select(*obs.columns,
                         F.when(own, F.col("_key")).otherwise(F.col("_first._key")).alias("identity"))


def merge_sightings(obs: DataFrame) -> DataFrame:
    """One row per device: first non-empty attribute, union of services, sources, extra
    addresses, and the latest value of every extra entry.

    Lists are reduced to their distinct members before they are gathered, so a device
    sighted a billion times costs its distinct values only.
    """
    # Five aggregations read the identified sightings: write them once.
    rows = materialize(identify(observations(obs)), "sightings")

    def first(name: str) -> Column:
        filled = F.col(name) != ""
        return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.col("ord"))).alias(name)

    attributes = ("ip", "mac", "hostname", "interface", "device_type_hint", "vendor_hint", "os_hint")
    base = rows.groupBy("identity").agg(F.min("ord").alias("ord"), *[first(a) for a in attributes])
    services = _distinct_in_order(rows, "services")
    source = F.explode(F.split(F.coalesce("source", F.lit("")), r"\+")).alias("s")
    sources = (rows.select("identity", source).filter(F.col("s") != "").groupBy("identity")
               .agg(F.array_sort(F.collect_set("s")).alias("discovered_by")))
    seen = F.array_append(F.coalesce("extra_ips", F.array().cast("array<string>")), F.col("ip"))
    ips = (rows.select("identity", F.explode(seen).alias("a")).filter(F.col("a") != "")
           .groupBy("identity").agg(F.array_sort(F.collect_set("a")).alias("_ips")))
    extra = (rows.select("identity", "ord", F.explode("extra").alias("k", "v"))
             .groupBy("identity", "k").agg(F.max_by("v", "ord").alias("v"))
             .groupBy("identity").agg(F.map_from_entries(F.array_sort(F.collect_list(
                 F.struct("k", "v")))).alias("extra")))
    out = base
    for part in (services, sources, ips, extra):
        out = out.join(part, "identity", "left")
    none = F.array().cast("array<string>")
    others = F.filter(F.coalesce("_ips", none), lambda a: ~a.eqNullSafe(F.col("ip")))
    all_ips = F.when(F.col("ip").isNotNull(), F.concat(F.array("ip"), others)).otherwise(others)
    return out.select(
        "identity", "ord", *attributes, F.coalesce("services", none).alias("services"),
        F.coalesce("discovered_by", none).alias("discovered_by"), all_ips.alias("ips"), "extra")


def _distinct_in_order(rows: DataFrame, name: str) -> DataFrame:
    items = rows.select("identity", "ord", F.posexplode(name).alias("_p", "_v"))
    once = items.groupBy("identity", "_v").agg(F.min(F.struct("ord", "_p")).alias("_o"))
    packed = F.array_sort(F.collect_list(F.struct("_o", "_v")))
    return once.groupBy("identity").agg(F.transform(packed, lambda x: x["_v"]).alias(name))


def build_nodes(obs: DataFrame, prefix: int = 24, registry: DataFrame | None = None) -> DataFrame:
    """Devices from sightings: identity, vendor, type, addresses, tags."""
    merged = merge_sightings(obs)
    merged = merged.withColumn("mac_norm", normalize_mac(F.col("mac")))
    named = with_vendor(merged, registry, "mac_norm")
    vendor = F.coalesce("vendor_hint", "vendor")
    kind = devices.device_type(F.col("device_type_hint"), F.col("os_hint"), F.col("hostname"),
                               F.col("vendor"))
    local = is_locally_administered(F.col("mac_norm"))
    named = named.withColumn("vendor", vendor).withColumn("device_type", kind)
    tags = F.array_compact(F.array(
        F.when(local, "randomized-mac"),
        F.when(F.col("device_type").isin(*INFRA_TYPES), "infrastructure")))
    return named.select(
        devices.node_id(F.col("mac"), F.col("ip"), F.col("hostname")).alias("id"),
        F.coalesce("hostname", "ip", "mac_norm", F.lit("unknown")).alias("name"),
        "ip", "ips", F.col("mac_norm").alias("mac"), "vendor", "device_type",
        F.coalesce("os_hint", F.lit("")).alias("os"),
        subnet_of(F.col("ip"), prefix).alias("subnet"), tags.alias("tags"), "services",
        "discovered_by", "ord")


def _names(nodes: DataFrame) -> DataFrame:
    """Every text a link endpoint may use for a device, with the device's place."""
    entries = F.array_compact(F.array(
        F.concat(F.lit("n:"), F.lower("name")), F.concat(F.lit("i:"), F.col("ip"))))
    if "ips" in nodes.columns:
        entries = F.concat(entries, F.transform(F.coalesce("ips", F.array().cast("array<string>")),
                                                lambda a: F.concat(F.lit("i:"), a)))
    if "mac" in nodes.columns:
        entries = F.concat(entries, F.array_compact(F.array(F.concat(F.lit("m:"), F.col("mac")))))
    rows = nodes.select(F.explode(entries).alias("_k"), "id", "ord")
    return rows.groupBy("_k").agg(F.min(F.struct("ord", "id")).alias("_hit"))


def resolve_endpoints(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``local_id`` and ``remote_id``: by hardware address, then by name or
    address (first device wins), then by reading the text as a hardware address."""
    ends = []
    for side in ("local", "remote"):
        text = F.col(side)
        ends.append(F.struct(
            F.lit(side).alias("side"),
            F.array_compact(F.array(
                F.struct(F.lit(1).alias("p"), F.concat(F.lit("m:"), normalize_mac(
                    F.col(f"{side}_mac"))).alias("k")),
                F.struct(F.lit(2).alias("p"), F.concat(F.lit("n:"), F.lower(F.trim(
                    F.nullif(text, F.lit(""))))).alias("k")),
                F.struct(F.lit(2).alias("p"), F.concat(F.lit("i:"), F.nullif(
                    text, F.lit(""))).alias("k")),
                F.struct(F.lit(3).alias("p"), F.concat(F.lit("m:"), normalize_mac(
                    text)).alias("k")))).alias("keys")))
    # What an endpoint says decides what it is: equal texts are looked up once, and the
    # answer is joined to every sighting by those texts, so no sighting's place is a key.
    said = {side: F.struct(F.coalesce(F.col(f"{side}_mac"), F.lit("")), F.coalesce(F.col(side), F.lit("")))
            for side in ("local", "remote")}
    asked = links.select(F.explode(F.array(*[
        F.struct(said[e].alias("said"), end["keys"].alias("keys")) for e, end in zip(said, ends)])).alias("e"))
    tried = (asked.select("e.said", "e.keys").distinct().select("said", F.explode("keys").alias("c"))
             .select("said", "c.p", F.col("c.k").alias("_k")).filter(F.col("_k").isNotNull()))
    found = materialize(tried.join(_names(nodes), "_k").groupBy("said").agg(
        F.min(F.struct("p", "_hit"))["_hit"]["id"].alias("id")), "endpoints")
    out = links
    for side in ("local", "remote"):
        answer = found.select(F.col("said").alias("_said"), F.col("id").alias(f"{side}_id"))
        out = out.join(answer, said[side] == F.col("_said"), "left").drop("_said")
    return out


def _pair(a: Column, b: Column) -> dict[str, Column]:
    return {"source": F.least(a, b), "target": F.greatest(a, b)}


def _link_id() -> Column:
    return F.concat(F.lit("l-"), F.col("source"), F.lit("-"), F.col("target"))


def measured_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected links between known devices: no self links, first sighting wins."""
    ends = resolve_endpoints(links, nodes)
    valid = ends.filter(F.col("local_id").isNotNull() & F.col("remote_id").isNotNull()
                        & (F.col("local_id") != F.col("remote_id")))
    pairs = valid.select(
        *[c.alias(n) for n, c in _pair(F.col("local_id"), F.col("remote_id")).items()],
        "ord", "kind", "bandwidth_mbps", "source_name" if "source_name" in links.columns
        else F.col("source").alias("source_name"))
    first = pairs.groupBy("source", "target").agg(
        F.min_by(F.struct("kind", "bandwidth_mbps", "source_name"),
                 F.struct("ord", "source_name", "kind", "bandwidth_mbps")).alias("f"))
    return first.select(
        _link_id().alias("id"), "source", "target", F.col("f.kind").alias("kind"),
        F.col("f.bandwidth_mbps").alias("bandwidth_mbps"),
        F.array("f.source_name").alias("discovered_by"))


def inferred_uplinks(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Unconnected hosts hang off the first switch of their subnet, else off the first
    switch or router anywhere; such a link is marked as inferred."""
    connected = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    hosts = (nodes.filter(~F.col("device_type").isin(*INFRA_TYPES))
             .select("id", "subnet").join(connected, "id", "left_anti"))
    switches = (nodes.filter(F.col("device_type").isin("switch", "wireless_ap"))
                .groupBy("subnet").agg(F.min_by("id", "ord").alias("_sw")))
    fallback = (nodes.filter(F.col("device_type").isin("switch", "router"))
                .agg(F.min_by("id", "ord")).scalar())
    up = hosts.join(switches, "subnet", "left").withColumn("_up", F.coalesce("_sw", fallback))
    pairs = up.filter(F.col("_up").isNotNull() & (F.col("_up") != F.col("id"))).select(
        *[c.alias(n) for n, c in _pair(F.col("id"), F.col("_up")).items()])
    return pairs.select(
        _link_id().alias("id"), "source", "target", F.lit("inferred").alias("kind"),
        F.lit(None).cast("int").alias("bandwidth_mbps"),
        F.array(F.lit("inference:subnet")).alias("discovered_by"))


def build_links(links: DataFrame, nodes: DataFrame, infer: bool = True) -> DataFrame:
    measured = measured_links(links, nodes)
    return measured.unionByName(inferred_uplinks(nodes, measured)) if infer else measured


def both_ways(links: DataFrame) -> DataFrame:
    """Each undirected link once per direction: (id, peer, kind)."""
    return links.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("peer")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("peer")),
    )).alias("e"), "kind").select("e.id", "e.peer", "kind")


def neighbours(links: DataFrame, node: str | None = None) -> DataFrame:
    out = both_ways(links)
    return out if node is None else out.filter(F.col("id") == node)


def present_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose two ends are both in the topology."""
    ids = nodes.select("id")
    for end in ("source", "target"):
        links = links.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return links


def drop_orphans(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """State of devices that still exist."""
    return states.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def removed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after.select("id"), "id", "left_anti")


def topology_stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Counts by type and subnet in one pass, with the totals and the vendor list."""
    from netlumen.operators.rollups import counts_by

    counts = counts_by(nodes, {"device_type": "device_type", "subnet": "subnet"}, total=True)
    vendors = nodes.agg(F.array_sort(F.collect_set("vendor"))).scalar()
    n_links = links.agg(F.count(F.lit(1))).scalar()
    total = F.col("dim") == "total"
    return counts.select("dim", "value", "n", F.when(total, n_links).alias("links"),
                         F.when(total, F.array_join(vendors, ",")).alias("vendors"))


def clusters(nodes: DataFrame, states: DataFrame | None = None, members: int = 8) -> DataFrame:
    """Subnets of at least ``members`` devices: centroid, radius, most common team tag,
    worst severity inside."""
    from netlumen.functions.severity import severity_from_rank, severity_rank

    subnet = F.coalesce(F.nullif("subnet", F.lit("")), F.lit("unknown"))
    rows = nodes.withColumn("subnet", subnet)
    if states is not None:
        s = states.select(F.col("node_id").alias("id"), severity_rank(F.col("severity")).alias("_r"))
        rows = rows.join(s, "id", "left")
    else:
        rows = rows.withColumn("_r", F.lit(0))
    shape = rows.groupBy("subnet").agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(f"c{c}") for c in "xyz"],
        F.max(F.coalesce("_r", F.lit(0))).alias("_w")).filter(F.col("members") >= members)
    tags = (rows.select("subnet", "ord", F.posexplode("tags").alias("_p", "tag"))
            .filter(~F.col("tag").isin(*ROLE_TAGS)).groupBy("subnet", "tag")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "_p")).alias("_o")))
    # Most frequent tag; the one met first wins a tie.
    best = tags.groupBy("subnet").agg(
        F.max("n").alias("_m")).join(tags, "subnet").filter(F.col("n") == F.col("_m"))
    label = best.groupBy("subnet").agg(F.min_by("tag", "_o").alias("label"))
    return shape.join(label, "subnet", "left").select(
        "subnet", "members", F.coalesce("label", "subnet").alias("label"), "cx", "cy", "cz",
        F.greatest(F.lit(2.2), F.cbrt(F.col("members").cast("double")) * 1.6).alias("radius"),
        severity_from_rank(F.col("_w")).alias("worst"))


def compact(nodes: DataFrame, links: DataFrame, digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Positional node table (index, fields) and links that name nodes by index."""
    from netlumen.operators.scan import global_rank

    ranked = global_rank(nodes, ["id"], "_rn")
    n = ranked.withColumn("idx", F.col("_rn") - 1)
    optional = lambda c, e: F.coalesce(F.col(c), F.lit(e)) if c in nodes.columns else F.lit(e)
    table = n.select(
        "idx", "id", "name", optional("ip", "").alias("ip"), optional("mac", "").alias("mac"),
        optional("vendor", "unknown").alias("vendor"), "device_type", optional("os", "").alias("os"),
        "subnet", optional("site", "default").alias("site"),
        optional("criticality", 1).alias("criticality"), "layer",
        *[F.round(c, digits).alias(c) for c in "xyz"],
        (F.col("tags") if "tags" in nodes.columns else F.array().cast("array<string>")).alias("tags"))
    key = table.select("id", "idx")
    src = key.select(F.col("id").alias("source"), F.col("idx").alias("source_idx"))
    dst = key.select(F.col("id").alias("target"), F.col("idx").alias("target_idx"))
    edges = links.join(src, "source").join(dst, "target").select("source_idx", "target_idx", "kind")
    return table, edges


def expand(table: DataFrame, edges: DataFrame) -> DataFrame:
    """Inverse of :func:`compact` for links: names instead of indices."""
    key = table.select("idx", "id")
    src = key.select(F.col("idx").alias("source_idx"), F.col("id").alias("source"))
    dst = key.select(F.col("idx").alias("target_idx"), F.col("id").alias("target"))
    return edges.join(src, "source_idx").join(dst, "target_idx").select("source", "target", "kind")


def run_summary(observed: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Sightings per source, and how many links were measured or inferred."""
    per_source = observed.groupBy("source").agg(F.count(F.lit(1)).alias("observations"))
    counted = links.agg(F.struct(
        F.count(F.lit(1)).alias("links"),
        F.sum((F.col("kind") == "inferred").cast("long")).alias("inferred"))).scalar()
    return (per_source.withColumn("_l", counted)
            .withColumn("nodes", nodes.agg(F.count(F.lit(1))).scalar())
            .select("source", "observations", "nodes", F.col("_l.links").alias("links"),
                    (F.col("_l.links") - F.col("_l.inferred")).alias("links_measured"),
                    F.col("_l.inferred").alias("links_inferred")))
