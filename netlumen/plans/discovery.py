"""Sightings of all sources to a placed topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlumen.operators.layout import compute_layout
from netlumen.operators.scan import global_rank
from netlumen.operators.topology import build_links, build_nodes
from netlumen.session import materialize
from netlumen.sources.topology_io import previous_as_observations


def union_sightings(*tables: DataFrame) -> DataFrame:
    """Batches of one layout in order of precedence (neighbour tables, link-layer reports,
    SNMP, earlier topology); columns a batch lacks are empty. ``ord`` is numbered anew over
    all batches, so that no two sightings share a place, whatever numbers the parsers gave
    and however often two of them agree."""
    out = None
    for rank, t in enumerate(tables):
        t = t.withColumn("_rank", F.lit(rank))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    tie = F.xxhash64(*[c for c, kind in out.dtypes if not kind.startswith("map")])
    # Parsers are read once; ranges read their rows several times.
    out = materialize(out, "sightings")
    ranked = global_rank(out, ["_rank", "ord", tie], "_place")
    return materialize(ranked.withColumn("ord", F.col("_place")).drop("_rank", "_place"), "numbered")


def build_topology(hosts: DataFrame, link_sightings: DataFrame, prefix: int = 24,
                   infer: bool = True, previous: DataFrame | None = None,
                   registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with positions, links). ``previous`` devices join as further sightings,
    after everything seen now."""
    if previous is not None:
        hosts = union_sightings(hosts, previous_as_observations(previous, 2 ** 62))
    # Links and layout read the devices several times.
    nodes = materialize(build_nodes(hosts, prefix, registry), "nodes")
    links = materialize(build_links(link_sightings, nodes, infer), "links")
    return compute_layout(nodes, links), links
