"""All named queries in one place."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("catalog_state", "catalog_flows", "catalog_metrics", "catalog_views",
            "catalog_topology", "catalog_sources", "catalog_stream",
            "catalog_ml")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in _MODULES:
    _reg = import_module(f"netlumen.plans.{_name}").reg
    for _key in _reg.queries:
        if _key in QUERIES:
            raise ValueError(f"query {_key} registered twice")
    QUERIES.update(_reg.queries)
    ORACLE.update(_reg.oracle)
