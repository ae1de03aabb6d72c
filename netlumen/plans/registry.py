"""Named queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.session import tune

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
            if sql is not None:
                self.oracle[name] = sql
            return fn

        return add


def r6(value: Column | str) -> Column:
    """Round for comparison; the nudge keeps both engines off exact ties."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(1e-9), 6)


def r6_plain(name: str) -> Column:
    """``r6`` of a column, the same doubles without a decimal number per value: whole millionths,
    divided. Where the product may lie on the other side of a tie, ``round`` decides."""
    value = F.col(name) + F.lit(1e-9)
    scaled = value * F.lit(1e6)
    whole = F.rint(scaled)
    slack = F.abs(scaled) * F.lit(2.0 ** -51)
    sure = (F.abs(scaled) < F.lit(2.0 ** 50)) & (F.abs(scaled - whole) + slack < F.lit(0.5))
    return F.when(sure, whole / F.lit(1e6) + F.lit(0.0)).otherwise(F.round(value, 6))


def sql6(expr: str) -> str:
    return f"round({expr} + 1e-9, 6)"


SEVERITY_SQL = ("CASE WHEN {s} >= 0.95e0 THEN 'critical' WHEN {s} >= 0.8e0 THEN 'high' "
                "WHEN {s} >= 0.55e0 THEN 'medium' WHEN {s} >= 0.3e0 THEN 'low' ELSE 'info' END")
RANK_SQL = ("CASE {v} WHEN 'none' THEN 0 WHEN 'info' THEN 1 WHEN 'low' THEN 2 "
            "WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 5 END")


def severity_sql(score: str) -> str:
    return SEVERITY_SQL.format(s=score)


def rank_sql(severity: str) -> str:
    return RANK_SQL.format(v=severity)


def decayed_sql(score: str, elapsed: str, hl: float = 120, dwell: float = 30) -> str:
    """Score after ``elapsed`` seconds, 0 once clear."""
    cooled = f"{score} * pow(0.5e0, ({elapsed} - {dwell}e0) / {hl}e0)"
    return (f"CASE WHEN {score} <= 0 OR {elapsed} <= {dwell}e0 THEN {score} "
            f"WHEN {cooled} < 0.05e0 THEN 0.0e0 ELSE {cooled} END")


def v4_sql(ip: str) -> str:
    part = lambda i: f"CAST(split_part({ip}, '.', {i}) AS BIGINT)"
    return f"({part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)})"


def internal_sql(ip: str) -> str:
    n = v4_sql(ip)
    return (f"({n} BETWEEN 167772160 AND 184549375 OR {n} BETWEEN 2886729728 AND 2887778303 "
            f"OR {n} BETWEEN 3232235520 AND 3232301055 OR {n} BETWEEN 1681915904 AND 1686110207 "
            f"OR {n} BETWEEN 2851995648 AND 2852061183)")


# Attribution as SQL, shared by the oracles that start from attributed alerts.
ATTRIBUTION_CTES = (
    "by_ip AS (SELECT ip AS addr, min(id) AS node_id FROM fx_nodes GROUP BY ip)",
    """infra AS (SELECT id, subnet, CASE device_type WHEN 'router' THEN 3 WHEN 'firewall' THEN 3
 WHEN 'switch' THEN 2 WHEN 'wireless_ap' THEN 1 ELSE 0 END AS r FROM fx_nodes)""",
    """gw AS (SELECT subnet, id AS gateway_id FROM (SELECT *, row_number() OVER (PARTITION BY subnet
 ORDER BY r DESC, id) AS k FROM infra WHERE r > 0) WHERE k = 1)""",
    "ends AS (SELECT src_ip AS addr FROM fx_alerts UNION SELECT dst_ip FROM fx_alerts)",
    """res AS (SELECT e.addr, coalesce(b.node_id, g.gateway_id) AS node_id,
 CASE WHEN b.node_id IS NOT NULL THEN 'ip' WHEN g.gateway_id IS NOT NULL THEN 'subnet' ELSE 'unresolved' END AS method
 FROM ends e LEFT JOIN by_ip b ON b.addr = e.addr
 LEFT JOIN gw g ON g.subnet = regexp_extract(e.addr, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1) || '.0/24')""",
    f"""pick AS (SELECT a.*, s.node_id AS sn, s.method AS sm, d.node_id AS dn, d.method AS dm,
 {internal_sql('a.src_ip')} AS si, {internal_sql('a.dst_ip')} AS di
 FROM fx_alerts a LEFT JOIN res s ON s.addr = a.src_ip LEFT JOIN res d ON d.addr = a.dst_ip)""",
    f"""attr AS (SELECT *, detected_at AS ts,
 CASE WHEN si AND sn IS NOT NULL THEN sn WHEN di AND dn IS NOT NULL THEN dn ELSE coalesce(sn, dn) END AS node_id,
 CASE WHEN si AND sn IS NOT NULL THEN dn WHEN di AND dn IS NOT NULL THEN sn
      WHEN sn IS NOT NULL THEN dn ELSE NULL END AS peer_node_id,
 CASE WHEN si AND sn IS NOT NULL THEN sm WHEN di AND dn IS NOT NULL THEN dm
      WHEN sn IS NOT NULL THEN sm WHEN dn IS NOT NULL THEN dm ELSE 'unresolved' END AS correlation,
 CASE WHEN sn IS NULL AND dn IS NULL THEN CASE WHEN si OR NOT di THEN src_ip ELSE dst_ip END END AS unresolved_ip,
 {severity_sql('score')} AS severity FROM pick)""",
    "ev AS (SELECT * FROM attr WHERE score >= threshold AND node_id IS NOT NULL)",
)


def decay_ctes(events: str = "ev", until: str | None = None, key: str = "node_id",
               tag: str = "") -> tuple[str, ...]:
    """Plain-window form of the decay, used to check the sliced one."""
    where = f"WHERE ts <= {until}" if until else ""
    return (
        f"""gaps{tag} AS (SELECT *, greatest(ts - coalesce(lag(ts) OVER w, ts) - 30e0, 0e0) AS fade
 FROM {events} {where} WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id))""",
        f"""faded{tag} AS (SELECT *, sum(fade) OVER (PARTITION BY {key} ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS f FROM gaps{tag})""",
        f"""line{tag} AS (SELECT *, pow(2e0, max(log2(score) + f / 120e0) OVER w - f / 120e0) AS s,
 row_number() OVER w AS n, lead(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS next_ts
 FROM faded{tag} WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
    )


def state_ctes(as_of: str, tag: str = "") -> tuple[str, ...]:
    """States at ``as_of`` from the decay line built by :func:`decay_ctes`."""
    return (
        f"""lastrow{tag} AS (SELECT node_id, arg_max(s, n) AS s, max(n) AS alert_count, min(ts) AS first_alert_at,
 max(ts) AS last_alert_at, arg_max(flow_id, n) AS last_alert_id FROM line{tag} GROUP BY node_id)""",
        f"""decayed{tag} AS (SELECT *, {decayed_sql('s', f'({as_of} - last_alert_at)')} AS score FROM lastrow{tag})""",
        f"""states{tag} AS (SELECT *, CASE WHEN s > 0 AND score = 0 THEN 'none' ELSE {severity_sql('score')} END AS severity
 FROM decayed{tag})""",
        f"live{tag} AS (SELECT *, {rank_sql('severity')} AS rank FROM states{tag} WHERE severity <> 'none')",
    )
