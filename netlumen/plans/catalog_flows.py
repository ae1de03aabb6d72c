"""Packets, connection records and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlumen.fixtures import duck_with
from netlumen.functions import net
from netlumen.functions.features import FEATURE_NAMES, extract_features, standardise, linear_score
from netlumen.functions.severity import to_alerts
from netlumen.operators import flows
from netlumen.plans import inputs
from netlumen.plans.registry import Registry, r6, r6_plain, sql6
from netlumen.schemas import CONNECTION_FIELDS, CONNECTION_STRINGS, fill_partial, numeric_tail

reg = Registry()

_LOW = "(src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port))"
_KEY = (f"CASE WHEN {_LOW} THEN concat_ws('|', src_ip, src_port, dst_ip, dst_port, protocol) "
        "ELSE concat_ws('|', dst_ip, dst_port, src_ip, src_port, protocol) END")
_PK = f"""pk AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY ts, event_id) AS rn FROM (
 SELECT *, {_KEY} AS flow_key, {_LOW} AS low, (tcp_flags & 4) <> 0 AS rst,
  CASE WHEN (tcp_flags & 1) = 0 THEN 0 WHEN {_LOW} THEN 1 ELSE 2 END AS fin FROM fx_packets))"""
_WALK = """walk AS (
 SELECT flow_key, rn, event_id, ts, 1 AS segment, event_id AS opener, ts AS since, fin AS fins, rst, CAST(NULL AS DOUBLE) AS gap FROM pk WHERE rn = 1
 UNION ALL
 SELECT flow_key, rn, event_id, ts, segment + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN event_id ELSE opener END, CASE WHEN cut THEN ts ELSE since END,
  CASE WHEN cut THEN fin ELSE fins | fin END, rst, CASE WHEN cut THEN NULL ELSE ts - pts END FROM (
   SELECT p.flow_key, p.rn, p.event_id, p.ts, p.fin, p.rst, w.segment, w.opener, w.since, w.fins, w.ts AS pts,
    (w.rst OR p.ts - w.ts >= 15e0 OR w.fins = 3 OR w.ts - w.since >= 120e0) AS cut
   FROM walk w JOIN pk p ON p.flow_key = w.flow_key AND p.rn = w.rn + 1))"""
_SEG = """seg AS (SELECT k.*, w.segment, w.gap, concat('c-', substr(sha256(k.flow_key), 1, 12), '-', w.opener) AS flow_id
 FROM pk k JOIN walk w ON w.event_id = k.event_id)"""
_FACTS = """facts AS (SELECT flow_id, bool_or(rst) AS rst, bit_or(fin) AS fins, min(ts) AS t0, max(ts) AS t1 FROM seg GROUP BY 1)"""
_REASON = """why AS (SELECT *, CASE WHEN rst OR fins = 3 THEN 'closed' WHEN t1 - t0 >= 120e0 THEN 'active'
 WHEN (SELECT max(ts) FROM fx_packets) - t1 >= 15e0 THEN 'idle' ELSE 'open' END AS reason FROM facts)"""


def walk_sql(body: str, *ctes: str) -> str:
    return duck_with("fx_packets", _PK, _WALK, _SEG, *ctes, recursive=True) + body


def _segments(spark, sf):
    return flows.segments(inputs.packets(spark, sf))


@reg.query("flow_keys", duck_with("fx_packets") +
           f"SELECT event_id, {_KEY} AS flow_key, {_LOW} AS from_low FROM fx_packets")
def flow_keys(spark, sf):
    return flows.keyed(inputs.packets(spark, sf)).select("event_id", "flow_key", "from_low")


@reg.query("packet_flags", duck_with("fx_packets") + """SELECT
 sum(CAST((tcp_flags & 1) <> 0 AS BIGINT))::BIGINT AS fin, sum(CAST((tcp_flags & 2) <> 0 AS BIGINT))::BIGINT AS syn,
 sum(CAST((tcp_flags & 4) <> 0 AS BIGINT))::BIGINT AS rst, sum(CAST((tcp_flags & 8) <> 0 AS BIGINT))::BIGINT AS psh,
 sum(CAST((tcp_flags & 16) <> 0 AS BIGINT))::BIGINT AS ack, sum(CAST((tcp_flags & 32) <> 0 AS BIGINT))::BIGINT AS urg,
 protocol FROM fx_packets GROUP BY protocol""")
def packet_flags(spark, sf):
    bits = (("fin", net.FIN), ("syn", net.SYN), ("rst", net.RST), ("psh", net.PSH),
            ("ack", net.ACK), ("urg", net.URG))
    return inputs.packets(spark, sf).groupBy("protocol").agg(*[
        F.sum(net.has_flag(F.col("tcp_flags"), b).cast("long")).alias(n) for n, b in bits])


@reg.query("packet_gaps", duck_with("fx_packets", _PK) + f"""SELECT event_id,
 {sql6('ts - lag(ts) OVER (PARTITION BY flow_key ORDER BY ts, event_id)')} AS gap FROM pk""")
def packet_gaps(spark, sf):
    return flows.runs(inputs.packets(spark, sf)).select("event_id", r6("gap").alias("gap"))


@reg.query("flow_segments", walk_sql(
    f"SELECT event_id, flow_id, CAST(segment AS BIGINT) AS segment, {sql6('gap')} AS gap FROM seg"))
def flow_segments(spark, sf):
    return _segments(spark, sf).select("event_id", "flow_id", "segment", r6("gap").alias("gap"))


@reg.query("flow_directions", walk_sql("""SELECT event_id, (src_ip = first_value(src_ip) OVER w AND src_port = first_value(src_port) OVER w) AS forward
 FROM seg WINDOW w AS (PARTITION BY flow_id ORDER BY ts, event_id)"""))
def flow_directions(spark, sf):
    """Whether a packet left the initiator of its current flow."""
    seg = _segments(spark, sf)
    first = seg.groupBy("flow_id").agg(
        F.min_by("from_low", F.struct("ts", "event_id")).alias("initiated_low"))
    return seg.join(first, "flow_id").select(
        "event_id", (F.col("from_low") == F.col("initiated_low")).alias("forward"))


@reg.query("flow_entropy", walk_sql(f"""SELECT flow_id, {sql6('sum(-(c / n) * log2(c / n))')} AS payload_entropy FROM (
 SELECT flow_id, CAST(c AS DOUBLE) AS c, CAST(sum(c) OVER (PARTITION BY flow_id) AS DOUBLE) AS n FROM (
  SELECT flow_id, length // 64 AS b, count(*) AS c FROM seg GROUP BY 1, 2)) GROUP BY flow_id"""))
def flow_entropy(spark, sf):
    return flows.size_entropy(_segments(spark, sf)).select(
        "flow_id", r6("payload_entropy").alias("payload_entropy"))


def _records_sql() -> str:
    flag = lambda bit: f"CAST(sum(CASE WHEN (tcp_flags & {bit}) <> 0 THEN 1 ELSE 0 END) AS DOUBLE)"
    cols = {
        "src_port": "CAST(arg_min(src_port, event_id) AS DOUBLE)", "dst_port": "CAST(arg_min(dst_port, event_id) AS DOUBLE)",
        "protocol": "CAST(arg_min(protocol, event_id) AS DOUBLE)", "start_ts": "min(ts)", "emit_ts": "max(ts)",
        "duration": "max(ts) - min(ts)",
        "orig_bytes": "CAST(sum(CASE WHEN fw THEN length ELSE 0 END) AS DOUBLE)",
        "resp_bytes": "CAST(sum(CASE WHEN fw THEN 0 ELSE length END) AS DOUBLE)",
        "orig_pkts": "CAST(sum(CASE WHEN fw THEN 1 ELSE 0 END) AS DOUBLE)",
        "resp_pkts": "CAST(sum(CASE WHEN fw THEN 0 ELSE 1 END) AS DOUBLE)",
        "syn_count": flag(2), "ack_count": flag(16), "fin_count": flag(1), "rst_count": flag(4),
        "psh_count": flag(8), "urg_count": flag(32),
        "iat_mean": "coalesce(avg(gap), 0e0)", "iat_std": "coalesce(stddev_pop(gap), 0e0)",
        "iat_min": "coalesce(min(gap), 0e0)", "iat_max": "coalesce(max(gap), 0e0)",
        "pkt_size_mean": "avg(CAST(length AS DOUBLE))", "pkt_size_std": "stddev_pop(CAST(length AS DOUBLE))",
        "pkt_size_min": "CAST(min(length) AS DOUBLE)", "pkt_size_max": "CAST(max(length) AS DOUBLE)",
        "payload_entropy": "any_value(e)",
        "tls_present": "CASE WHEN max(tls_sni_len) > 0 THEN 1e0 ELSE 0e0 END", "tls_sni_len": "CAST(max(tls_sni_len) AS DOUBLE)",
        "http_present": "CASE WHEN bool_or(is_http_request) THEN 1e0 ELSE 0e0 END",
        "http_req_count": "CAST(sum(CASE WHEN is_http_request THEN 1 ELSE 0 END) AS DOUBLE)", "label": "-1e0",
    }
    body = ", ".join(f"{sql6(e)} AS {n}" for n, e in cols.items())
    return walk_sql(
        f"SELECT flow_id, arg_min(src_ip, event_id) AS src_ip, arg_min(dst_ip, event_id) AS dst_ip, {body} FROM dirs GROUP BY flow_id",
        """ent AS (SELECT flow_id, sum(-(c / n) * log2(c / n)) AS e FROM (SELECT flow_id, CAST(c AS DOUBLE) AS c,
 CAST(sum(c) OVER (PARTITION BY flow_id) AS DOUBLE) AS n FROM (SELECT flow_id, length // 64 AS b, count(*) AS c FROM seg GROUP BY 1, 2)) GROUP BY 1)""",
        """dirs AS (SELECT s.*, ent.e, (src_ip = first_value(src_ip) OVER w AND src_port = first_value(src_port) OVER w) AS fw
 FROM seg s JOIN ent ON ent.flow_id = s.flow_id WINDOW w AS (PARTITION BY s.flow_id ORDER BY ts, event_id))""")


def rounded(df, names=CONNECTION_FIELDS):
    return df.select(*[F.col(c) if c in CONNECTION_STRINGS else r6_plain(c).alias(c) for c in names])


@reg.query("flow_records", _records_sql())
def flow_records(spark, sf):
    return rounded(flows.flow_records(_segments(spark, sf)))


# A fixed scorer, so that the whole way from packets to alerts can be said in SQL.
SCORER = {"log_total_bytes": 0.35, "payload_entropy": 0.9, "is_tcp": 0.6, "log_total_pkts": -0.5}
SCORER_BIAS, SCORER_THRESHOLD = -3.2, 0.5
_Z = ("0.35e0 * ln(1e0 + orig_bytes + resp_bytes) + 0.9e0 * payload_entropy + CASE WHEN protocol = 6 THEN 0.6e0 ELSE 0e0 END"
      " - 0.5e0 * ln(1e0 + orig_pkts + resp_pkts) - 3.2e0")


@reg.query("packets_to_alerts", f"""SELECT flow_id, src_ip, dst_ip, CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port,
 CAST(protocol AS INTEGER) AS protocol, round(1e0 / (1e0 + exp(-({_Z}))), 4) AS score, 0.5e0 AS threshold, 1e0 AS latency_s
 FROM ({_records_sql()}) WHERE {_Z} >= 0""")
def packets_to_alerts(spark, sf):
    """Packets to connection records to features to scores to alerts, in one plan."""
    records = flows.flow_records(_segments(spark, sf))
    ids = ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "emit_ts", "label")
    features = extract_features(records, keep=ids)
    scored = features.withColumn("score", linear_score(SCORER, SCORER_BIAS))
    alerts = to_alerts(scored, SCORER_THRESHOLD, F.col("emit_ts") + 1.0)
    return alerts.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                         F.round("score", 4).alias("score"), "threshold", r6("latency_s").alias("latency_s"))


@reg.query("expiry_reasons", walk_sql("SELECT reason, count(*) AS flows FROM why GROUP BY reason", _FACTS, _REASON))
def expiry_reasons(spark, sf):
    as_of = inputs.packets(spark, sf).agg(F.max("ts")).scalar()
    return flows.expiry_counts(flows.close_reasons(_segments(spark, sf), as_of))


@reg.query("flow_cap_eviction", walk_sql("""SELECT flow_id FROM (SELECT flow_id, row_number() OVER (ORDER BY t1 DESC, flow_id) AS rn
 FROM facts) WHERE rn > 1000""", _FACTS))
def flow_cap_eviction(spark, sf):
    """Flows beyond a table of 1,000 that keeps the most recently seen ones."""
    return flows.evicted(flows.close_reasons(_segments(spark, sf)), 1000).select("flow_id")


def _merge_sql() -> str:
    o, w = "(start_ts, orig_bytes, payload_entropy, duration)", "(orig_pkts + resp_pkts)"
    rows = []
    for c in CONNECTION_FIELDS[1:]:
        if c in ("src_ip", "dst_ip"):
            rows.append(f"any_value({c}) AS {c}")
            continue
        if c in ("src_port", "dst_port", "protocol"):
            e = f"any_value({c})"
        elif c == "label":
            e = "coalesce(any_value(lab), -1e0)"
        elif c in ("iat_mean", "iat_std", "pkt_size_mean", "pkt_size_std"):
            e = f"CASE WHEN sum({w}) > 0 THEN sum({c} * {w}) / sum({w}) ELSE arg_min({c}, rn) END"
        elif c in ("emit_ts", "iat_max", "pkt_size_max", "tls_sni_len", "payload_entropy", "tls_present", "http_present"):
            e = f"max({c})"
        elif c in ("start_ts", "iat_min", "pkt_size_min"):
            e = f"min({c})"
        else:
            e = f"sum({c})"
        rows.append(f"{sql6(e)} AS {c}")
    return duck_with(
        "fx_connections",
        f"ordered AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY start_ts, orig_bytes, payload_entropy, duration) AS rn FROM fx_connections)",
        "labelled AS (SELECT *, last_value(CASE WHEN label <> -1 THEN label END IGNORE NULLS) OVER (PARTITION BY flow_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lab FROM ordered)",
    ) + f"SELECT flow_id, {', '.join(rows)} FROM labelled GROUP BY flow_id"


MERGE_ORDER = ["start_ts", "orig_bytes", "payload_entropy", "duration"]


@reg.query("merge_partials", _merge_sql())
def merge_partials(spark, sf):
    return rounded(flows.merge_partials(inputs.connections(spark, sf), MERGE_ORDER))


# The feature table as SQL, over columns already clipped at zero by the CTE.
_CLIPPED = """clip AS (SELECT *, greatest(duration, 0e0) AS d, greatest(orig_bytes, 0e0) AS ob, greatest(resp_bytes, 0e0) AS rb,
 greatest(orig_pkts, 0e0) AS op, greatest(resp_pkts, 0e0) AS rp, least(greatest(dst_port, 0e0), 65535e0) AS dp,
 least(greatest(src_port, 0e0), 65535e0) AS sp, greatest(iat_mean, 0e0) AS im, greatest(iat_std, 0e0) AS isd,
 greatest(pkt_size_min, 0e0) AS pmin, greatest(pkt_size_max, 0e0) AS pmax FROM fx_connections)"""
_ONE = lambda c: f"CASE WHEN {c} THEN 1e0 ELSE 0e0 END"
_LN = lambda x: f"ln(1e0 + {x})"
FEATURE_SQL = {
    "duration": "d", "log_total_bytes": _LN("ob + rb"), "log_orig_bytes": _LN("ob"), "log_resp_bytes": _LN("rb"),
    "log_total_pkts": _LN("op + rp"), "log_orig_pkts": _LN("op"), "log_resp_pkts": _LN("rp"),
    "bytes_per_pkt": "(ob + rb) / greatest(op + rp, 1e0)",
    "log_bytes_per_sec": _LN("(ob + rb) / greatest(d, 1e-3)"), "log_pkts_per_sec": _LN("(op + rp) / greatest(d, 1e-3)"),
    "resp_orig_byte_ratio": "rb / (ob + 1e0)", "resp_orig_pkt_ratio": "rp / (op + 1e0)",
    **{f"{f}_rate": f"{f}_count / greatest(op + rp, 1e0)" for f in ("syn", "ack", "fin", "rst", "psh", "urg")},
    "iat_mean": "im", "iat_std": "isd", "iat_min": "greatest(iat_min, 0e0)", "iat_max": "greatest(iat_max, 0e0)",
    "iat_cv": "isd / (im + 1e-9)", "pkt_size_mean": "pkt_size_mean", "pkt_size_std": "pkt_size_std",
    "pkt_size_min": "pmin", "pkt_size_max": "pmax", "pkt_size_range": "greatest(pmax - pmin, 0e0)",
    "payload_entropy": "payload_entropy", "is_tcp": _ONE("protocol = 6"), "is_udp": _ONE("protocol = 17"),
    "is_icmp": _ONE("protocol = 1"), "dst_port_wellknown": _ONE("dp < 1024"),
    "dst_port_registered": _ONE("dp >= 1024 AND dp < 49152"), "dst_port_ephemeral": _ONE("dp >= 49152"),
    "log_dst_port": _LN("dp"), "src_port_ephemeral": _ONE("sp >= 49152"), "is_http_port": _ONE("dp IN (80, 8080)"),
    "is_https_port": _ONE("dp = 443"), "is_ssh_port": _ONE("dp = 22"), "is_dns_port": _ONE("dp = 53"),
    "is_rdp_port": _ONE("dp = 3389"), "is_smb_port": _ONE("dp IN (445, 139)"), "tls_present": _ONE("tls_present > 0"),
    "log_tls_sni_len": _LN("greatest(tls_sni_len, 0e0)"), "http_present": _ONE("http_present > 0"),
    "log_http_req_count": _LN("greatest(http_req_count, 0e0)"),
}
assert tuple(FEATURE_SQL) == FEATURE_NAMES


@reg.query("flow_features", duck_with("fx_connections", _CLIPPED) + "SELECT flow_id, " +
           ", ".join(f"{sql6(e)} AS {n}" for n, e in FEATURE_SQL.items()) + " FROM clip")
def flow_features(spark, sf):
    out = extract_features(inputs.connections(spark, sf))
    return out.select("flow_id", *[r6(n).alias(n) for n in FEATURE_NAMES])


# NaN and infinities in the inputs must leave every feature finite.
@reg.query("feature_scrub", duck_with("fx_connections") + """SELECT flow_id,
 CASE WHEN syn_count = 1 THEN 0e0 ELSE payload_entropy END AS payload_entropy,
 0e0 AS iat_mean,
 CASE WHEN syn_count = 1 THEN 0e0 WHEN dst_port >= 49152 THEN 1e0 ELSE 0e0 END AS dst_port_ephemeral
 FROM fx_connections""")
def feature_scrub(spark, sf):
    hurt = F.col("syn_count") == 1
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    damaged = inputs.connections(spark, sf).withColumns({
        "payload_entropy": F.when(hurt, inf).otherwise(F.col("payload_entropy")),
        "dst_port": F.when(hurt, nan).otherwise(F.col("dst_port")),
        "iat_mean": nan, "iat_std": -inf})
    out = extract_features(damaged)
    return out.select("flow_id", "payload_entropy", "iat_mean",
                      "dst_port_ephemeral")


@reg.query("feature_standardised", duck_with("fx_connections", _CLIPPED) + "SELECT flow_id, " + ", ".join(
    sql6(f"(({FEATURE_SQL[n]}) - avg({FEATURE_SQL[n]}) OVER ()) / stddev_pop({FEATURE_SQL[n]}) OVER ()") + f" AS {n}"
    for n in ("log_total_bytes", "bytes_per_pkt", "iat_cv", "is_tcp")) + " FROM clip")
def feature_standardised(spark, sf):
    names = ("log_total_bytes", "bytes_per_pkt", "iat_cv", "is_tcp")
    scaled = standardise(extract_features(inputs.connections(spark, sf)), names)
    return scaled.select("flow_id", *[r6(n).alias(n) for n in names])


@reg.query("numeric_tail", duck_with("fx_connections") + "SELECT " + ", ".join(
    f"{sql6(f'sum({c})')} AS {c}" for c in ("src_port", "duration", "orig_bytes", "label")) + " FROM fx_connections")
def tail(spark, sf):
    names = ("src_port", "duration", "orig_bytes", "label")
    return numeric_tail(inputs.connections(spark, sf)).agg(*[r6(F.sum(c)).alias(c) for c in names])


@reg.query("partial_defaults", duck_with("fx_connections") +
           "SELECT flow_id, '' AS dst_ip, src_port, 0e0 AS urg_count, duration FROM fx_connections")
def partial_defaults(spark, sf):
    sent = inputs.connections(spark, sf).select("flow_id", "src_ip", "src_port", "duration")
    payload = sent.select(F.to_json(F.struct("*")).alias("body"))
    parsed = payload.select(F.from_json(
        "body", "flow_id string, src_ip string, dst_ip string, src_port double, duration double"
    ).alias("r")).select("r.*")
    return fill_partial(parsed).select("flow_id", "dst_ip", "src_port", "urg_count", "duration")


_SCORE = "least(payload_entropy / 4e0, 1e0)"


@reg.query("alert_projection", duck_with("fx_connections") + f"""SELECT flow_id, src_ip, dst_ip,
 CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port, CAST(protocol AS INTEGER) AS protocol,
 {_SCORE} AS score, 0.5e0 AS threshold, 2e9 AS detected_at, {sql6('2e9 - emit_ts')} AS latency_s, label
 FROM fx_connections WHERE {_SCORE} >= 0.5e0""")
def alert_projection(spark, sf):
    scored = inputs.connections(spark, sf).withColumn(
        "score", F.least(F.col("payload_entropy") / 4.0, F.lit(1.0)))
    out = to_alerts(scored, 0.5, F.lit(2e9))
    return out.withColumn("latency_s", r6("latency_s"))


@reg.query("payload_enrichment", f"""SELECT doc_id,
 (text LIKE 'GET %' OR text LIKE 'POST %' OR text LIKE 'PUT %' OR text LIKE 'HEAD %' OR text LIKE 'DELETE %' OR text LIKE 'OPTIONS %'
  OR text LIKE 'PATCH %' OR text LIKE 'CONNECT %' OR text LIKE 'TRACE %') AS is_http_request, CAST(0 AS INTEGER) AS tls_sni_len,
 coalesce({sql6('e')}, 0e0) AS payload_entropy FROM documents LEFT JOIN (
 SELECT id, sum(-(c / n) * log2(c / n)) AS e FROM (SELECT id, CAST(c AS DOUBLE) AS c, CAST(sum(c) OVER (PARTITION BY id) AS DOUBLE) AS n FROM (
  SELECT doc_id AS id, b, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2)) GROUP BY id) ON id = doc_id""")
def payload_enrichment(spark, sf):
    """Header facts of raw payload bytes; the document texts stand in for payloads."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = net.enrich_packets(docs.select("doc_id", F.encode("text", "UTF-8").alias("payload")))
    return out.select("doc_id", "is_http_request", "tls_sni_len",
                      r6("payload_entropy").alias("payload_entropy"))


@reg.query("mac_normalise", duck_with("fx_nodes") + """SELECT id,
 regexp_replace(mac_raw, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS mac, upper(substr(mac_raw, 1, 6)) AS oui,
 FALSE AS local FROM fx_nodes""")
def mac_normalise(spark, sf):
    """The raw form is rewritten to Cisco, Windows and BSD spelling and read back."""
    raw = F.col("mac_raw")
    spelled = F.when(F.col("criticality") == 0, F.regexp_replace(raw, "(....)(?=.)", "$1.")).when(
        F.col("criticality") == 1, F.upper(F.regexp_replace(raw, "(..)(?=.)", "$1-"))).when(
        F.col("criticality") == 2, F.regexp_replace(F.regexp_replace(raw, "(..)(?=.)", "$1:"), r"(^|:)0(?=[0-9a-f])", "$1")
    ).otherwise(raw)
    return inputs.nodes(spark, sf).withColumn("_m", spelled).select(
        "id", net.normalize_mac(F.col("_m")).alias("mac"), net.oui_of(F.col("_m")).alias("oui"),
        net.is_locally_administered(F.col("_m")).alias("local"))


@reg.query("ip_scope", duck_with("fx_alerts") + """SELECT addr, addr LIKE '10.%' AS internal, count(*) AS alerts FROM (
 SELECT src_ip AS addr FROM fx_alerts UNION ALL SELECT dst_ip FROM fx_alerts) GROUP BY addr""")
def ip_scope(spark, sf):
    ends = inputs.alerts(spark, sf).select(F.explode(F.array("src_ip", "dst_ip")).alias("addr"))
    return (ends.groupBy("addr").agg(F.count(F.lit(1)).alias("alerts"))
            .withColumn("internal", net.is_internal(F.col("addr"))))


@reg.query("subnets", duck_with("fx_nodes") + """SELECT id, regexp_extract(ip, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1) || '.0/24' AS subnet24,
 concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', CAST(split_part(ip, '.', 3) AS INTEGER) // 16 * 16, '.0/20') AS subnet20 FROM fx_nodes""")
def subnets(spark, sf):
    ip = F.col("ip")
    return inputs.nodes(spark, sf).select("id", net.subnet_of(ip).alias("subnet24"),
                                          net.subnet_of(ip, 20).alias("subnet20"))


@reg.query("pseudonymise", duck_with("fx_alerts") + """SELECT event_id, concat('100.64.', CAST(concat('0x', substr(h, 5, 2)) AS INTEGER), '.',
 CAST(concat('0x', substr(h, 7, 2)) AS INTEGER)) AS src_alias FROM (SELECT event_id, sha256('salt|' || src_ip) AS h FROM fx_alerts)""")
def pseudonymise(spark, sf):
    return inputs.alerts(spark, sf).select(
        "event_id", net.pseudonymise_ip(F.col("src_ip"), "salt").alias("src_alias"))


@reg.query("stable_unit_hash", duck_with("fx_nodes") + f"""SELECT id, {sql6("CAST(CAST(concat('0x', substr(sha256(id), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496e0")} AS u FROM fx_nodes""")
def stable_unit_hash(spark, sf):
    return inputs.nodes(spark, sf).select("id", r6(net.stable_unit(F.col("id"))).alias("u"))
