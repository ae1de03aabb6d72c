"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.llm import (
    decontaminate, license_scan, manifest, minhash, ngram_join, packing, rule_cascade, sharding, site_quality, token_counts, token_shards,
    url_filter, whitening)
from netlumen.llm.common import scratch, tokenizer_path
from netlumen.plans.registry import Registry

reg = Registry()
QUERIES, ORACLE = reg.queries, reg.oracle


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@reg.query("op6_token_shards")
def op6(spark, sf_dir):
    out = scratch(spark, "token-shards")
    token_shards.write(table(spark, sf_dir, "documents", "doc_id", "text"), out,
                       tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_shards.read(spark, out)


@reg.query("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"),
                        tokenizer_path("byte_bpe_50k.json"), end_id=0)


@reg.query("op10_token_counts")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.over_limit(token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json")))


@reg.query("op4_decontamination")
def op4(spark, sf_dir):
    return decontaminate.digest(decontaminate.contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")))


# Words, lines and windows as DuckDB lists; the method's own rules come after the base ones.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
             coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters
      FROM d JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN hit ON hit.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 40 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * letters < 50 * word_chars OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM b
"""


@reg.query("op8_quality_rules", OP8_SQL)
def op8(spark, sf_dir):
    return rule_cascade.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block"))
_RULES_SQL = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)
_SITES_SQL = ", ".join(f"('{s}')" for s in url_filter.SITES)
OP1_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {_RULES_SQL}), sites(site) AS (VALUES {_SITES_SQL}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
        FROM p JOIN rules r ON ends_with('.' || p.host, '.' || split_part(r.rule, '/', 1))
                           AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))) GROUP BY p.page_id),
bad AS (SELECT DISTINCT p.page_id FROM p JOIN sites s ON ends_with('.' || p.host, '.' || s.site))
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN bad.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit ON fit.page_id = p.page_id LEFT JOIN bad ON bad.page_id = p.page_id
"""


@reg.query("op1_url_filter", OP1_SQL)
def op1(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


SHARD_BYTES = 64 << 20


def shard_sql(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(
             coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
every AS (SELECT d.*, t.depth, h >> (60 - t.depth) AS prefix FROM d, range(0, 61) t(depth)),
size AS (SELECT depth, prefix, sum(n_bytes) AS n FROM every GROUP BY ALL
         HAVING sum(n_bytes) <= {limit} OR min(h) = max(h)),
leaf AS (SELECT e.doc_id, e.n_bytes, min(e.depth) AS depth, arg_min(e.prefix, e.depth) AS prefix
         FROM every e JOIN size s ON s.depth = e.depth AND s.prefix = e.prefix GROUP BY ALL),
named AS (SELECT doc_id, n_bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth::INT) END AS shard
          FROM leaf)
SELECT doc_id, n_bytes, shard, (sum(n_bytes) OVER w)::BIGINT AS shard_bytes, count(*) OVER w AS shard_docs
FROM named WINDOW w AS (PARTITION BY shard)
"""


@reg.query("op2_sharding", shard_sql(SHARD_BYTES))
def op2(spark, sf_dir):
    sharded = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARD_BYTES)
    return sharding.with_sizes(sharded.select("doc_id", "n_bytes", "shard"))


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# Postings, votes and key phrases as joins over the words' places.
OP7_SQL = f"""
WITH tw(t, label, j, word, need) AS (VALUES {_sql_rows(
    (k, t.label, j, w, int(t.key_at <= j < t.key_at + len(t.key)))
    for k, t in enumerate(license_scan.templates()) for j, w in enumerate(t.words))}),
bp(p, label, j, word, n) AS (VALUES {_sql_rows(
    (k, label, j, w, len(p.split())) for k, (p, label) in enumerate(license_scan.BASE) for j, w in enumerate(p.split()))}),""" + r"""
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
v AS (SELECT u.* FROM u WHERE word IN (SELECT word FROM tw UNION SELECT word FROM bp)),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM v GROUP BY word),
iw AS (SELECT tw.*, coalesce(df.n, 0) AS n, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df.n, 0) + 1)) + 1 AS idf
       FROM tw LEFT JOIN df ON df.word = tw.word),
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n, j) AS k FROM iw) WHERE k <= 3),
cand AS (SELECT v.doc_id, a.t, v.i - a.j AS s FROM v JOIN anchor a ON a.word = v.word GROUP BY ALL HAVING count(*) >= 2),
score AS (SELECT c.doc_id, c.t, any_value(w.label) AS label, sum(CASE WHEN v.i IS NULL THEN 0 ELSE w.idf END) / sum(w.idf) AS share
          FROM cand c JOIN iw w ON w.t = c.t LEFT JOIN v ON v.doc_id = c.doc_id AND v.i = c.s + w.j AND v.word = w.word
          GROUP BY c.doc_id, c.t, c.s HAVING sum(w.need) = sum(CASE WHEN v.i IS NULL THEN 0 ELSE w.need END)
          AND sum(CASE WHEN v.i IS NULL THEN 0 ELSE w.idf END) / sum(w.idf) >= 0.75),
base AS (SELECT v.doc_id, b.label, v.i - b.j AS s FROM v JOIN bp b ON b.word = v.word
         GROUP BY v.doc_id, b.p, b.label, v.i - b.j HAVING count(*) = any_value(b.n)),
bd AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
md AS (SELECT doc_id, max(share) AS share FROM score GROUP BY doc_id),
ad AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM score) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(bd.n_base, 0)::BIGINT AS n_base, bd.first_word::BIGINT AS first_word,
       bd.last_word::BIGINT AS last_word, coalesce(bd.base_labels, '') AS base_labels, coalesce(ad.labels, '') AS labels,
       CASE WHEN bd.n_base > 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, round(coalesce(md.share, 0), 6)) END AS score
FROM d LEFT JOIN bd ON bd.doc_id = d.doc_id LEFT JOIN md ON md.doc_id = d.doc_id LEFT JOIN ad ON ad.doc_id = d.doc_id
"""


@reg.query("op7_license_scan", OP7_SQL)
def op7(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("found")


@reg.query("op3_quality_classifier")
def op3(spark, sf_dir):
    return site_quality.classify(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"),
                                 table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"),
                                 keep=["doc_id", "source", "lang"])


def jaccard_sql(n: int, num: int, den: int, *columns: str) -> str:
    """Sets of n-word shingles, all pairs that share one, their links and what these reach."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE {den} * k >= {num} * (nx.n + ny.n - k)),
r(x, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.c),
m AS (SELECT x, min(c) AS component_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, {", ".join(columns)}
FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""


@reg.query("op5_ngram_join", jaccard_sql(4, 85, 100, "coalesce(k.n_links, 0)::BIGINT AS n_links"))
def op5(spark, sf_dir):
    return ngram_join.link(table(spark, sf_dir, "documents", "doc_id", "text"), n=4, num=85, den=100)


# A field as its byte count and value; crc32 bit by bit over the digits' bytes (-1: shift).
_FIELD = "CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f} END"
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
c AS (SELECT doc_id, lang, sha256({" || ".join(_FIELD.format(f=f) for f in manifest.FIELDS)}) AS leaf,
             sha256({" || ".join(_FIELD.format(f=f) for f in (*manifest.FIELDS[:-1], "low"))}) AS other,
             xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
               lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS crc FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
             dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM c),
lv(g, h, idx, digest, n) AS (SELECT g, 0, k, leaf, count(*) OVER (PARTITION BY g) FROM r
  UNION ALL SELECT g, h, idx, digest, count(*) OVER (PARTITION BY g)
            FROM (SELECT g, h + 1 AS h, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
                  FROM lv WHERE n > 1 GROUP BY g, h, idx // 8)),
sub AS (SELECT g, digest AS subroot FROM lv WHERE n = 1),
tp(h, idx, digest, n) AS (SELECT 0, g, subroot, count(*) OVER () FROM sub
  UNION ALL SELECT h, idx, digest, count(*) OVER ()
            FROM (SELECT h + 1 AS h, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
                  FROM tp WHERE n > 1 GROUP BY h, idx // 8)),
kin AS (SELECT a.g, a.h, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
               coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
        FROM lv a JOIN lv b ON b.g = a.g AND b.h = a.h AND b.idx // 8 = a.idx // 8 WHERE a.n > 1 GROUP BY a.g, a.h, a.idx),
tkin AS (SELECT a.h, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
                coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
         FROM tp a JOIN tp b ON b.h = a.h AND b.idx // 8 = a.idx // 8 WHERE a.n > 1 GROUP BY a.h, a.idx),
path AS (SELECT r.g, r.k, list({{'l': q.l, 'r': q.r}} ORDER BY q.tier, q.h) AS p
         FROM r JOIN (SELECT g, 0 AS tier, h, idx, l, r FROM kin UNION ALL SELECT sub.g, 1, tkin.h, sub.g // (8 ** tkin.h)::BIGINT, l, r
                      FROM sub JOIN tkin ON tkin.idx = sub.g // (8 ** tkin.h)::BIGINT) q
         ON q.g = r.g AND (q.tier = 1 OR q.idx = r.k // (8 ** q.h)::BIGINT) GROUP BY r.g, r.k),
f AS (SELECT r.*, sub.subroot, (SELECT digest FROM tp WHERE n = 1) AS root, coalesce(path.p, []) AS p,
             CASE WHEN crc % 3 = 0 THEN other ELSE leaf END AS start
      FROM r JOIN sub ON sub.g = r.g LEFT JOIN path ON path.g = r.g AND path.k = r.k),
o AS (SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(p, lambda s: s.l || s.r)), 'string_agg', '')) AS proof_sha256,
             list_reduce(list_concat([{{'l': start, 'r': ''}}], p), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM o
"""


@reg.query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf_dir):
    stored = manifest.build(table(spark, sf_dir, "documents", *manifest.FIELDS))
    return manifest.verify(manifest.prove(stored))


@reg.query("op11_embedding_whitening")
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return whitening.components(vectors, whitening.fit(vectors))


@reg.query("op12_minhash_dedup", jaccard_sql(5, 85, 100, "d.doc_id = component_id AS kept"))
def op12(spark, sf_dir):
    return minhash.link(table(spark, sf_dir, "documents", "doc_id", "text"), n=5, num=85, den=100)
