"""URL verdicts from a memory-mapped sorted array of 64-bit digests.

A list of rules becomes one file: the xxhash64 keys of its strings in ascending order and,
in the same order, where each full string lies. The driver puts the file into the shared
folder and Spark hands it to the executors, where all workers of a machine map the same
pages. Every url asks for its host and each parent domain first; only domains that the
list has are asked again with the beginnings of the path whose lengths occur under that
domain. A batch's keys are probed in one vectorised binary search, and a key that is found
counts only if the stored string is the one asked for, so collisions do no harm.

A rule (``host/path``) fits its host and all subdomains if the url's path starts with the
rule's path; the longest rule wins, at equal length the one of the longer host, and of
rules that are equal the blocking one. Rules come before the method's own block list of
sites; a url that neither knows is allowed.

A list beyond ``index_bytes`` is not sent: the same candidates are then joined to the list
by key and string.

A url that is null or has no ``://`` has an empty host and path, fits no rule and is
allowed. Repeated rows are judged each; columns named like a result give way to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlumen.llm.common import map_arrow, plain
from netlumen.session import shared_dir

ALLOW, BLOCK = "allow", "block"
# The method's own list: sites that exist to advertise, bet or spam.
SITES = tuple(f"{name}.{domain}" for name in (
    "adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for domain in ("example.com", "example.net", "example.org"))
HEAD = 4          # uint64: entries, bytes of strings, and two spare
_OPEN: dict[str, "DigestIndex"] = {}


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def entries(rules: Sequence[tuple[str, str]], sites: Sequence[str]) -> list[tuple[str, str]]:
    """What the index holds: (tagged string, value). ``d`` a domain with the path lengths
    of its rules, ``r`` a rule with its action, ``s`` a site of the block list."""
    action: dict[str, str] = {}
    lengths: dict[str, set[int]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        action[rule] = BLOCK if BLOCK in (verdict, action.get(rule)) else ALLOW
        lengths.setdefault(host, set()).add(len(slash + path))
    return [*(("d" + h, ",".join(map(str, sorted(n, reverse=True)))) for h, n in lengths.items()),
            *(("r" + r, a) for r, a in action.items()), *(("s" + s, BLOCK) for s in set(sites))]


def build(items: Sequence[tuple[str, str]]) -> bytes:
    """The index file: head, keys, ends of strings, ends of values, strings, values."""
    coded = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), v.encode()) for k, v in items)
    names, values = [k for _, k, _ in coded], [v for _, _, v in coded]
    head = np.array([len(coded), sum(map(len, names)), 0, 0], "<u8")
    keys = np.array([d for d, _, _ in coded], "<u8")
    ends = [np.cumsum([len(x) for x in part], dtype="<u8") if part else np.zeros(0, "<u8") for part in (names, values)]
    return b"".join([head.tobytes(), keys.tobytes(), *(e.astype("<u8").tobytes() for e in ends), *names, *values])


class DigestIndex:
    def __init__(self, path: str):
        head = np.memmap(path, "<u8", "r", 0, (HEAD,))
        n, size = int(head[0]), int(head[1])
        table = np.memmap(path, "<u8", "r", 8 * HEAD, (3, n)) if n else np.zeros((3, 0), "<u8")
        self.keys, self.name_ends, self.value_ends = table
        at = 8 * HEAD + 24 * n
        self.names = np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8)
        more = int(self.value_ends[-1]) if n else 0
        self.values = np.memmap(path, np.uint8, "r", at + size, (more,)) if more else np.zeros(0, np.uint8)

    def _part(self, data: np.ndarray, ends: np.ndarray, i: int) -> bytes:
        return data[int(ends[i - 1]) if i else 0:int(ends[i])].tobytes()

    def find(self, asked: Sequence[str]) -> list[str | None]:
        """The value of each string, or None; one binary search for all of them."""
        raw = [a.encode() for a in asked]
        keys = np.array([xxhash.xxh64_intdigest(r) for r in raw], "<u8")
        low, high = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        out: list[str | None] = [None] * len(raw)
        for i in np.flatnonzero(low < high).tolist():
            for k in range(int(low[i]), int(high[i])):
                if self._part(self.names, self.name_ends, k) == raw[i]:
                    out[i] = self._part(self.values, self.value_ends, k).decode()
        return out


def opened(name: str) -> DigestIndex:
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = DigestIndex(SparkFiles.get(name))
    return _OPEN[name]


def ship(spark: SparkSession, content: bytes) -> str:
    """Writes the file to the shared folder and gives it to every executor."""
    name = f"urls-{uuid.uuid4().hex}.idx"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for i in range(0, len(content), 1 << 20):
            stream.write(bytearray(content[i:i + (1 << 20)]))
    finally:
        stream.close()
    spark.sparkContext.addFile(target.toString())
    return name


def domains(host: str) -> list[str]:
    """The host and its parent domains."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def judge_batch(index: DigestIndex, hosts: list[str], paths: list[str]) -> tuple[list, list]:
    """Longest fitting rule (or None) and verdict of each url."""
    parents = {h: domains(h) for h in set(hosts)}
    known = sorted({d for p in parents.values() for d in p})
    lengths = dict(zip(known, index.find(["d" + d for d in known])))
    listed = {d for d, v in zip(known, index.find(["s" + d for d in known])) if v}
    urls = list(dict.fromkeys(zip(hosts, paths)))
    asked = [[d + path[:int(n)] for d in parents[host] if lengths[d] is not None
              for n in lengths[d].split(",") if int(n) <= len(path)] for host, path in urls]
    rules = sorted({r for a in asked for r in a})
    action = dict(zip(rules, index.find(["r" + r for r in rules])))
    answer = {}
    for url, options in zip(urls, asked):
        fits = [r for r in options if action[r]]
        rule = max(fits, key=lambda r: (len(r), len(r.partition("/")[0]))) if fits else None
        blocked = action[rule] == BLOCK if rule else any(d in listed for d in parents[url[0]])
        answer[url] = (rule, BLOCK if blocked else ALLOW)
    found = [answer[u] for u in zip(hosts, paths)]
    return [r for r, _ in found], [v for _, v in found]


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], sites: Sequence[str] = SITES,
          keep: Sequence[str] = ("page_id",), url: str = "url", index_bytes: int = 256 << 20) -> DataFrame:
    """The ``keep`` columns with host, path, rule and verdict of every row."""
    host, path = url_parts(plain(df, url))
    names = [c for c in keep if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = df.select(*[plain(df, c) for c in names], host.alias("host"), path.alias("path"))
    items = entries(rules, sites)
    if sum(len(k) + len(v) + 24 for k, v in items) > index_bytes:
        return judge_by_join(rows, df.sparkSession.createDataFrame(items, "name string, value string"))
    name, at = ship(df.sparkSession, build(items)), len(names)
    text = T.StringType()
    schema = T.StructType([*rows.schema.fields, T.StructField("rule", text), T.StructField("verdict", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = judge_batch(opened(name), batch.column(at).to_pylist(), batch.column(at + 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*names, "host", "path", "rule", "verdict"])

    return map_arrow(rows, run, schema)


def judge_by_join(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The way for a list too large to send: each distinct (host, path) asks by equi joins."""
    index = index.withColumn("key", F.xxhash64("name"))
    urls = rows.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    asked = urls.filter("host <> ''").select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))

    def look(frame: DataFrame, tag: str, string: str) -> DataFrame:
        frame = frame.withColumn("name", F.concat(F.lit(tag), F.col(string)))
        return frame.withColumn("key", F.xxhash64("name")).join(index, ["key", "name"]).drop("key", "name")

    sites = look(asked, "s", "domain").select("host", "path").distinct().withColumn("listed", F.lit(True))
    options = look(asked, "d", "domain").select("host", "path", "domain", F.explode(F.split("value", ",")).alias("n"))
    options = options.filter(F.col("n").cast("int") <= F.length("path"))
    options = options.withColumn("rule", F.concat("domain", F.expr("substring(path, 1, int(n))")))
    best = look(options, "r", "rule").groupBy("host", "path").agg(F.max_by(
        F.struct("rule", "value"), F.struct(F.length("rule"), F.length("domain"))).alias("best"))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.value")).when(F.col("listed"), BLOCK).otherwise(ALLOW)
    return (rows.join(best, ["host", "path"], "left").join(sites, ["host", "path"], "left")
            .select(*rows.columns, F.col("best.rule").alias("rule"), verdict.alias("verdict")))
