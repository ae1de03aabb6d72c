"""A Merkle manifest of a dataset: a content-addressed graph and proofs for all of its rows.

Every row is a leaf; the leaves of a language, by id, are folded eight at a time into its
subroot, and the subroots, by language, into the root. What is stored is one record per
inner node, from its digest to its children's digests.

Proofs come from descending that graph. A leaf request goes down from the root by the
digits of its rank in base eight; in each record it picks one child and collects the
others. Requests with equal leading digits go down together, so each record is visited
once, as one row with the path so far, and eight leaves' requests arrive as one packed
row. There the paths are reversed, bottom first, and give proofs and recomputed roots.

At scale: texts are read once, for their digests. Ranks come from a range partitioning with
counts carried over its partitions, so one language or id may hold any share of the rows; a
group is a run of at most eight. Levels shrink by eight, and no path is shuffled below the
runs: about 300 bytes a row in all. Everything is Spark's own functions.

Rows are ordered by (lang, doc_id, leaf), nulls first; equal rows are leaves of their own.
A null field hashes as ``-``; an empty text is ``0:``. The crc of a null id is null, so such
a row is never tampered with. An empty table has no rows and no root. Extra columns take no
part. A text is hashed whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlumen.llm.common import materialize, plain

FANOUT = 8
CELL = 4096        # positions whose rows are joined with their languages together
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<l:string,r:string>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over each field's byte count and value; a null is a dash."""
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, other): digests of the rows as they are and, where ``tampered``
    holds, as they would be with the text's A-Z lower-cased."""
    own = {f: plain(docs, f) for f in FIELDS}
    lower = F.translate(own["text"], _UPPER, _LOWER)
    if tampered is None:
        tampered = F.crc32(own["doc_id"].cast("string")) % 3 == 0
    leaf = leaf_digest([own[f] for f in FIELDS])
    # Only rows to be tampered with are hashed a second time.
    other = F.when(tampered, leaf_digest([*[own[f] for f in FIELDS[:-1]], lower])).otherwise(F.lit(None))
    return docs.select(own["doc_id"].cast("long").alias("doc_id"), own["lang"].alias("lang"), leaf.alias("leaf"),
                       other.alias("other"))


def numbered(df: DataFrame, order: Sequence[str], label: str, name: str) -> DataFrame:
    """``df`` with a number from 0 in the given order, nulls first.

    Rows are dealt out by ranges and sorted within them; what a range starts at is summed
    over the ranges' counts, one small row each. ``order`` should end in a column that tells
    equal rows apart."""
    by = [F.col(c).asc_nulls_first() for c in order]
    # The low 33 bits of the id count the rows of a partition, the high ones its number.
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at)
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    rows = materialize(rows, label)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start", "_n")


def _folded(nodes: DataFrame) -> DataFrame:
    """Parents of one level's nodes (g, idx, digest): eight neighbours each."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda k: k["digest"])
    runs = nodes.groupBy("g", F.floor(F.col("idx") / FANOUT).alias("run")).agg(kids.alias("children"))
    return runs.select("g", F.col("run").alias("idx"), F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _height(n: Column, most: int) -> Column:
    """The same as a column: how often ceil(n / 8) leaves more than one."""
    return sum((F.when(n > FANOUT ** k, 1).otherwise(0) for k in range(most)), F.lit(0))


def build(docs: DataFrame, tampered: Column | None = None) -> dict[str, DataFrame]:
    """The stored manifest of a dataset.

    ``records``: (digest, children), the graph. ``tops``: (digest, height) of the root.
    ``langs``: (g, lang, n, height, subroot). ``runs``: (g, run, n, kids), the requests of
    eight leaves a row, kids being (rank, doc_id, leaf, other)."""
    rows = leaves(docs, tampered).withColumn("at", F.monotonically_increasing_id())
    placed = numbered(materialize(rows, "manifest-leaves"), ["lang", "doc_id", "leaf", "at"], "manifest-order", "p").drop("at")
    langs = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("start"))
    langs = materialize(numbered(langs, ["lang"], "manifest-langs", "g"), "manifest-groups")
    most, groups = langs.agg(F.max("n"), F.count(F.lit(1))).first()
    # A range of positions holds whole rows of a language, so ranges and languages meet in
    # cells, and rows are joined on both: no language is one task.
    cell = F.floor(F.col("p") / CELL).alias("cell")
    cells = langs.select("lang", "n", "start", "g", F.explode(F.sequence(
        F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("n") - 1) / CELL))).alias("cell")).alias("c")
    own = placed.select("*", cell).alias("r").join(
        cells, (F.col("r.cell") == F.col("c.cell")) & F.col("r.lang").eqNullSafe(F.col("c.lang")))
    own = own.select("c.g", "c.n", (F.col("r.p") - F.col("c.start")).alias("rank"), "r.doc_id", "r.leaf", "r.other")
    runs = own.groupBy("g", F.floor(F.col("rank") / FANOUT).alias("run")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "doc_id", "leaf", "other"))).alias("kids"))
    runs = materialize(runs, "manifest-runs")
    kids = F.transform("kids", lambda k: k["leaf"])
    level = runs.select("g", "n", F.col("run").alias("idx"), kids.alias("children")).select(
        "g", "n", "idx", F.when(F.col("n") == 1, F.col("children")[0]).otherwise(
            F.sha2(F.array_join("children", ""), 256)).alias("digest"), "children")
    records, subroots, top = [level.filter("n > 1").select("digest", "children")], [level.filter(f"n <= {FANOUT}")], 1
    sizes = langs.select("g", "n")
    while most is not None and FANOUT ** top < most:
        # Only languages of more leaves than the level can hold have a level above it.
        level = _folded(level.filter(F.col("n") > FANOUT ** top).select("g", "idx", "digest"))
        level = materialize(level.join(sizes, "g"), f"manifest-level-{top}")
        top += 1
        records.append(level.select("digest", "children"))
        subroots.append(level.filter(F.col("n") <= FANOUT ** top))
    subs = subroots[0].select("g", "digest")
    for more in subroots[1:]:
        subs = subs.union(more.select("g", "digest"))
    langs = langs.select("g", "lang", "n", _height(F.col("n"), top).alias("height")).join(
        subs.select("g", F.col("digest").alias("subroot")), "g")
    langs = materialize(langs, "manifest-subroots")
    upper = langs.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.col("subroot").alias("digest"))
    for k in range(height(groups)):
        level = materialize(_folded(upper), f"manifest-top-{k}")
        records.append(level.select("digest", "children"))
        upper = level.select("g", "idx", "digest")
    graph = records[0]
    for more in records[1:]:
        graph = graph.union(more)
    # Equal children have one digest and are one record.
    graph = materialize(graph.dropDuplicates(["digest"]), "manifest-records")
    return {"records": graph, "tops": upper.select("digest", F.lit(height(groups)).alias("height")), "langs": langs, "runs": runs}


def _siblings(children: Column, i: Column) -> Column:
    """The unselected children of one record, left and right of the selected."""
    n = F.size(children)
    return F.struct(F.array_join(F.slice(children, F.lit(1), i), "").alias("l"),
                    F.array_join(F.slice(children, i + 2, n), "").alias("r"))


def _down(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """All requests one level further down: (idx, digest, path, ...) for every child."""
    held = frontier.join(records, "digest").select(*[c for c in frontier.columns if c != "digest"], "children",
                                                   F.posexplode("children").alias("_i", "_child"))
    keep = [c for c in frontier.columns if c not in ("idx", "digest", "path")]
    return held.select((F.col("idx") * FANOUT + F.col("_i")).alias("idx"), F.col("_child").alias("digest"),
                       F.concat("path", F.array(_siblings(F.col("children"), F.col("_i")))).alias("path"), *keep)


def prove(manifest: dict[str, DataFrame]) -> DataFrame:
    """Per leaf doc_id, leaf, subroot, root, path (bottom first, siblings left and right of
    each step) and other, the digest that it is to be recomputed from where it differs."""
    records, langs, runs = manifest["records"], manifest["langs"], manifest["runs"]
    none = F.array().cast(f"array<{_STEP}>")
    root = manifest["tops"].select(F.lit(0).cast("long").alias("idx"), "digest", none.alias("path"), F.col("digest").alias("root"))
    above = manifest["tops"].agg(F.max("height")).first()[0] or 0
    at = root
    for k in range(above):
        at = materialize(_down(at, records), f"manifest-down-top-{k}")
    at = at.withColumnRenamed("idx", "g").join(langs.select("g", "height", "n"), "g")
    at = at.select("g", F.lit(0).cast("long").alias("idx"), "digest", "path", "root", F.col("digest").alias("subroot"), "height")
    most = langs.agg(F.max("height")).first()[0] or 0
    for h in range(most, 1, -1):
        # Languages of lower trees wait for their height.
        down = _down(at.filter(F.col("height") == h), records).withColumn("height", F.lit(h - 1))
        at = materialize(at.filter(F.col("height") < h).unionByName(down), f"manifest-down-{h}")
    met = runs.join(at.select("g", F.col("idx").alias("run"), "path", "root", "subroot"), ["g", "run"])
    one = met.select("n", "path", "root", "subroot", F.transform("kids", lambda k: k["leaf"]).alias("children"),
                     F.posexplode("kids").alias("i", "kid"))
    step = F.when(F.col("n") > 1, F.array(_siblings(F.col("children"), F.col("i")))).otherwise(none)
    return one.select("kid.doc_id", "kid.leaf", "kid.other", "subroot", "root", F.reverse(F.concat("path", step)).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, bottom first, give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def verify(proofs: DataFrame) -> DataFrame:
    """Per leaf the digest of its proof, the root recomputed from the tampered text where
    there is one and else from its own, and whether that is the root."""
    out = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        fold(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
