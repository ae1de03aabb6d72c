"""Sharding, the n-gram join, the quality classifier and the pipeline."""

import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import cases
import compare
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netlumen.llm import decontaminate, ngram_join, sharding, site_quality, tiles
from netlumen.llm.common import components
from netlumen.llm.queries import shard_sql

ROOT = Path(__file__).resolve().parents[2]


# -- sharding --------------------------------------------------------------------------------
def test_shards_agree_with_sql(spark, sf):
    def query(s, d):
        out = sharding.shard(s.read.parquet(f"{d}/documents.parquet"), 20_000)
        return sharding.with_sizes(out.select("doc_id", "n_bytes", "shard"))

    ok, text = compare.compare(spark, compare.duck(sf), "shards", query, shard_sql(20_000), sf)
    assert ok, text


def test_shards_fit_and_hot_rows_overflow(spark):
    rows = [(7, "same words " * 20)] * 400 + [(None, f"text {i} " * 30) for i in range(300)] + [(8, "long " * 5000)]
    docs = cases.clashing(spark.createDataFrame(rows, "doc_id long, text string"), "shard")
    out = cases.frame(sharding.shard(docs, 4000))
    assert len(out) == len(rows) and "SHARD" not in out.columns
    sizes = out.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((sizes["sum"] <= 4000 * 1.6) | (sizes["count"] == 1)).all()     # equal rows fill pages by hash
    plain = sizes[~sizes.index.str.contains("-")]
    assert ((plain["sum"] <= 4000) | (plain["count"] == 1)).all()
    assert sharding.shard(cases.empty(spark), 100).count() == 0
    assert sharding.shard(cases.documents(spark), 100).count() == len(cases.rows())


# -- n-gram join -----------------------------------------------------------------------------
def joined(rows, n, num, den):
    """(set size, least id of the component) by id, from an inverted index."""
    sets = {}
    for i, text in rows:
        w = cases.SPACED.findall(cases.lower(text))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    where, root = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            where[g].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in where[g] if j < i).items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    rng, rows = np.random.default_rng(3), []
    passage = [f"common{i}" for i in range(60)]
    for size in (1, 3, 6, 7, 12, 40, 200):
        base = [f"s{size}w{i}" for i in rng.integers(0, 10_000, size)]
        for k in range(40):
            words = list(base)
            for _ in range(rng.integers(0, max(2, size // 8))):
                words[rng.integers(0, len(words))] = f"new{rng.integers(0, 10**9)}"
            rows.append(" ".join(words))
    for k in range(60):                                     # share a passage and nothing else
        rows.append(" ".join([*passage, *(f"u{k}x{i}" for i in range(60))]))
    return [(i, t) for i, t in enumerate([*rows, None, "", " \n", rows[3], "ONE two", "one TWO"])]


@pytest.mark.parametrize("tile", [512, 16])
@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (2, 100, 100)])
def test_join_is_exact(spark, monkeypatch, tile, n, num, den):
    monkeypatch.setattr(tiles, "TILE", tile)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs, n, num, den).collect()}
    assert got == joined(rows, n, num, den)


def counted(rows, n, num, den):
    """Links of each row by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = cases.SPACED.findall(cases.lower(text))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    return {i: sum(i != j and bool(s) and den * len(s & t) >= num * len(s | t) for j, t in sets.items()) for i, s in sets.items()}


@pytest.mark.parametrize("tile", [512, 16])
@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 60, 100)])
def test_every_link_is_counted(spark, monkeypatch, tile, n, num, den):
    monkeypatch.setattr(tiles, "TILE", tile)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in ngram_join.link(docs, n, num, den).collect()}
    assert got == counted(rows, n, num, den) and max(got.values()) > 20


def test_join_edges(spark):
    out = ngram_join.link(cases.documents(spark)).collect()
    assert len(out) == len(cases.rows())
    assert ngram_join.link(cases.empty(spark)).count() == 0
    kept = ngram_join.keep_one(cases.clashing(cases.documents(spark), "component_id"))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 14 not in ids and 13 in ids and {0, 1, 2} <= set(ids)


def test_null_and_repeated_ids(spark):
    one, near = ([f"{w}{k}" for k in range(60)] for w in ("a", "b"))
    text, clean = " ".join(one), "an unrelated text of " + " ".join(near)
    null = [" ".join([f"n{k}" for k in range(80)] + [f"end{j}"] * j) for j in range(3)]
    rows = [(5, text), (5, text), (5, text), (8, text + " more"), (8, clean), (8, clean), (None, text + " less"),
            (None, null[0]), (None, null[1]), (None, null[1]), (None, null[2]), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.keep_one(docs).collect()), key=repr)
    assert len([r for r in got if r[0] is None and r[1] in null]) == 1
    assert [r for r in got if r[1] not in null] == sorted([(5, text), (8, clean), (9, ""), (9, ""), (None, None)], key=repr)
    links = [(r.n_shingles, r.n_links) for r in ngram_join.link(docs).filter("doc_id IS NULL AND n_shingles > 70").collect()]
    assert len(links) == 4 and {k for _, k in links} == {3}


def test_components_of_long_paths(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges.union(spark.createDataFrame([(900, 901)], "a long, b long")), "path").collect()
    assert {r.c for r in got if r.v <= 300} == {0} and {r.c for r in got if r.v >= 900} == {900} and len(got) == 303


# -- quality classifier ----------------------------------------------------------------------
def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = site_quality.classify(docs, labels.filter("doc_id % 2 = 0"), keep=["doc_id", "text"]).toPandas()
    truth = labels.filter("doc_id % 2 = 1").toPandas()
    both = out.merge(truth, on="doc_id", suffixes=("", "_label"))
    clean = both[(both.quality == 1) & (both.toxic_label == 0)]
    assert clean.kept.mean() > 0.93
    assert ((both.low > 0.5) == (both.quality == 0)).mean() > 0.9
    insults = both[both.text.str.contains("worthless|pathetic|stupid|disgusting", regex=True)]
    assert not insults.kept.any() or insults.kept.mean() < 0.4


def test_words_of_a_rare_label(spark):
    rng, rows = np.random.default_rng(5), []
    insults = [f"insult{k}" for k in range(10)]
    for i in range(5000):
        words, toxic = [f"common{k}" for k in rng.integers(100, 500, 40)], i % 100 == 0
        if toxic:
            words[5:8] = rng.choice(insults, 3, replace=False).tolist()
        rows.append((i, " ".join(words), "en", "src0", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth int").repartition(4)
    labels = docs.filter("doc_id < 4000").selectExpr("doc_id", "1 AS quality", "truth AS toxic")
    out = site_quality.classify(docs, labels, keep=["doc_id", "truth"]).filter("doc_id >= 4000").toPandas()
    assert out[out.truth == 1].kept.mean() < 0.2 and out[out.truth == 0].kept.mean() > 0.97


def test_sparse_sites_follow_their_parents(spark):
    rows = [("big", "x", 2.0)] * 400 + [("good", "x", -3.0)] * 400 + [("tiny", "x", 2.0)] + [("big", "rare", -3.0)]
    scored = spark.createDataFrame([(h, p, z, z) for h, p, z in rows], "host string, path string, __low double, __toxic double")
    got = site_quality.posteriors(scored).toPandas().set_index(["host", "path"])
    whole = got.low_global.iloc[0]
    assert got.low_host["big", "x"] > 0.8 and got.low_host["good", "x"] < 0.1
    assert abs(got.low_host["tiny", "x"] - whole) < abs(got.low_host["big", "x"] - whole)
    assert got.low_path["big", "rare"] > got.low_host["good", "x"]
    assert got.path_docs.sum() == len(rows)


def test_classifier_edges(spark):
    docs, labels = cases.documents(spark), "doc_id long, quality int, toxic int"
    some = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (7, None, None), (900, 1, 0)], labels)
    out = site_quality.classify(docs, some).toPandas()
    assert len(out) == len(cases.rows()) and out[["low", "toxic"]].notna().all().all()
    assert site_quality.classify(docs, some.limit(0)).count() == len(cases.rows())
    assert site_quality.classify(cases.empty(spark), some).count() == 0
    odd = cases.clashing(docs, "low", "kept")
    assert site_quality.keep_good(odd, some).columns == odd.columns


# -- pipeline --------------------------------------------------------------------------------
def test_stages(spark, sf):
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == start.columns and 0 < docs.count() <= before, name
    linked = ngram_join.link(docs, 5, 80, 100).toPandas()
    assert (decontaminate.contamination(docs, items).filter("size(spans) > 0").count() == 0)
    assert len(linked) == linked.component_id.nunique() or (linked.doc_id != linked.component_id).mean() < 0.01
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == docs.count()


def test_the_rest_imports_without_these_folders():
    code = ("import sys; sys.modules['netlumen.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "assert 'ranked_states' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())")
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
    code = "import __spark_entry__ as e; q = e.queries(); assert all(any(k.startswith(f'op{n}_') for k in q) for n in range(1, 11)); q['pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
