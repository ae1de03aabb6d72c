"""Rules, URLs, decontamination and licences against plain Python and SQL."""

import hashlib
from collections import Counter

import cases
import compare
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netlumen.llm import decontaminate, license_scan, rule_cascade, url_filter
from netlumen.llm.fm_index import FMIndex, suffix_array
from netlumen.llm.queries import ORACLE, QUERIES, URL_RULES
from netlumen.llm.textscan import ALNUM, hashes, runs, shingles, utf8


@pytest.mark.parametrize("name", sorted(set(ORACLE)))
def test_queries_agree_with_sql(spark, sf, name):
    ok, text = compare.compare(spark, compare.duck(sf), name, QUERIES[name], ORACLE[name], sf)
    assert ok and "TYPES" not in text, text


def test_words_do_not_cross_texts():
    column = pa.array(["ab", "cd ef", None, "", "ab"])
    data, offsets = utf8(column)
    start, end, at = runs(data, offsets, ALNUM)
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [b"ab", b"cd", b"ef", b"ab"]
    assert at.tolist() == [0, 1, 3, 3, 3, 4]
    h = hashes(data, start, end)
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    gram, first = shingles(h, at, 2)
    assert first.tolist() == [0, 1, 2, 2, 2, 3] and gram[0] == gram[2] != gram[1]
    assert (hashes(data[2:4], np.array([0]), np.array([2])) == h[1]).all()      # wherever it stands


# -- quality rules ---------------------------------------------------------------------------
def measures(text):
    text = text or ""
    words = cases.SPACED.findall(text)
    lines = [x for x in text.split("\n") if cases.SPACED.search(x)]
    count = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if count[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_rule_measures(spark):
    got = cases.frame(rule_cascade.judge(cases.documents(spark), keep_columns=["text"]))
    assert len(got) == len(cases.rows())
    for r in got.itertuples():
        m = measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, repr(r.text)[:80]
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.base_failed and r.kept)
    assert rule_cascade.judge(cases.empty(spark)).count() == 0


def test_cascade_equals_all_rules_in_any_order(spark, sf):
    docs = cases.clashing(spark.read.parquet(f"{sf}/documents.parquet"), "kept", "n_words")
    kept = cases.frame(rule_cascade.keep(docs))
    judged = cases.frame(rule_cascade.judge(docs))
    assert list(kept.columns) == docs.columns and set(kept.doc_id) == set(judged[judged.kept].doc_id)
    texts = rule_cascade.Texts(pa.array(docs.toPandas().text.tolist()))
    rules = (*rule_cascade.BASE, *rule_cascade.OWN)
    want = ~np.any([r.rejects(texts) for r in rules], axis=0)
    for order in (rules, rules[::-1]):
        fresh = rule_cascade.Texts(texts.column)
        assert (rule_cascade.kept_mask(fresh, order) == want).all()
    assert rule_cascade.keep(cases.empty(spark)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    import time

    def slow(texts):
        time.sleep(0.05)
        return texts.n_words < 1000

    rules = [rule_cascade.Rule("never", lambda t: t.n_words < 0), rule_cascade.Rule("slow", slow),
             rule_cascade.Rule("quick", lambda t: t.n_words < 1000)]
    assert [r.name for r in rule_cascade.order_rules(cases.documents(spark), rules)] == ["quick", "slow", "never"]


# -- URLs ------------------------------------------------------------------------------------
URLS = ["http://www.example.com/en/x?q#f", "https://Blog.EXAMPLE.com/en/", "http://example.com/en", "ftp://a.net/es/1",
        "http://net/fr/#x", "http://xnet/fr/", "no scheme", None, "", "://", "http://", "http://a.com", "http://b.com/",
        "http://casino-win.example.org/x", "http://m.casino-win.example.net/", "http://a.b.c.d.net/es/", "x://h?u://net/es/"]


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = cases.lower(rest[:cut]), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(r, v) for r, v in URL_RULES
            if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        return (host, path, *max(fits, key=lambda x: len(x[0])))
    bad = any(("." + host).endswith("." + s) for s in url_filter.SITES)
    return host, path, None, "block" if bad else "allow"


def test_urls_both_ways(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0])] * 3, "page_id long, url string")
    odd = cases.clashing(pages, "host", "verdict")
    for limit in (1 << 20, 0):
        got = cases.frame(url_filter.judge(odd, URL_RULES, keep=["page_id", "url", "HOST"], index_bytes=limit))
        assert len(got) == len(URLS) + 3 and "HOST" not in got.columns
        for r in got.itertuples():
            assert (r.host, r.path, r.rule, r.verdict) == url_brute(r.url), r.url
        assert url_filter.judge(pages.limit(0), URL_RULES, index_bytes=limit).count() == 0
        assert url_filter.judge(pages, (), (), index_bytes=limit).filter("verdict = 'allow'").count() == len(URLS) + 3


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw: len(raw) % 3)
    items = [("r" + "x" * i, f"v{i}") for i in range(30)]
    path = tmp_path / "urls.idx"
    path.write_bytes(url_filter.build(items))
    index = url_filter.DigestIndex(str(path))
    assert index.find([k for k, _ in items]) == [v for _, v in items]
    assert index.find(["ry", "rxy", "rxxy"]) == [None] * 3


def test_equal_rules_block():
    tie = dict(url_filter.entries([("a.com/", "allow"), ("a.com/", "block")], ()))
    assert tie["ra.com/"] == "block"


# -- decontamination -------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5),
                                                                     min_size=1, max_size=8))
def test_fm_index(symbols, phrases):
    line = np.array([*symbols, 0])
    index = FMIndex(line, 5)
    grid = np.zeros((len(phrases), 5), np.int64)
    for i, p in enumerate(phrases):
        grid[i, 5 - len(p):] = p
    which, low, high = index.search(grid, np.array([len(p) for p in phrases]))
    position, hit = index.locate(low, high)
    got = sorted(zip(which[hit].tolist(), position.tolist()))
    want = sorted((i, s) for i, p in enumerate(phrases) for s in range(len(line)) if line[s:s + len(p)].tolist() == p)
    assert got == want


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_suffix_array(values):
    assert suffix_array(np.array(values)).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


ITEMS = [("i1", "a b c d e f g h i j k"), ("i2", "One, TWO"), (None, "mit license"), ("i4", None), ("i5", ""), ("i6", "..."),
         ("i2", "One, TWO"), ("i7", "j k l m n o p"), ("i8", "日本語")]


def contaminated(text, window=10):
    words, hit, items = cases.ALNUM.findall(cases.lower(text)), set(), set()
    for name, item in ITEMS:
        w = cases.ALNUM.findall(cases.lower(item))
        for p in {tuple(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w else ():
            for s in range(len(words) - len(p) + 1):
                if tuple(words[s:s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    items.add(name or "")
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_contamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = cases.clashing(cases.documents(spark), "n_words", "spans")
    for size in (1 << 20, 20):
        got = cases.frame(decontaminate.digest(decontaminate.contamination(
            docs, items, keep=["doc_id", "text", "SPANS"], block_bytes=size)))
        assert len(got) == len(cases.rows())
        for r in got.itertuples():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contaminated(r.text), r.text
        clean = decontaminate.remove(docs, items, block_bytes=size)
        assert clean.columns == docs.columns and clean.count() == docs.count()
        clean = cases.frame(clean)
        assert not any(contaminated(t)[4] for t in clean.text)
        for r in clean.itertuples():
            if r.doc_id == r.doc_id and not contaminated(cases.TEXTS[int(r.doc_id)])[4]:
                assert r.text == cases.TEXTS[int(r.doc_id)]
    assert decontaminate.contamination(cases.empty(spark), items).count() == 0
    none = decontaminate.digest(decontaminate.contamination(docs, items.limit(0)))
    assert none.filter("contaminated").count() == 0 and none.count() == len(cases.rows())
    assert decontaminate.remove(docs, items.limit(0)).count() == docs.count()


def test_a_cut_that_joins_a_passage_is_cut_again(spark):
    items = spark.createDataFrame([("a", "p q r s"), ("b", "x y")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "p q x x y y r s end", 19)], "doc_id long, text string, n_chars long")
    row = decontaminate.remove(docs, items).first()
    assert row.text.split() == ["end"] and row.n_chars == len(row.text)


# -- licences --------------------------------------------------------------------------------
def test_licences(spark):
    text = ("Mit LICENSE first. Permission is hereby granted, free of charge, to any person obtaining a copy of that software. "
            "Licensed under CC BY-NC 4.0; it is licensed under the GNU General Public-License, version 3.")
    rows = [*cases.rows(), (99, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, cases.DOCS)
    got = cases.frame(license_scan.scan(cases.clashing(docs.withColumn("t", docs.text), "labels", "score")))
    assert len(got) == len(rows)
    for r in got.itertuples():
        words = cases.ALNUM.findall(cases.lower(r.t))
        starts = [i for p, _ in license_scan.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (None if r.first_word != r.first_word else r.first_word) == (min(starts) if starts else None)
        assert (None if r.last_word != r.last_word else r.last_word) == (max(starts) if starts else None)
        assert 0 <= r.score <= 1
    one = got[got.doc_id == 99].iloc[0]
    assert one.base_labels == "cc-by,gpl,mit" and one.labels == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0,mit"
    assert license_scan.scan(cases.empty(spark)).count() == 0
