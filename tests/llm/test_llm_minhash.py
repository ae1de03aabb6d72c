"""MinHash near-dedup against plain Python, and the chance that a band is shared."""

from __future__ import annotations

import cases
import numpy as np
import pytest
from test_llm_corpus import joined, near_copies

from netlumen.llm import minhash, tiles
from netlumen.llm.shingles import combine, forest


@pytest.mark.parametrize("tile", [512, 16])
def test_components_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = minhash.link(docs, 5, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == joined(rows, 5, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_a_hub_that_links_with_nobody_loses_no_link(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base[:330] + [f"z{i}" for i in range(70)]))]
    for k in range(1, 5):
        rows.append((k, " ".join(base[:390] + [f"k{k}x{i}" for i in range(10)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.link(docs, 5, 85, 100).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    out = minhash.link(cases.clashing(docs, "component_id", "name", "n")).collect()
    assert len(out) == len(cases.rows()) and all(r.kept for r in out if not r.n_shingles)
    kept = minhash.keep_one(cases.clashing(docs, "component_id", "best"))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 14 not in ids and ids.count(13) == 1 and ids.count(7) == 1 and {0, 1, 2} <= set(ids)
    assert minhash.link(cases.empty(spark)).count() == minhash.keep_one(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("size", [3, 20, 150, 3000])
def test_bins_agree_as_often_as_sets_do(size):
    rng = np.random.default_rng(size)
    order = minhash.borrowing(128)
    agree, true = [], []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        x, y = (np.sort(np.append(both, rng.integers(0, 1 << 63, 1 + size // 5, dtype=np.uint64))) for _ in range(2))
        sig = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), order)
        agree.append((sig[0] == sig[1]).mean())
        true.append(size / (len(x) + len(y) - size))
    assert abs(np.mean(agree) - np.mean(true)) < 0.06


def test_stars_bound_pairs_and_sizes_part_them():
    n = 1000
    key, size = np.zeros(n, np.uint64), np.full(n, 50, np.uint16)
    *_, a, b = combine(key, np.arange(n)[::-1].copy(), size, size, 5)
    assert len(a) == n - 1 and set(a) == {0}
    size[500:] = 90
    first, hub, low, high, a, b = combine(key, np.arange(n), size, size, 5)
    assert sorted(hub) == [0, 500] and len(a) == n - 2
    a, b = forest(np.array([3, 5, 9, 1]), np.array([5, 7, 10, 9]))
    assert sorted(zip(a, b)) == [(1, 9), (1, 10), (3, 5), (3, 7)]
