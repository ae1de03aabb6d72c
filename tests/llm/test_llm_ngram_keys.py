"""Keys of the n-gram join: linking sets share one, sets with a few n-grams in common do not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlumen.llm import ngram_join, shingles
from netlumen.llm.textscan import mix

COMMON = np.zeros(1 << 16, np.uint8)


def grams(rng, n):
    return mix(rng.integers(0, 1 << 63, n, dtype=np.uint64))


def keys_of(sets, num, den, common=COMMON):
    at = np.append(0, np.cumsum([len(s) for s in sets]))
    owner, key = ngram_join.rare_keys(np.concatenate(sets), at, common, num, den)
    return [set(key[owner == i].tolist()) for i in range(len(sets))]


@pytest.mark.parametrize("num,den", [(80, 100), (85, 100), (60, 100), (1, 2)])
@pytest.mark.parametrize("spread", [True, False])
def test_linking_sets_share_a_key(num, den, spread):
    """``spread`` off: hashes so close that all n-grams of a set fall into one bin."""
    rng, sets = np.random.default_rng(num + spread), []
    for n in (1, 5, 14, 16, 17, 20, 21, 33, 60, 200, 700):
        base = grams(rng, n) if spread else grams(rng, n) >> np.uint64(24)
        for _ in range(8):
            kept = base[rng.random(n) >= 0.15 * rng.random()]
            sets.append(np.unique(np.append(kept, grams(rng, int(0.15 * n * rng.random())))))
    sets = [s for s in sets if len(s)]
    keys, links = keys_of(sets, num, den, rng.integers(0, 40, 1 << 16).astype(np.uint8)), 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            shared = len(np.intersect1d(x, y))
            if den * shared >= num * (len(x) + len(y) - shared) and not np.array_equal(x, y):
                links += 1
                assert keys[i] & keys[j], (len(x), len(y), shared)
    assert links > 30


def test_long_sets_are_not_tied_by_single_ngrams():
    """Each set shares its rarest n-gram with the next: one chain of all, none of them alike."""
    rng = np.random.default_rng(5)
    shared = np.arange(1, 61, dtype=np.uint64) << np.uint64(20)
    sets = [np.unique(np.concatenate([grams(rng, 400), shared[i:i + 2]])) for i in range(59)]
    keys = keys_of(sets, 80, 100)
    assert not any(keys[i] & keys[i + 1] for i in range(58))
    assert max(map(len, keys)) < 0.5 * 402


def test_long_texts_with_a_phrase_in_common_stay_apart(spark):
    """Of texts that share a phrase with the next only the copies become candidates, and are dropped."""
    rng, rows = np.random.default_rng(9), []
    for i in range(40):
        words = [f"w{i}x{k}" for k in rng.permutation(300)]
        words[50:55], words[200:205] = [f"p{i}y{k}" for k in range(5)], [f"p{i + 1}y{k}" for k in range(5)]
        rows.append((i, " ".join(words)))
    rows.append((40, rows[7][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = shingles.rows_of(docs, "doc_id", "text")
    pairs = shingles.candidates(own, 5, 80, 100, 8, lambda g, at: ngram_join.rare_keys(g, at, COMMON, 80, 100))
    assert pairs.distinct().count() == 1
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == list(range(40))
    out = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.link(docs).filter(F.col("n_links") > 0).collect()}
    assert out == {7: (7, 1), 40: (7, 1)}
