"""Token counts, id files and packing against the tokenizers library."""

import random
import zlib

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netlumen.llm import packing, token_counts, token_shards
from netlumen.llm.common import scratch, tokenizer_path
from netlumen.llm.encoding import PieceEncoder, blocks, pieces

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def library(name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_librarys_ids(name):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "Word", "é", "É", "'s", "12", "!", ",", ".", "\u00a0", "\u0301", "<|endoftext|>",
            "Σ", "\x1c", "\0", "|", "ﬁ", "İ", "ß"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    encode, small = library(name), PieceEncoder(tokenizer_path(name), max_pieces=50)
    for enc in (PieceEncoder(tokenizer_path(name)), small):
        for i in range(0, len(texts), 500):
            for text, ids in zip(texts[i:i + 500], enc.encode(texts[i:i + 500])):
                assert np.frombuffer(ids, "<u4").tolist() == encode(text), repr(text)
    text = "  some words, \n and more\twords. " * 50
    assert np.frombuffer(small.encode_long(text, 40), "<u4").tolist() == encode(text)
    assert "".join(blocks(text, 40)) == text and max(map(len, blocks(text, 40))) < 60


def test_pieces_are_the_text():
    for text in ("a b", " a", "a  b\n c", "", "x\u00a0 y"):
        joined = "".join(p[1:] if p[:1] == "\0" else " " + p for p in pieces(text))
        assert joined == text


@pytest.mark.parametrize("name", FILES)
def test_counts(spark, name):
    docs, encode = cases.documents(spark), library(name)
    got = cases.frame(token_counts.token_counts(docs, tokenizer_path(name), keep=["doc_id", "text"], batch_bytes=4096))
    assert len(got) == len(cases.rows())
    for _, r in got.iterrows():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(encode(r.text)))
    assert token_counts.token_counts(cases.empty(spark), tokenizer_path(name)).count() == 0
    odd = cases.clashing(docs, "n_tokens", "n_bytes")
    out = token_counts.over_limit(token_counts.token_counts(odd, tokenizer_path(name), keep=odd.columns))
    assert [c for c in out.columns if c.lower() == "n_tokens"] == ["n_tokens"] and out.count() == len(got)


def test_counts_of_a_sentencepiece_file(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = cases.frame(token_counts.token_counts(cases.documents(spark), path, keep=["text"]))
    assert all(r.n_tokens == len(model.encode(r.text or "")) for _, r in got.iterrows())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(1, 256), st.integers(0, 700), st.integers(0, 700))
def test_segment_round_trip(values, block, start, count):
    ids = np.array(values, np.uint32)
    segment = token_shards.encode_segment(ids, block * 8 if block <= 32 else 256)
    assert (token_shards.decode_segment(segment) == ids).all()
    assert (token_shards.decode_segment(segment, start, count) == ids[start:start + count]).all()


def test_segment_is_small_with_outliers():
    ids = np.random.default_rng(1).integers(0, 60, 4096).astype(np.uint32)
    ids[::50] = 49_000
    assert len(token_shards.encode_segment(ids)) < 4096 * 1.1
    with pytest.raises(ValueError):
        token_shards.decode_segment(b"nothing of the kind")


def test_id_files(spark):
    docs, encode = cases.documents(spark), library(FILES[0])
    out = scratch(spark, "ids")
    token_shards.write(docs, out, tokenizer_path(FILES[0]), end_id=1)
    got = cases.frame(token_shards.read(spark, out)).sort_values(["start"])
    assert len(got) == len(cases.rows())
    assert got.doc_id.isna().tolist() == [True] * 2 + [False] * (len(got) - 2)     # null ids first
    assert got.doc_id.dropna().is_monotonic_increasing
    assert (got.start.values == got.n_tokens.cumsum().values - got.n_tokens.values).all()
    want = sorted(zlib.crc32(np.array([*encode(r[1]), 1], "<u4").tobytes()) for r in cases.rows())
    assert sorted(got.ids_crc32) == want
    token_shards.write(cases.empty(spark), out + "-none", tokenizer_path(FILES[0]), end_id=1)
    assert token_shards.read(spark, out + "-none").count() == 0


def check_packed(got, texts, encode, size, end):
    by_doc = {}
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, parts in by_doc.items():
        ids, at = np.array([*encode(texts[doc]), end], "<u4"), 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.values == s.length.cumsum().values - s.length.values).all() and s.length.sum() <= size


def test_packing(spark):
    texts = dict(enumerate(cases.TEXTS))
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(2)
    got = cases.frame(packing.pack(docs, tokenizer_path(FILES[1]), end_id=0, size=64, chunk_ids=500))
    assert set(got.doc_id) == set(texts)
    check_packed(got, texts, library(FILES[1]), 64, 0)
    assert packing.pack(cases.empty(spark), tokenizer_path(FILES[1]), end_id=0).count() == 0
    repeated = packing.pack(cases.clashing(cases.documents(spark), "start", "offset"), tokenizer_path(FILES[1]), 0)
    assert repeated.filter("start = 0").count() == len(cases.rows())


def best_cost(where, penalty, size):
    """The recurrence without a queue."""
    f = [0]
    for j in range(1, len(where)):
        costs = []
        for i in range(j):
            n = where[j] - where[i]
            if n <= size:
                costs.append(f[i] + (0 if n & (n - 1) == 0 else size - n))
        f.append(min(costs) + penalty[j])
    return f[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60), st.lists(st.integers(0, 9), min_size=60, max_size=60))
def test_cuts_are_the_best(gaps, penalties):
    where = np.concatenate([[0], np.cumsum(gaps)])
    penalty = np.array([0, *penalties[:len(gaps)]])
    cuts = packing.cut(where, penalty, 32)
    pads = [0 if n & (n - 1) == 0 else 32 - n for n in np.diff(cuts).tolist()]
    cost = sum(pads) + sum(penalty[np.searchsorted(where, c)] for c in cuts[1:])
    assert cuts[0] == 0 and cuts[-1] == where[-1] and max(np.diff(cuts)) <= 32
    assert cost == best_cost(where.tolist(), penalty.tolist(), 32)


def test_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used = packing.pack(docs, tokenizer_path(FILES[1]), 0).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    waste = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert waste < 0.03 * used.sum()


@pytest.mark.parametrize("word, joint", [("word{}", " "), ("汉字文本{}", "")])
def test_little_padding_without_full_stops(spark, word, joint):
    """Documents of some 1,800 ids without a sentence's end, and in Chinese."""
    texts = [joint.join(word.format(chr(97 + (i * 7 + k) % 26)) for k in range(600 + i)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = cases.frame(packing.pack(docs, tokenizer_path(FILES[1]), 0))
    check_packed(got, dict(enumerate(texts)), library(FILES[1]), 1024, 0)
    used = got.groupby("sequence_id").length.sum()
    waste = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.tolist())
    assert waste < 0.03 * used.sum()
