"""The Merkle manifest against plain Python."""

from __future__ import annotations

import hashlib
import zlib

import cases
import pytest

from netlumen.llm import manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars, lower=False) -> str:
    text = cases.lower(text) if lower and text is not None else text
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(parts))


def tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[i:i + 8])) for i in range(0, len(at), 8)])
    return levels[-1][0], levels


def path_of(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(level[lo:i]), "".join(level[i + 1:lo + 8])))
        i //= 8
    return out


def expected(rows: list[tuple]) -> list[tuple]:
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    root, top = tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path = path_of(trees[g][1], i) + path_of(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            acc = leaf_of(*r, lower=True) if tampered else leaf
            for left, right in path:
                acc = sha(left + acc + right)
            out.append((r[0], leaf, trees[g][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return sorted(out, key=repr)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in manifest.verify(manifest.prove(manifest.build(df))).collect()), key=repr)


def test_awkward_rows(spark):
    assert got(cases.clashing(cases.documents(spark), "leaf", "root", "rank", "g")) == expected(cases.rows())


@pytest.mark.parametrize("n, langs", [(1, 1), (8, 1), (9, 1), (70, 2), (700, 11), (90, 80)])
def test_every_shape_of_tree(spark, n, langs):
    rows = [(i * 7 % 1009, f"Text {i} of Many", None if i % langs == 0 else f"l{i % langs}é", f"s{i % 3}", i) for i in range(n)]
    assert got(spark.createDataFrame(rows, cases.DOCS).repartition(5)) == expected(rows)


def test_one_language_and_repeated_rows_of_one_id(spark):
    rows = [(5, "Same Text", "en", "s", 9)] * 100 + [(i, f"T{i}", "en", "s", 2) for i in range(40)]
    assert got(spark.createDataFrame(rows, cases.DOCS)) == expected(rows)


def test_tampering_is_found_where_it_changes_the_text(spark):
    rows = [(i, "ABC def" if i % 2 else "no capitals", "en", "s", 7) for i in range(200)]
    for doc_id, *_, verified in got(spark.createDataFrame(rows, cases.DOCS)):
        tampered = zlib.crc32(str(doc_id).encode()) % 3 == 0
        assert verified == (not tampered or doc_id % 2 == 0)


def test_empty_table(spark):
    assert got(cases.empty(spark)) == []
