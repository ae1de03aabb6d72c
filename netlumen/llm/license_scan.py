"""Licence texts found through a positional index of their rarest words.

Column expressions only. The templates' words are counted over all documents; each
template's ``ANCHORS`` words of highest IDF are its postings, (word, offset). A document's
words are looked up once: only places that hold an anchor of some template go on. An
anchor at place i proposes that the template starts at i - offset; a start that ``VOTES``
anchors agree on is a candidate, which counts if the template's key phrase stands there
word for word and the IDF share of all template words at their places reaches ``SHARE``.
A base phrase is found by its rarest word alone and verified as a whole, so every place
is found.

There is no shuffle of documents; only document counts of some seventy words reach the
driver. Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
lower-cased. A null or empty text has no words, no labels (an empty string) and score 0.
Rows are judged each, also repeated ones; columns named like a result give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.llm.common import attach, fresh, plain

ANCHORS, VOTES, SHARE = 3, 2, 0.75
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and the labels they stand for.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Label, template, key phrase (words of the template, once in it).
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]


def templates(rows: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    out = []
    for label, text, key in rows:
        words, key_words = tuple(text.split()), tuple(key.split())
        at = next(i for i in range(len(words)) if words[i:i + len(key_words)] == key_words)
        out.append(Template(label, words, at, key_words))
    return out


def words_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def document_counts(df: DataFrame, text: str, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows that have each word of ``vocabulary``."""
    found = df.select(F.explode(F.array_append(F.array_intersect(
        words_of(plain(df, text)), F.array(*map(F.lit, vocabulary))), F.lit(""))).alias("w"))
    n = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.pop("", 0), n


def scan(df: DataFrame, text: str = "text", base: Sequence[tuple[str, str]] = BASE,
         method: Sequence[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """``df`` without its text, with n_words, n_base, first_word, last_word, base_labels,
    labels and score; ``found`` holds (label, start, share) of the verified templates."""
    known = templates(method)
    phrases = [(tuple(p.split()), label) for p, label in base]
    vocabulary = sorted({w for t in known for w in t.words} | {w for p, _ in phrases for w in p})
    n_docs, count = document_counts(df, text, vocabulary)
    idf = {w: math.log((n_docs + 1) / (count.get(w, 0) + 1)) + 1 for w in vocabulary}

    def rarest(words: Sequence[str], n: int) -> list[int]:
        return sorted(range(len(words)), key=lambda j: (count.get(words[j], 0), j))[:n]

    postings = [(t, rarest(t.words, ANCHORS)) for t in known]
    lookups = [(p, label, rarest(p, 1)[0]) for p, label in phrases]
    anchors = sorted({t.words[j] for t, js in postings for j in js} | {p[j] for p, _, j in lookups})
    names = {n: fresh(df, "__" + n) for n in ("words", "at")}
    words, at = F.col(names["words"]), F.col(names["at"])

    def proposed(word: str, offset: int) -> Column:
        return F.transform(F.filter(at, lambda i: F.get(words, i) == word), lambda i: i - offset)

    def stands(start: Column, phrase: Sequence[str]) -> Column:
        """The phrase's words are at ``start`` and after."""
        out = start >= 0
        for j, w in enumerate(phrase):
            out = out & F.coalesce(F.get(words, start + j) == w, F.lit(False))
        return out

    def place_of(phrase: Sequence[str], offset: int) -> Column:
        return F.filter(proposed(phrase[offset], offset), lambda s: stands(s, phrase))

    def share(t: Template, start: Column) -> Column:
        hit = [F.when(F.get(words, start + j) == w, idf[w]).otherwise(0.0) for j, w in enumerate(t.words)]
        return sum(hit[1:], hit[0]) / F.lit(sum(idf[w] for w in t.words))

    def found_of(t: Template, js: Sequence[int]) -> Column:
        votes = F.concat(*[proposed(t.words[j], j) for j in js])
        agreed = F.filter(F.array_distinct(votes), lambda s: (
            F.size(F.filter(votes, lambda x: x == s)) >= min(VOTES, len(js))) & stands(s + t.key_at, t.key))
        scored = F.transform(agreed, lambda s: F.struct(
            F.lit(t.label).alias("label"), s.cast("long").alias("start"), share(t, s).alias("share")))
        return F.filter(scored, lambda x: x["share"] >= SHARE)

    here = df.withColumn(names["words"], words_of(plain(df, text)))
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(anchors))
    here = here.withColumn(names["at"], F.when(F.size(words) > 0, spots).otherwise(F.array().cast("array<int>")))
    here = attach(here, {
        **{f"__p{k}": place_of(p, j) for k, (p, _, j) in enumerate(lookups)},
        "found": F.concat(*[found_of(t, js) for t, js in postings]),
        "n_words": F.size(words).cast("long"),
    })
    starts = F.concat(*[F.col(f"__p{k}") for k in range(len(lookups))])
    own = F.filter(F.array(*[F.when(F.size(F.col(f"__p{k}")) > 0, F.lit(label)) for k, (_, label, _) in
                             enumerate(lookups)]), lambda x: x.isNotNull())
    every = F.concat(own, F.transform("found", lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    out = attach(here, {
        "n_base": F.size(starts).cast("long"),
        "first_word": F.array_min(starts).cast("long"),
        "last_word": F.array_max(starts).cast("long"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(own)), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(every)), ","),
        "score": F.when(F.size(starts) > 0, 1.0).otherwise(F.least(F.lit(1.0), F.round(best, 6))),
    })
    return out.drop(text, *names.values(), *[f"__p{k}" for k in range(len(lookups))])
