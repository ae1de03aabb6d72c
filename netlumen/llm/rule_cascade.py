"""Quality rules as a short-circuit cascade.

Every rule says which texts it rejects; a text is kept if none does, so the order of the
rules never changes the verdict, only the work. Cost (seconds a text) and selectivity
(share rejected) of each rule are measured by tasks on a bounded sample of rows, and the
rules run by rejections per second of cost, best first. A batch shrinks after each rule:
later, dearer rules see only the texts that all earlier ones let pass, and reuse what
those have already computed.

One Arrow pass without a shuffle. Nulls count as empty texts: no words, so too short.
Repeated rows are judged each; an empty table gives none. Ratios are compared in whole
numbers, so a text exactly at a limit passes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlumen.llm.common import map_arrow, plain
from netlumen.llm.textscan import NOT_FEED, SAME, SPACED, hashes, mix, runs, shingles, slices, utf8

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1      # first byte of a letter
_FIRST = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)             # not a continuation byte


class Texts:
    """A batch of texts with measures that are worked out on first use."""

    def __init__(self, column: pa.Array):
        self.column, self._known = column, {}

    def __len__(self) -> int:
        return len(self.column)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = getattr(self, "_get_" + name)()
        return self._known[name]

    def where(self, keep: np.ndarray) -> "Texts":
        """Some of the texts, with the per-text measures already known."""
        out = Texts(self.column.filter(pa.array(keep)))
        out._known = {k: v[keep] for k, v in self._known.items() if isinstance(v, np.ndarray) and len(v) == len(self)}
        return out

    def _get_raw(self):
        return utf8(self.column)

    def _get_spans(self):
        return runs(*self.raw, SPACED, SAME)

    def _total(self, weights: np.ndarray) -> np.ndarray:
        data, offsets = self.raw
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(weights[data], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def _get_n_words(self):
        return np.diff(self.spans[2])

    def _get_word_chars(self):
        return self._total(_FIRST * SPACED)

    def _get_letters(self):
        return self._total(_LETTER)

    def _get_n_symbols(self):
        return self._total(_SYMBOL)

    def _get_lines(self):
        """Lines with a word, and how many of them equal an earlier one."""
        data, offsets = self.raw
        start, end, bounds = runs(data, offsets, NOT_FEED, SAME)
        words = self.spans[0]
        has = np.searchsorted(words, end) > np.searchsorted(words, start)
        text = np.repeat(np.arange(len(self)), np.diff(bounds))[has]
        key = mix(hashes(data, start, end, SAME)[has] + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        distinct = text[np.unique(key, return_index=True)[1]]
        n = np.bincount(text, minlength=len(self))
        return n, n - np.bincount(distinct, minlength=len(self))

    def _get_n_lines(self):
        return self.lines[0]

    def _get_n_dup_lines(self):
        return self.lines[1]

    def _get_n_repeat_words(self):
        """Words inside a 3-word window that the text has twice or more."""
        start, end, bounds = self.spans
        n = np.diff(bounds)
        window, at = shingles(hashes(self.raw[0], start, end, SAME), bounds, 3)
        text = np.repeat(np.arange(len(self)), np.diff(at))
        key = mix(window + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = (count[which] > 1) & (n[text] >= 3)
        first = (np.arange(len(window)) - at[text] + bounds[text])[twice]
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + 3, -1)
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(np.cumsum(edge[:-1]) > 0, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
# Lenient limits: what they reject is not prose in any language.
OWN = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 40 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
    Rule("letters", lambda t: 100 * t.letters < 50 * t.word_chars),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 40 * t.n_lines),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def kept_mask(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """Which texts pass all rules; a text that one rejects is not shown to the next."""
    out, alive = np.zeros(len(texts), bool), np.arange(len(texts))
    for rule in rules:
        keep = ~rule.rejects(texts)
        if not keep.all():
            alive, texts = alive[keep], texts.where(keep)
        if not len(alive):
            break
    out[alive] = True
    return out


def order_rules(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2000,
                seed: int = 7) -> list[Rule]:
    """``rules`` by rejections per second, measured on about ``sample_rows`` random rows.

    A few numbers per rule reach the driver. Ties and unmeasured rules keep their order."""
    if len(rules) < 2:
        return list(rules)
    n = df.count()
    sample = df.select(plain(df, text).alias("text")).sample(min(1.0, sample_rows / max(n, 1)), seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                cost, hits = [], []
                for rule in rules:
                    texts, begin = Texts(part.column(0)), time.perf_counter()
                    hits.append(int(rule.rejects(texts).sum()))
                    cost.append(time.perf_counter() - begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(rules))), pa.array(cost), pa.array(hits)], names=["rule", "cost", "hits"])

    got = sample.mapInArrow(measure, "rule long, cost double, hits long")
    rate = {r["rule"]: r["hits"] / max(r["cost"], 1e-9) for r in
            got.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits")).collect()}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -rate.get(i, 0.0))]


def keep(df: DataFrame, rules: Sequence[Rule] = (*BASE, *OWN), text: str = "text") -> DataFrame:
    """The rows that pass every rule, with all their columns."""
    ordered, at = order_rules(df, rules, text), df.columns.index(text)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                mask = kept_mask(Texts(part.column(at)), ordered)
                yield part.filter(pa.array(mask)).rename_columns(names)

    return map_arrow(df, run, df.schema)


def judge(df: DataFrame, keep_columns: Sequence[str] = ("doc_id",), text: str = "text",
          own: Sequence[Rule] = OWN) -> DataFrame:
    """The base measures of every row, whether the base rules fail it, and whether it is
    kept; the other rules run, cheapest rejections first, on what the base rules let pass."""
    rows = df.select(*[plain(df, c) for c in keep_columns], plain(df, text).alias("__text"))
    at, ordered = len(keep_columns), order_rules(df, own, text)
    schema = T.StructType([*rows.schema.fields[:at], *[T.StructField(c, T.LongType()) for c in STATS],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = Texts(part.column(at))
                stats = [getattr(texts, c) for c in STATS]
                failed = np.zeros(len(texts), bool)
                for rule in BASE:
                    failed |= rule.rejects(texts)
                kept = ~failed
                kept[kept] = kept_mask(texts.where(~failed), ordered)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], *[pa.array(s, pa.int64()) for s in stats], pa.array(failed), pa.array(kept)],
                    names=[*keep_columns, *STATS, "base_failed", "kept"])

    return map_arrow(rows, run, schema)
