"""Document evidence and site evidence in one hierarchical empirical-Bayes posterior.

Evidence: two logistic models, one for low quality and one for toxicity, over which words
a text has and a few ratios. They are fitted here on at most ``max_labelled`` labelled
rows (the rows of least id hash); tasks choose the words and make the features, and a
bounded table of feature numbers reaches the driver.

Sites: every document, labelled or not, adds its evidence to its (host, path) by grouped
aggregation, paths add up to hosts and hosts to the whole. The rate of a host is shrunk to
the global rate and that of a path to its host's, by a number of pseudo-documents that
comes from the spread between sites (method of moments): sparse sites follow their
parents, and where sites do not differ beyond chance they all do. A document's posterior
log-odds are its evidence plus what its path's rate differs from the global one, at most
``MOST_SHIFT`` either way, so a site never outweighs clear evidence.

A document is rejected if it is more likely low in quality, or toxic, than not. Nulls and
empty texts have no words and are judged by the rest; a null host or path is the empty
one. Several labels of one id are averaged, null labels ignored, and without labels of
both kinds a model is its label's rate. Equal rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlumen.llm.common import fresh, map_arrow, materialize, plain
from netlumen.llm.rule_cascade import Texts
from netlumen.llm.textscan import ALNUM, hashes, mix, runs, slices, utf8

MAX_LABELLED, MAX_WORDS = 20_000, 1000     # the words are for each head
LEAST_TEXTS = 5                            # that a word is in to be a feature
MOST_SHIFT, EDGE = 2.0, 1e-4
HEADS = ("low", "toxic")
RATIOS = 6


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text as (text, hash) pairs, and the ratios."""
    data, offsets = utf8(column)
    start, end, bounds = runs(data, offsets, ALNUM)
    word = hashes(data, start, end)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    key = mix(word + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.unique(key, return_index=True)[1]
    t = Texts(column)
    n = np.maximum(t.n_words, 1)
    ratios = np.stack([
        np.log1p(t.n_words) / 5, t.n_repeat_words / n, t.n_dup_lines / np.maximum(t.n_lines, 1),
        np.minimum(t.n_symbols / n, 3), t.word_chars / n / 10, t.letters / np.maximum(t.word_chars, 1)], axis=1)
    return text[first], word[first], ratios


@dataclass
class Model:
    words: np.ndarray        # hashes, ascending
    weights: np.ndarray      # (words + ratios + 1, heads)

    def logits(self, column: pa.Array) -> np.ndarray:
        text, word, ratios = text_features(column)
        out = ratios @ self.weights[len(self.words):-1] + self.weights[-1]
        if len(self.words) and len(word):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(text[hit], self.weights[at[hit], k], len(out))
        return out


def least_surprise(n: int) -> float:
    """Standard deviations from chance that make a word a feature; few labels show less."""
    return float(np.clip(0.25 * np.sqrt(n), 3.5, 6.0))


def train(text: np.ndarray, word: np.ndarray, ratios: np.ndarray, labels: np.ndarray, n_words: int,
          epochs: int = 60, penalty: float = 1e-5) -> np.ndarray:
    """Logistic regression by Adam. A column of ``labels`` may
    hold NaN for unknown; a head without both kinds gets its smoothed rate only."""
    n, heads = labels.shape
    known, y = ~np.isnan(labels), np.nan_to_num(labels)
    rate = (y.sum(axis=0) + 0.5) / (known.sum(axis=0) + 1)
    weights = np.zeros((n_words + ratios.shape[1] + 1, heads))
    weights[-1] = np.log(rate / (1 - rate))
    both = ((y * known).sum(axis=0) > 0) & (((1 - y) * known).sum(axis=0) > 0)
    if not both.any():
        return weights
    for k in np.flatnonzero(both):
        # Words start from their smoothed log-odds where these are beyond chance.
        n_bad, n_all = (y * known)[:, k].sum(), known[:, k].sum()
        seen = np.bincount(word, known[text, k].astype(float), n_words)
        bad = np.bincount(word, (y * known)[text, k], n_words)
        expected = seen * n_bad / n_all
        odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((seen - bad + 0.5) / (n_all - n_bad + 1))
        weights[:n_words, k] = odds * (np.abs(bad - expected) >= least_surprise(n) * np.sqrt(expected + 1))
    order = np.argsort(text, kind="stable")
    text, word = text[order], word[order]
    at = np.searchsorted(text, np.arange(n + 1))
    mean, square, rng, step = np.zeros_like(weights), np.zeros_like(weights), np.random.default_rng(11), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            size = at[part + 1] - at[part]
            row = np.repeat(np.arange(len(part)), size)
            w = word[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[part], size)]
            z = ratios[part] @ weights[n_words:-1] + weights[-1]
            for k in range(heads):
                z[:, k] += np.bincount(row, weights[w, k], len(part))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * known[part] * both / len(part)
            grad = penalty * weights
            for k in range(heads):
                grad[:n_words, k] += np.bincount(w, error[row, k], n_words)
            grad[n_words:-1] += ratios[part].T @ error
            grad[-1] = error.sum(axis=0)
            step += 1
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad ** 2 - square)
            weights -= 0.05 * both * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return weights


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id",
        text: str = "text") -> Model:
    """The evidence model from ``labels`` (doc_id, quality, toxic)."""
    asked = labels.groupBy(plain(labels, doc_id).alias("id")).agg(
        (1 - F.avg("quality")).alias("low"), F.avg("toxic").alias("toxic")).filter("id IS NOT NULL")
    asked = materialize(asked.orderBy(F.xxhash64("id"), "id").limit(max_labelled), "labels")
    rows = docs.select(plain(docs, doc_id).alias("id"), plain(docs, text).alias("text"))
    # At most max_labelled narrow rows are sent to the tasks.
    rows = materialize(rows.join(F.broadcast(asked), "id"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, word, _ = text_features(part.column("text"))
                bad = [(np.nan_to_num(part.column(h).to_numpy(zero_copy_only=False).astype(float)) > 0.5) for h in HEADS]
                names, which = np.unique(word, return_inverse=True)
                tally = [np.bincount(which, minlength=len(names)),
                         *[np.bincount(which, b[at], len(names)).astype(np.int64) for b in bad]]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *map(pa.array, tally)],
                                                 names=["word", "n", *HEADS])

    tally = rows.mapInArrow(count, "word long, n long, low long, toxic long")
    tally = tally.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)])
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce((F.col(h) > 0.5).cast("long"), F.lit(0))).alias(h)
                                                    for h in HEADS]).first()
    n = max(total["n"], 1)

    def surprise(head: str) -> Column:
        expected = F.col("n") * float((total[head] or 0) / n)
        return F.abs(F.col(head) - expected) / F.sqrt(expected + 1)

    tally = materialize(tally.filter(F.col("n") >= LEAST_TEXTS).select("word", *[surprise(h).alias(h) for h in HEADS]), "words")
    # Each head has words of its own, so that the words of a rare label are not crowded out.
    best = [tally.filter(F.col(h) >= least_surprise(n)).orderBy(F.desc(h), "word").limit(MAX_WORDS) for h in HEADS]
    best = best[0].union(best[1]).select("word").distinct()
    words = np.sort(np.array([r["word"] for r in best.collect()], np.int64).view(np.uint64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, word, ratios = text_features(part.column("text"))
                place = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
                hit = words[place] == word if len(words) else np.zeros(len(word), bool)
                at, place = at[hit], place[hit]
                order = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[order], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(place[order]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), lists, pa.array(ratios.tolist(), pa.list_(pa.float64())),
                     *[part.column(h) for h in HEADS]], names=["id", "words", "ratios", *HEADS])

    kind = dict(rows.dtypes)["id"]
    table = rows.mapInArrow(features, f"id {kind}, words array<long>, ratios array<double>, low double, toxic double")
    got = sorted(table.collect(), key=lambda r: (r["id"], r["words"]))
    if not got:
        return Model(np.zeros(0, np.uint64), np.zeros((RATIOS + 1, len(HEADS))))
    labels_of = np.array([[np.nan if r[h] is None else float(r[h] > 0.5) for h in HEADS] for r in got])
    weights = train(np.repeat(np.arange(len(got)), [len(r["words"]) for r in got]),
                    np.array([w for r in got for w in r["words"]], np.int64), np.array([r["ratios"] for r in got]),
                    labels_of, len(words))
    return Model(words, weights)


def evidence(df: DataFrame, model: Model, text: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns with the evidence, log-odds ``__low`` and ``__toxic``."""
    rows = df.select(*[plain(df, c) for c in keep], *([] if text in keep else [plain(df, text)]))
    at, n = (list(keep) if text in keep else [*keep, text]).index(text), len(keep)
    sent = df.sparkSession.sparkContext.broadcast(model)      # bounded by MAX_WORDS
    schema = rows.select(*[plain(rows, c) for c in keep], F.lit(0.0).alias("__low"), F.lit(0.0).alias("__toxic")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                z = sent.value.logits(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(z[:, 0]), pa.array(z[:, 1])],
                                                 names=[*keep, "__low", "__toxic"])

    return map_arrow(rows, run, schema)


def _shrunk(n: Column, total: Column, parent: Column, pseudo: Column) -> Column:
    return (total + pseudo * parent) / (n + pseudo)


def _pseudo(groups: DataFrame, by: Sequence[str], head: str, parent: str) -> Column:
    """Pseudo-documents by the method of moments: the variance of group rates about the
    parent's beyond what sampling explains, as the precision of a Beta prior."""
    n, rate, p = F.col("n"), F.col(head) / F.col("n"), F.col(parent)
    spread = F.sum(n * (rate - p) ** 2) / F.sum(n)
    within = F.sum(p * (1 - p)) / F.sum(n)
    between = F.greatest(spread - within, F.lit(1e-9))
    level = F.sum(n * p * (1 - p)) / F.sum(n)
    return F.least(F.greatest(level / between - 1, F.lit(1.0)), F.lit(1e6)).alias(f"{head}_pseudo")


def posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Per (host, path): documents, host and path rates of each head, and global rates."""
    rate = [F.sum(1 / (1 + F.exp(-F.col(f"__{h}")))).alias(h) for h in HEADS]
    paths = materialize(scored.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), *rate), "paths")
    hosts = paths.groupBy(host).agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)])
    whole = hosts.agg(*[(F.sum(h) / F.sum("n")).alias(f"{h}_global") for h in HEADS])
    row = whole.first()
    for h in HEADS:
        mean = min(max(row[f"{h}_global"] if row[f"{h}_global"] is not None else 0.5, EDGE), 1 - EDGE)
        hosts = hosts.withColumn(f"{h}_global", F.lit(mean))
    pseudo = hosts.agg(*[_pseudo(hosts, [host], h, f"{h}_global") for h in HEADS]).first()
    hosts = hosts.select(host, F.col("n").alias("host_docs"), *[F.col(f"{h}_global") for h in HEADS], *[
        _shrunk(F.col("n"), F.col(h), F.col(f"{h}_global"), F.lit(pseudo[f"{h}_pseudo"] or 1.0)).alias(f"{h}_host")
        for h in HEADS])
    paths = paths.join(hosts, host)
    pseudo = paths.agg(*[_pseudo(paths, [host, path], h, f"{h}_host") for h in HEADS]).first()
    return materialize(paths.select(
        host, path, "host_docs", F.col("n").alias("path_docs"), *[f"{h}_global" for h in HEADS],
        *[f"{h}_host" for h in HEADS],
        *[_shrunk(F.col("n"), F.col(h), F.col(f"{h}_host"), F.lit(pseudo[f"{h}_pseudo"] or 1.0)).alias(f"{h}_path")
          for h in HEADS]), "posteriors")


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def classify(df: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text",
             doc_id: str = "doc_id", keep: Sequence[str] | None = None,
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The ``keep`` columns (all, if None) of every row with ``low``, ``toxic`` (posterior
    probabilities), the site's rates and ``kept``."""
    keep = list(df.columns if keep is None else keep)
    model = fit(df, labels, max_labelled, doc_id, text)
    names = {n: fresh(df, n) for n in ("__host", "__path")}
    rows = df.withColumns({names["__host"]: F.coalesce(plain(df, host).cast("string"), F.lit("")),
                           names["__path"]: F.coalesce(plain(df, path).cast("string"), F.lit(""))})
    sites = list(names.values())
    site = posteriors(evidence(rows, model, text, sites), *sites)
    out = evidence(rows, model, text, [*keep, *sites]).join(site, sites, "left")
    posterior = {h: 1 / (1 + F.exp(-(F.col(f"__{h}") + F.least(F.greatest(
        _odds(F.col(f"{h}_path")) - _odds(F.col(f"{h}_global")), F.lit(-MOST_SHIFT)), F.lit(MOST_SHIFT))))) for h in HEADS}
    site_columns = [c for h in HEADS for c in (f"{h}_host", f"{h}_path")]
    result = {"low": posterior["low"], "toxic": posterior["toxic"],
              **{c: F.col(c) for c in ("host_docs", "path_docs", *site_columns)},
              "kept": (posterior["low"] <= 0.5) & (posterior["toxic"] <= 0.5)}
    clash = {c.lower() for c in result}
    return out.select(*[plain(out, c) for c in keep if c.lower() not in clash], *[c.alias(n) for n, c in result.items()])


def keep_good(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that are kept, with their own columns."""
    at = fresh(df, "__row")
    judged = classify(df.withColumn(at, F.struct(*[plain(df, c) for c in df.columns])), labels,
                      keep=[at], **options)
    return judged.filter("kept").select(f"{at}.*")
