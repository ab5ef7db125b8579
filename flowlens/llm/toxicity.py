"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

Model.  A sentence's probability is p = sigmoid(bias + sum of the weights of its distinct
words); a word's weight is that of the whole word plus those of its prefixes of
``PREFIXES`` letters.  A document is toxic if any sentence is: noisy-or with a leak,
P = 1 - (1 - leak) x product of (1 - p).  Only document labels are known; the gradient of
the document's log likelihood shares the blame among its sentences.  An L1 penalty
(proximal step, weights stay at or above zero) leaves weight on features that mark toxic
documents only.

Training.  The classifier learns from a bounded sample: ``SCREEN_ROWS`` labelled training rows
(least md5 of the id, so the same rows on every run and layout).  Ids are chosen before any
text moves, so neither the shuffle nor the model grows with the table.  Spark counts the
distinct sentences of the sample's toxic and clean documents that hold each feature, and only
features that pass the screening reach the driver.  The gradient steps run on the first
``MAX_TRAIN`` rows of the same order, of which workers hand over the chosen features' places
in each sentence, no text.  The model (one float per kept feature) is broadcast.

Scoring.  Every whole text is scored row by row; ``locate`` names the offending sentences.

Results.  Scores are in [0, 1]; a null or empty text has no sentence and scores the leak.
Labels that are null or not 0/1 are left out of training; without any toxic training row
every score is 0.  Rows are independent, repeated rows score alike; training takes equal
rows of (id, text, label) once.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import crc_mod, doc_text, hash_sample, map_arrow, takes_worker, written

SCREEN_ROWS = 20_000
MAX_TRAIN = 6000
PREFIXES = (4, 5, 6, 7)
SCREEN = 20.0  # see screened()
GENERAL = 0.75  # share of a longer feature's log odds at which a prefix replaces it
STEPS, RATE, L1 = 150, 0.1, 1e-3
START_BIAS = -10.0  # and its upper bound: plain sentences must not add up in long texts
WEIGHT_CACHE = 500_000
FLUSH_FEATURES = 300_000
ALL = ""  # stands for all sentences in the feature counts; no feature is empty
# A sentence ends at a stop mark, line end or bar; words are runs of letters.
SENTENCE = re.compile(r"[^.!?\n\r|]+")
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its prefixes (marked by a final star)."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]]


@dataclass
class Model:
    """Weights by feature, the sentence bias and the leak."""

    weights: dict[str, float]
    bias: float
    leak: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence."""
        out = []
        for m in SENTENCE.finditer(text):
            words = set(LETTERS.findall(m[0].lower()))
            z = self.bias + sum(map(self.word_weight, sorted(words)))
            out.append((m.start(), m.end(), _sigmoid(z)))
        return out

    def score(self, text: str, cache: dict[str, float]) -> float:
        """P of a whole text; ``cache`` holds the weights of words seen before.

        Sentences are looked at one by one only if some word of the text has a weight; the
        others all have the bias's probability.
        """
        low = text.lower()
        words = set(LETTERS.findall(low))
        for w in words.difference(cache):
            cache[w] = self.word_weight(w)
        marked = {w for w in words if cache[w]}
        plain, clean = 0, 1.0 - self.leak
        if not marked:
            plain = len(SENTENCE.findall(low))
        else:
            for sentence in SENTENCE.findall(low):
                found = LETTERS.findall(sentence)
                if hit := marked.intersection(found):
                    clean *= 1.0 - _sigmoid(self.bias + sum(cache[w] for w in sorted(hit)))
                else:
                    plain += 1
        return 1.0 - clean * (1.0 - _sigmoid(self.bias)) ** plain


def _sigmoid(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-max(-60.0, min(60.0, z)))))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many distinct sentences of toxic and of clean documents
    a feature occurs (copies count once); ``ALL`` counts them all.  ``rows``: (text, toxic)."""

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_worker(__name__)
        for b in batches:
            found = {(y, s) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())
                     for s in SENTENCE.findall(t.lower())}
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()),
                                              pa.array([s for _, s in found], pa.string())], ["toxic", "sentence"])

    def batch_of(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[f] for f in names], pa.int64()) for c in (toxic, clean)]],
                                          ["feature", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_worker(__name__)
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for sentence, y in zip(b.column("sentence").to_pylist(), b.column("toxic").to_pylist()):
                held[1 - y].update({ALL, *[f for w in set(LETTERS.findall(sentence)) for f in features(w)]})
            if len(held[0]) + len(held[1]) > FLUSH_FEATURES:  # bounds the worker's memory
                yield batch_of(*held)
                held = (Counter(), Counter())
        yield batch_of(*held)

    distinct = rows.select("text", "toxic").mapInArrow(sentences, "toxic int, sentence string").distinct()
    return distinct.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def screened(counts: DataFrame, all_toxic: int, all_clean: int) -> DataFrame:
    """Features that sentences of toxic documents hold more often, by a likelihood-ratio (G squared) of at
    least ``SCREEN``: the many that are favoured by chance are left out."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)

    total = float(all_toxic + all_clean)
    share = all_toxic / total
    toxic, clean = F.col("toxic"), F.col("clean")
    n = toxic + clean
    ratio = 2 * (part(toxic, n * share) + part(clean, n * (1 - share)) + part(all_toxic - toxic, (total - n) * share)
                 + part(all_clean - clean, (total - n) * (1 - share)))
    return counts.filter((F.col("feature") != ALL) & (toxic > n * share) & (ratio >= SCREEN))


def chosen_features(counts: DataFrame) -> dict[str, float]:
    """Log odds of the features that the model may weigh."""
    every = counts.filter(F.col("feature") == ALL).first()
    of_toxic, of_clean = (every["toxic"], every["clean"]) if every else (0, 0)
    if not of_toxic:
        return {}
    odds = {r["feature"]: float(np.log((r["toxic"] + 0.5) / (of_toxic + 1)) - np.log((r["clean"] + 0.5) / (of_clean + 1)))
            for r in screened(counts, of_toxic, of_clean).collect()}
    # Of a word and its prefixes the shortest that is about as telling stands for all: it
    # also covers forms that the training rows do not hold.
    return {f: odds[f] for f in sorted(odds) if not any(
        odds[p] >= GENERAL * odds[f] for p in features(f.rstrip("*"))[1:]
        if p != f and len(p) <= len(f) and p in odds)}


def places(sample: DataFrame, column: dict[str, int]) -> DataFrame:
    """(toxic, plain, cols): of every text the number of sentences without a chosen feature,
    and the columns of the chosen features in each of the others."""
    shared = sample.sparkSession.sparkContext.broadcast(column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, plain, cols = shared.value, [], []
        for text in batch.column("text").to_pylist():
            of = [[column[f] for w in sorted(set(LETTERS.findall(s))) for f in features(w) if f in column]
                  for s in SENTENCE.findall(text.lower())]
            plain.append(sum(not c for c in of))
            cols.append([c for c in of if c])
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(plain, pa.int32()),
                                           pa.array(cols, pa.list_(pa.list_(pa.int32())))], ["toxic", "plain", "cols"])

    return map_arrow(sample.select("text", F.col("toxic").cast("int").alias("toxic")), run,
                     "toxic int, plain int, cols array<array<int>>")


def fit(odds: dict[str, float], texts: list) -> Model:
    """Fit the chosen features on a bounded list of rows of ``places`` (see ``MAX_TRAIN``)."""
    y = np.array([r["toxic"] for r in texts], bool)
    if not y.any():
        return Model({}, -60.0, 0.0)
    names = list(odds)
    # Sentences: first those without a feature, one entry per text with their number.
    rows, cols, sent_doc = array("i"), array("i"), array("i", range(len(texts)))
    for d, text in enumerate(texts):
        for found in text["cols"]:
            rows.extend([len(sent_doc)] * len(found))
            cols.extend(found)
            sent_doc.append(d)
    rows_a, cols_a, doc = (np.frombuffer(x, np.int32) if x else np.empty(0, np.int32) for x in (rows, cols, sent_doc))
    times = np.ones(doc.size)
    times[:len(texts)] = [r["plain"] for r in texts]
    # Start from the log odds of each feature by itself, so that words which always come
    # together all keep their share of the blame.
    w = np.array([odds[f] for f in names])
    bias, leak = START_BIAS, -4.0
    # Adam steps on the mean negative log likelihood, then the L1 shrinkage of the weights.
    m, v = np.zeros(w.size + 2), np.zeros(w.size + 2)
    n_sent, n_doc = doc.size, y.size
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows_a, w[cols_a], n_sent)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        q = 1.0 / (1.0 + np.exp(-leak))
        log_clean = np.log1p(-q) + np.bincount(doc, times * np.log1p(-p), n_doc)
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        # d(-log likelihood)/d z_j = p_j for clean documents, -p_j (1 - P) / P for toxic ones.
        factor = np.where(y, -(1.0 - toxic) / toxic, 1.0) / n_doc
        gz = times * p * factor[doc]
        g = np.concatenate([np.bincount(cols_a, gz[rows_a], w.size), [gz.sum(), q * factor.sum()]])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
        w -= move[:-2]
        w = np.maximum(w - RATE * L1, 0.0)
        bias, leak = min(bias - move[-2], START_BIAS), leak - move[-1]
    weights = {names[i]: float(w[i]) for i in np.flatnonzero(w > 1e-3)}
    return Model(weights, float(bias), float(1.0 / (1.0 + np.exp(-leak))))


def train(docs: DataFrame, labels: DataFrame, where=None, screen_rows: int | None = None, max_train: int | None = None) -> Model:
    """The model of at most ``screen_rows`` labelled rows of ``docs`` (``where``: a condition on doc_id)."""
    screen_rows, max_train = screen_rows or SCREEN_ROWS, max_train or MAX_TRAIN
    rows = doc_text(docs) if where is None else doc_text(docs).filter(where)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("toxic IN (0, 1)")
    if where is not None:
        known = known.filter(where)
    # Rows are chosen by id and text hash, so only the sample's texts move, equal rows once.
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = written(hash_sample(rows.select("doc_id", "h").join(known, "doc_id").distinct(), screen_rows), "toxic-ids")
    sample = rows.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.min("text").alias("text"))
    sample = written(sample, "toxic-sample")
    odds = chosen_features(written(feature_counts(sample), "toxic-features"))
    steps = sample.join(F.broadcast(hash_sample(chosen, max_train)), ["doc_id", "h", "toxic"])
    return fit(odds, places(steps, {f: i for i, f in enumerate(odds)}).collect())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, float] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(cache) > WEIGHT_CACHE:
            cache.clear()
        model = shared.value
        scores = [model.score(t, cache) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                          ["doc_id", "score"])

    return map_arrow(doc_text(docs), run, "doc_id long, score double")


def locate(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, probability, sentence) of every offending sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, a, b, p, t[a:b]) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for a, b, p in shared.value.sentences(t) if p >= at_least]
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()))],
            ["doc_id", "start", "end", "probability", "sentence"])

    return map_arrow(doc_text(docs), run, "doc_id long, start long, end long, probability double, sentence string")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, float] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(cache) > WEIGHT_CACHE:
            cache.clear()
        texts = batch.column("text").to_pylist()
        return batch.filter(pa.array([shared.value.score(t or "", cache) < threshold for t in texts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows with crc32(doc_id) mod 5 = 0 are held out."""
    model = train(docs, labels, crc_mod("doc_id", 5) != 0)
    return scored(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
