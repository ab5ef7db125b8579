"""Language identification by rank-order n-gram profiles.

Profiles.  A text is lower-cased; its letters stay, everything else becomes a word border.
The n-grams of 1 to 3 characters inside a word and its borders are counted; a profile is
the ``PROFILE`` most frequent n-grams in order of rank (ties: by code).  Training counts
n-grams over all training documents: workers count words per language, turn distinct words
into n-grams and Spark sums (language, n-gram) counts; only the top ``PROFILE`` per
language leave it.

Prediction.  A document's own profile is compared with each language's by out-of-place
distance: the sum of rank differences, ``PROFILE`` for an n-gram the language lacks.  The
least distance wins (ties: the language that sorts first).  The score is how much nearer
the winner is than the mean of all languages would make it: best similarity over the sum of
similarities.

Results.  A null text, or one without a letter, is ``und`` with score 0; so is everything
when no training row has a language.  The number of languages is bounded by
``MAX_LANGUAGES`` (an error beyond it).  Rows are independent; repeated rows agree; an empty
table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import crc_mod, map_arrow

PROFILE = 300
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 1000
FLUSH_WORDS = 400_000
BORDER = 1  # stands for every character that is not a letter; 0 pads shorter n-grams


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Each code point itself if it is a letter, else BORDER."""
    table = np.full(0x110000, BORDER, np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = c
    return table


def letter_codes(text: str, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Codes of a lower-cased text with single borders between words and at both ends, and
    the weights (one per character) that go with them."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[BORDER], letters()[raw], [BORDER]])
    keep = np.ones(codes.size, bool)
    keep[1:] = (codes[1:] != BORDER) | (codes[:-1] != BORDER)
    return codes[keep], None if weights is None else np.concatenate([[0], weights, [0]])[keep]


def grams(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Codes of the n-grams of all orders, 21 bits a character, and the weights of the words
    they lie in; none runs over a border."""
    out, heavy = [], []
    inner = codes != BORDER
    for n in ORDERS:
        size = codes.size - n + 1
        if size < 1:
            continue
        value, ok = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(n):
            value = (value << 21) | codes[k:k + size]
            if 0 < k < n - 1 or n == 1:
                ok &= inner[k:k + size]  # a border may only stand at an end
        if n == 2:
            ok &= inner[:size] | inner[1:]
        out.append(value[ok])
        if weights is not None:
            at = np.full(size, n // 2)  # a letter of the n-gram: its middle, or in pairs
            if n == 2:
                at = np.where(inner[:size], 0, 1)  # the one that is not a border
            heavy.append(weights[(np.arange(size) + at)[ok]])
    none = [np.empty(0, np.int64)]
    return np.concatenate(out or none), None if weights is None else np.concatenate(heavy or none)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes by rank; ties by code."""
    if codes.size > size:  # keep everything that could be among them
        least = -np.partition(-counts, size - 1)[size - 1]
        codes, counts = codes[counts >= least], counts[counts >= least]
    order = np.lexsort((codes, -counts))[:size]
    return codes[order]


def text_profile(text: str) -> np.ndarray:
    codes, counts = np.unique(grams(letter_codes(text.lower())[0])[0], return_counts=True)
    return ranked(codes, counts)


class Profiles:
    """The profiles of all languages as one sorted table: n-gram -> rank per language."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.names = sorted(ranks)
        self.codes = np.unique(np.array([c for v in ranks.values() for c in v], np.int64))
        self.ranks = np.full((self.codes.size + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            at = np.searchsorted(self.codes, np.array(ranks[name], np.int64))
            self.ranks[at, k] = np.arange(at.size)

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = text_profile(text) if text else np.empty(0, np.int64)
        if not mine.size or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, mine)
        at[at >= self.codes.size] = 0
        known = self.codes[at] == mine
        theirs = self.ranks[np.where(known, at, self.codes.size)]
        place = np.arange(mine.size)[:, None]
        distance = np.where(theirs >= 0, np.minimum(np.abs(theirs - place), PROFILE), PROFILE).sum(axis=0)
        like = 1.0 - distance / (PROFILE * mine.size)
        best = int(np.argmin(distance))
        total = float(like.sum())
        return self.names[best], float(like[best] / total) if total > 0 else 0.0


def gram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes and counts of a bag of lower-cased words."""
    names = list(words)
    weights = np.repeat(np.fromiter(words.values(), np.int64, len(names)), [len(w) + 1 for w in names])
    codes, weights = letter_codes(" ".join([*names, ""]), weights)
    flat, weights = grams(codes, weights)
    unique, at = np.unique(flat, return_inverse=True)
    return unique, np.bincount(at, weights, unique.size).astype(np.int64)


def train(docs: DataFrame, where: Column | None = None) -> Profiles:
    """Profiles of the languages of ``docs`` (columns text, lang) from all rows ``where``."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       (F.lit(True) if where is None else where).alias("use"))
    rows = rows.filter("use AND text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")

    def batch_of(held: dict[str, Counter]) -> pa.RecordBatch:
        langs, codes, counts = [], [], []
        for lang, words in held.items():
            c, n = gram_counts(words)
            langs += [lang] * c.size
            codes.append(c)
            counts.append(n)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)),
                                           pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) > FLUSH_WORDS:  # bounds the worker's memory
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).filter(F.col("place") <= PROFILE)
    found = top.orderBy("lang", "place").limit(PROFILE * MAX_LANGUAGES + 1).collect()
    if len(found) > PROFILE * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    ranks: dict[str, list[int]] = {}
    for r in found:
        ranks.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows with crc32(doc_id) mod 3 = 1 are held out."""
    profiles = train(docs, crc_mod("doc_id", 3) != 1)
    return identify(docs, profiles).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
