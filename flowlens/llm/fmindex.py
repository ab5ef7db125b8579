"""Benchmark decontamination with one FM-index per shard of the training documents.

Words.  A-Z lower-cased, runs of letters, digits and everything beyond ASCII.

Index.  A task gathers the texts of its partition into shards of about ``SHARD_WORDS``
words (equal texts of a shard once; longer texts in pieces that overlap by
``MAX_PHRASE - 1`` words).  A shard's words, an end symbol behind every text, are sorted as
suffixes by prefix doubling: keys of the first words, then only unresolved runs again with
the rank of their continuation.  Stored are the Burrows-Wheeler string as a levelwise
wavelet tree (one bit vector per bit of the symbol, ranks by population counts), the
symbols' counts, the shard's dictionary, and the text position of every suffix that starts
at a multiple of ``SAMPLE`` words of its text, marked in a bit vector.  The index is a table
in the shared folder, one row per shard: about the size of the packed documents, written
once, searched for any phrases of up to ``MAX_PHRASE`` words.

Search.  Phrases are the distinct windows of ``window`` words of the items, broadcast in
blocks of ``BLOCK`` phrases; blocks follow one another over the index.  All phrases of a
block extend backwards together, a word a step, each by two ranks in the wavelet tree; those
with an empty range drop out.  Rows of the remaining ranges walk to the next sampled suffix,
which locates them.  Occurrences of a text are merged to removal spans in words; every
row with the text gets them.  Ranks find all occurrences: there is no candidate cap.

Spark.  Both passes are map-only; the parts of a row from several blocks or pieces meet in a
grouped merge by row.  A lost executor costs a shard to be built or searched again.

Results.  A null or empty text has no words and no hit.  Items without words have no
window; items of fewer than ``window`` words are one window.  Rows of one item_id are
one item, a null id counts as the empty one.  Repeated rows are judged alike, an empty
``documents`` gives no rows, an empty ``benchmark`` no hits; other columns are not read.
``decontaminated`` cuts the spans out of the texts and keeps all columns.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch_rows, written

WINDOW = 10
MAX_PHRASE = 64
SHARD_WORDS = 1_000_000
SAMPLE = 32
BLOCK = 200_000
SHARDS_AT_ONCE = 2
# Bytes to themselves in lower case, or to a space between words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
INDEX = "docs array<struct<row: long, doc_id: long, n_words: long, h1: long, h2: long, slot: int, first: long>>, shard binary"
HITS = ("row long, doc_id long, n_words long, h1 long, h2 long, "
        "spans array<struct<start: long, end: long>>, items array<string>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Ranks:
    """A bit vector: ``before(i)`` counts the ones in front of i."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sums = np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int32)

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        """The bits in 64-bit words, with one word more so that every end can be asked for."""
        out = np.zeros(bits.size // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        out.view(np.uint8)[:packed.size] = packed
        return out

    def before(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.sums[word] + np.bitwise_count(inside)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order.  ``symbols`` ends with a symbol that occurs once, and any two
    equal stretches end before such a symbol (so every suffix is told apart)."""
    n = symbols.size
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    depth = min(n, max(1, 62 // bits))
    key = symbols.astype(np.int64)
    for step in range(1, depth):
        key <<= bits
        key[:n - step] |= symbols[step:]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    slots, keys = np.arange(n), key  # all rows, then those of runs with equal keys
    while True:
        head = np.r_[True, keys[1:] != keys[:-1]]
        first = slots[np.maximum.accumulate(np.where(head, np.arange(slots.size), 0))]
        rank[order[slots]] = first
        alone = head & np.r_[head[1:], True]
        slots = slots[~alone]
        if not slots.size:
            return order
        starts = order[slots]
        keys = rank[starts] * n + rank[starts + depth]
        again = np.argsort(keys)
        keys = keys[again]
        order[slots] = starts[again]
        depth *= 2


class Shard:
    """FM-index of a list of texts, each a list of words.

    Symbol 0 ends a text; the rows of these ends come first.  A range is never extended by
    symbol 0 and a text's first word is sampled, so no step crosses from text to text.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, levels: list[np.ndarray], marks: np.ndarray,
                 samples: np.ndarray, starts: np.ndarray):
        self.symbol = {w: i for i, w in enumerate(words, 1)}
        self.levels = [Ranks(w) for w in levels]
        self.marks, self.samples, self.starts = Ranks(marks), samples, starts
        self.size = int(counts.sum())
        self.zeros = [self.size - int(r.before(np.array([self.size]))[0]) for r in self.levels]
        self.first = np.r_[0, np.cumsum(counts)]  # rows in front of each symbol's
        # In the last level symbols lie in the order of their reversed bits.
        reversed_bits = np.zeros(counts.size, np.int64)
        for b in range(len(levels)):
            reversed_bits |= ((np.arange(counts.size) >> b) & 1) << (len(levels) - 1 - b)
        by = np.argsort(reversed_bits)
        self.block = np.empty(counts.size, np.int64)
        self.block[by] = np.r_[0, np.cumsum(counts[by])][:-1]

    @staticmethod
    def build(texts: list[list[bytes]]) -> bytes:
        """The stored form of the index over ``texts``."""
        symbol: dict[bytes, int] = defaultdict()
        symbol.default_factory = lambda: len(symbol) + 1
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        string = np.zeros(int(sizes.sum()) + len(texts), np.int64)
        for start, text in zip(starts.tolist(), texts):
            string[start:start + len(text)] = np.fromiter(map(symbol.__getitem__, text), np.int64, len(text))
        ends = starts + sizes
        # The ends of texts become distinct symbols below all words.
        distinct = string + (len(texts) - 1)
        distinct[ends] = np.arange(len(texts))
        order = suffix_array(distinct)
        bwt = string[order - 1]  # the row of position 0 gets the last symbol, an end
        counts = np.bincount(string, minlength=len(symbol) + 1)
        levels, rest = [], bwt.astype(np.int32)
        for b in reversed(range(max(1, len(symbol).bit_length()))):
            bits = (rest >> b) & 1 == 1
            levels.append(Ranks.packed(bits))
            rest = np.concatenate([rest[~bits], rest[bits]])
        offset = np.arange(string.size) - np.repeat(starts, sizes + 1)
        marked = (offset % SAMPLE == 0)[order]
        return pickle.dumps((b"\n".join(symbol), counts, levels, Ranks.packed(marked), order[marked].astype(np.int32),
                             starts), protocol=5)

    @classmethod
    def load(cls, stored: bytes) -> Shard:
        words, *rest = pickle.loads(stored)
        return cls(words.split(b"\n") if words else [], *rest)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in front of place i of the string of last symbols."""
        for b, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (len(self.levels) - 1 - b)) & 1 == 1
            before = ones.before(i)
            i = np.where(bit, zeros + before, i - before)
        return i - self.block[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start a word earlier."""
        symbol, i = np.zeros(row.size, np.int64), row
        for ones, zeros in zip(self.levels, self.zeros):
            bit, before = ones.at(i), ones.before(i)
            symbol = symbol << 1 | bit
            i = np.where(bit, zeros + before, i - before)
        return self.first[symbol] + i - self.block[symbol]

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row behind the last) of all phrases that occur; ``phrases`` holds symbols,
        right-aligned, 0 for words that the shard lacks."""
        width = phrases.shape[1]
        inside = np.arange(width) >= width - sizes[:, None]
        at = np.flatnonzero((inside & (phrases == 0)).sum(axis=1) == 0)
        low, high = self.first[phrases[at, -1]], self.first[phrases[at, -1] + 1]
        done = []
        for step in range(1, width + 1):
            ended = sizes[at] == step
            done.append((at[ended], low[ended], high[ended]))
            at, low, high = at[~ended], low[~ended], high[~ended]
            if not at.size:
                break
            symbol = phrases[at, width - 1 - step]
            low, high = (self.first[symbol] + self.rank(symbol, i) for i in (low, high))
            found = low < high
            at, low, high = at[found], low[found], high[found]
        return tuple(np.concatenate(c) for c in zip(*done))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out, at, steps = np.empty(row.size, np.int64), np.arange(row.size), 0
        while at.size:
            known = self.marks.at(row)
            out[at[known]] = self.samples[self.marks.before(row[known])] + steps
            at, row, steps = at[~known], self.back(row[~known]), steps + 1
        return out


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of all rows, written to the shared folder: a row per shard, with its documents."""

    def shard(contents: list[list[bytes]], docs: list[tuple]) -> pa.RecordBatch:
        names = ["row", "doc_id", "n_words", "h1", "h2", "slot", "first"]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*docs), kinds)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays([0, len(docs)], pa.StructArray.from_arrays(columns, names)),
             pa.array([Shard.build(contents)], pa.binary())], ["docs", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, contents, docs, size = {}, [], [], 0
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "h1", "h2")),
                       b.column("text").cast(pa.binary()).to_pylist())
            for row, doc_id, h1, h2, text in rows:
                if text in slots:
                    docs.append((row, doc_id, len(contents[slots[text]]), h1, h2, slots[text], 0))
                    continue
                words = words_of(text)
                n = len(words)
                if n <= shard_words:
                    slots[text] = len(contents)
                    docs.append((row, doc_id, n, h1, h2, slots[text], 0))
                    contents.append(words)
                    size += n + 1
                else:  # pieces, each with the words that a phrase from the one before may reach
                    for first in range(0, n, shard_words):
                        docs.append((row, doc_id, n, h1, h2, len(contents), first))
                        contents.append(words[first:first + shard_words + MAX_PHRASE - 1])
                        size += len(contents[-1]) + 1
                        if size > shard_words:
                            yield shard(contents, docs)
                            slots, contents, docs, size = {}, [], [], 0
                if size > shard_words:
                    yield shard(contents, docs)
                    slots, contents, docs, size = {}, [], [], 0
        if docs:
            yield shard(contents, docs)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       *text_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, INDEX), "fm-index")


def text_key(text: str = "text") -> list[Column]:
    """128 bits (h1, h2) that stand for a text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")]


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(phrase array<binary>, items array<string>): the distinct windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(item, words[i:i + size]) for item, text in zip(b.column("item").to_pylist(),
                                                                    b.column("text").cast(pa.binary()).to_pylist())
                     if (words := words_of(text)) for i in range(max(1, len(words) - size + 1))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()),
                                              pa.array([p for _, p in found], pa.list_(pa.binary()))], ["item", "phrase"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (items.mapInArrow(run, "item string, phrase array<binary>").groupBy("phrase")
            .agg(F.collect_set("item").alias("items")))


def _searched(index: DataFrame, phrases: list) -> DataFrame:
    """(row, doc_id, n_words, h1, h2, spans, items) of every document of the index, or piece of it."""
    vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for p in phrases for w in p["phrase"]}))}
    sizes = np.array([len(p["phrase"]) for p in phrases], np.int64)
    table = np.zeros((len(phrases), int(sizes.max(initial=1))), np.int32)
    for row, p in zip(table, phrases):
        row[table.shape[1] - len(p["phrase"]):] = [vocabulary[bytes(w)] for w in p["phrase"]]
    shared = index.sparkSession.sparkContext.broadcast((list(vocabulary), table, sizes, [p["items"] for p in phrases]))

    def search(shard: Shard, docs: pa.StructArray) -> pa.RecordBatch:
        words, table, sizes, items = shared.value
        symbols = np.array([shard.symbol.get(w, 0) for w in words], np.int64)
        phrase, low, high = shard.ranges(symbols[table], sizes) if words else (np.empty(0, np.int64),) * 3
        n = high - low
        place = shard.locate(np.repeat(low - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum()))
        phrase = np.repeat(phrase, n)
        # Words under any occurrence; an end symbol lies under none, so no span leaves its text.
        covered = np.cumsum(np.bincount(place, minlength=shard.size + 1)
                            - np.bincount(place + sizes[phrase], minlength=shard.size + 1)) > 0
        edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
        starts, ends = edges[0::2], edges[1::2]
        text_of = lambda p: np.searchsorted(shard.starts, p, "right") - 1
        spans, of = defaultdict(list), text_of(starts)
        for t, a, b in zip(of.tolist(), (starts - shard.starts[of]).tolist(), (ends - shard.starts[of]).tolist()):
            spans[t].append((a, b))
        hit = defaultdict(set)
        for t, p in np.unique(np.stack([text_of(place), phrase], axis=1), axis=0).tolist():
            hit[t].update(items[p])
        slot, first = docs.field("slot").to_pylist(), docs.field("first").to_pylist()
        moved = [[{"start": a + f, "end": b + f} for a, b in spans.get(s, ())] for s, f in zip(slot, first)]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [*(docs.field(c) for c in ("row", "doc_id", "n_words", "h1", "h2")), pa.array(moved, span),
             pa.array([sorted(hit.get(s, ())) for s in slot], pa.list_(pa.string()))],
            ["row", "doc_id", "n_words", "h1", "h2", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield search(Shard.load(b.column("shard")[i].as_py()), b.column("docs").slice(i, 1).flatten())

    return index.mapInArrow(run, HITS)


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    span = "array<struct<start: bigint, end: bigint>>"

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)  # null at first
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.coalesce(last["end"] >= s["start"], F.lit(False)),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
                          F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(span), add)


def search(index: DataFrame, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, spans, items, h1, h2) of every indexed row: the merged removal spans in
    words and the ids of the items with an occurrence."""
    phrases = written(phrases, "phrases")
    blocks = max(1, -(-phrases.count() // block))
    parts = None
    with batch_rows(index.sparkSession, SHARDS_AT_ONCE):
        for number in range(blocks):
            own = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == number).collect()  # about ``block`` rows
            part = written(_searched(index, own), "fm-hits")
            parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("h1").alias("h1"), F.max("h2").alias("h2")).drop("row")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``search`` of all rows of ``docs`` for the windows of all items of ``benchmark``."""
    if not 0 < window <= MAX_PHRASE:
        raise ValueError(f"windows hold 1 to {MAX_PHRASE} words")
    return search(build_index(docs), windows(benchmark, window))


def decontaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; the spans of ``found`` are cut out of the texts."""
    own = "_".join(["key", *docs.columns])  # names that no column has
    h1, h2 = text_key()
    spans = found.filter(F.size("spans") > 0).select(F.col("h1").alias(f"{own}1"), F.col("h2").alias(f"{own}2"),
                                                     F.col("spans").alias(f"{own}s")).dropDuplicates([f"{own}1", f"{own}2"])
    rows = docs.withColumn(f"{own}1", h1).withColumn(f"{own}2", h2).join(spans, [f"{own}1", f"{own}2"], "left")
    names = list(docs.columns)

    def cut(text: str | None, spans: list | None) -> str | None:
        if not spans:
            return text
        data = text.encode()
        bits = np.frombuffer(data.translate(FOLD), np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.r_[False, bits, False]))
        starts, ends = edges[0::2], edges[1::2]
        at, left = 0, []
        for s in spans:
            left.append(data[at:starts[s["start"]]])
            at = ends[s["end"] - 1]
        return b"".join([*left, data[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut(t, s) for t, s in zip(b.column("text").to_pylist(), b.column(f"{own}s").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return rows.select(*names, f"{own}s").mapInArrow(run, docs.schema)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row of every document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


# Only ASCII letters change case; a backslash class cannot name all characters beyond ASCII, its complement can.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + 9] AS p
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (
  SELECT r, n, i, w[i:i + n - 1] AS p
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT r, i, n, item_id FROM grams JOIN win USING (n, p)),
hit AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
