"""Language-model scores by a weighted backoff automaton.

Tokens.  A-Z lower-cased, words split at ASCII white space, one end token per text.

Model.  Every word, and every pair and triple of words within a text (which starts behind an
end token) that occurs ``MIN_COUNT`` times or more in the training documents, is an n-gram of
the model; nothing else is left out.  States are the contexts that are followed by such an
n-gram, arcs the n-grams.  With absolute discounting the arc of h w weighs
P(w | h) = (c(hw) - D) / c(h) + g(h) P(w | h'), the failure arc of h leads to h without its first
word at weight g(h), the share that discounting frees; the root has an arc for every word,
(c + 1) / (N + V + 1), so probabilities over all words and "any unseen word" sum to one.

Scoring.  A text is read once from left to right.  The state is the longest suffix of what
was read that has arcs.  Without an arc for the token the automaton follows failure arcs,
adding their weights, until there is one; it adds the arc's weight and moves on.  The state
behind a token follows from the n-grams that end there, so the tokens of a window take
their steps together, each from the state that the one before it leaves; the last state is
carried into the next window.

Tables.  N-grams go by a 64-bit key: a polynomial hash of a word's bytes, or of the words'
keys, mixed, so two keys of billions of n-grams hardly ever agree.  The key's bucket (its top
bits) decides where an n-gram is counted, stored and looked up; buckets are even whatever the
text, and a word with a third of all tokens is one entry a task.  What moves between tasks are packed arrays of a bucket, not a row per n-gram.

Rounds.  Counting goes through the texts ``COUNT_ROUNDS`` times, each for a slice of the
buckets, so the shuffle holds a slice of the n-grams at a time.  Scoring goes
through slices of the texts (``SCORE_ROUNDS``): texts come in chunks by hash; a chunk asks
every bucket for its distinct n-grams, the answers (count and failure weight) come back to
the chunk, whose texts are then traversed.  Every table is written to the shared folder and
deleted when the next one stands; a lost executor costs the tasks that it ran.

Results.  Null texts count as empty: one end token.  Without training text every count is
zero and N = V = 0.  Repeated rows are scored as rows of their own; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import LOWER, batch_rows, crc_mod, doc_text, dropped, released, utf8, written

DISCOUNT = 0.75
MIN_COUNT = 2
COUNT_ROUNDS = 4
SCORE_ROUNDS = 6
BUCKET_BYTES = 8_000_000     # of training text for each bucket of n-grams
CHUNK_BYTES = 8_000_000      # of text whose n-grams are looked up together
FLUSH_BYTES = 16_000_000     # of text counted together
STRETCH = 1_000_000          # bytes hashed together
WINDOW = 100_000             # tokens whose arcs a traversal holds
TEXT_ROWS = 512              # texts of an Arrow batch
PACKED_ROWS = 8              # packed rows of an Arrow batch
HOT_ROWS = 1_000             # equal rows (id and text) beyond which they are scored once
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
GRAMS = "bucket int, key binary, context binary, n binary"
SCORED = "doc_id long, times long, n_tokens long, n_known long, base_score double, score double"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


END_KEY = mixed(np.array([1], np.uint64))[0]  # of no word: a word's key mixes its length and bytes


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    while out.size < n:
        out = np.concatenate([out, out * np.uint64(pow(base, out.size, 1 << 64))])
    return out[:n]


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens with an end token in front and behind every text, number of tokens of each
    text, its end included)."""
    data = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), np.uint8)
    inside = np.zeros(data.size + 2, bool)
    inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)  # bytes 9 to 13 and 32 are white space
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    # A word's hash is the difference of two prefix sums, shifted back to the power zero.  Stretches of
    # whole words are summed one after another, so the sums take no more memory than the keys.
    keys, at = np.empty(starts.size, np.uint64), 0
    up = down = np.ones(1, np.uint64)
    while at < starts.size:
        origin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, origin + STRETCH, "right")))
        size = int(ends[to - 1] - origin)
        if up.size < size:
            up, down = powers(size, BYTE_BASE), powers(size, pow(BYTE_BASE, -1, 1 << 64))
        sums = np.r_[np.uint64(0), np.cumsum((data[origin:origin + size].astype(np.uint64) + np.uint64(1)) * up[:size])]
        a, b = starts[at:to] - origin, ends[at:to] - origin
        keys[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * BASE)
        at = to
    text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    before = np.searchsorted(starts, text_ends)  # words up to the end of each text
    out = np.full(keys.size + len(texts) + 1, END_KEY, np.uint64)
    out[1 + np.arange(keys.size) + np.searchsorted(text_ends, starts, "right")] = keys
    return out, np.diff(np.r_[0, before]) + 1


def gram_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the word, pair and triple that end at each token but the first; where a triple
    would reach over a text's end token or in front of the array, the key is 0."""
    raw = words[:-1] * BASE + words[1:]
    triples = np.zeros_like(raw)
    triples[1:] = mixed((raw[:-1] * BASE + words[2:]) * BASE)
    triples[1:][words[1:-1] == END_KEY] = 0
    return words[1:], mixed(raw), triples


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are slices of the keys' order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def summed(keys: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with a context and the sum of n."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:keys.size])
    total = np.add.reduceat(n[order], first) if first.size else np.empty(0, np.int64)
    return keys[first], context[order[first]], total


def packed(buckets: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, the bytes of its keys and of their columns) of sorted keys."""
    bucket, columns = bucket_of(keys, buckets), (keys, *columns)
    edges = np.flatnonzero(np.diff(np.r_[-1, bucket, -1]))
    for a, b in zip(edges, edges[1:]):
        yield int(bucket[a]), [c[a:b].tobytes() for c in columns]


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind) if data else np.empty(0, kind)


def batch_of(rows: list[tuple[int, list[bytes]]], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    columns = list(zip(*[(b, *c) for b, c in rows])) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def count_grams(docs: DataFrame, buckets: int, part: int, rounds: int) -> DataFrame:
    """Packed (bucket, key, context, n) of the n-grams in a slice of the buckets, one of ``rounds``: all words
    (context 0), and the pairs and triples that occur ``MIN_COUNT`` times."""
    first, last = part * buckets // rounds, (part + 1) * buckets // rounds  # buckets of the slice
    least, beyond = (np.uint64(-(-(b << 32) // buckets) << 32) if b < buckets else None for b in (first, last))

    def counted(texts: list[bytes]) -> pa.RecordBatch:
        words, _ = word_keys(texts)
        grams = gram_keys(words)
        contexts = (np.zeros_like(grams[0]), words[:-1], np.r_[np.uint64(0), grams[1][:-1]])
        found = []
        for keys, context in zip(grams, contexts):
            mine = (keys >= least) & (keys != 0)
            if beyond is not None:
                mine &= keys < beyond
            found.append((keys[mine], context[mine]))
        keys, context = (np.concatenate(c) for c in zip(*found))
        keys, context, n = summed(keys, context, np.ones(keys.size, np.int64))
        rows = list(packed(buckets, keys, context, n.astype(np.uint32)))
        return batch_of(rows, ["bucket", "key", "context", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for b in batches:
            for text in utf8(b.column("text")):
                texts.append(text)
                size += len(text)
                if size > FLUSH_BYTES:  # bounds the worker's memory
                    yield counted(texts)
                    texts, size = [], 0
        if texts:
            yield counted(texts)

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        keys, context, n = summed(unpacked(rows["key"], np.uint64), unpacked(rows["context"], np.uint64),
                                  unpacked(rows["n"], np.uint32).astype(np.int64))
        kept = (n >= MIN_COUNT) | (context == 0)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "key": pa.array([keys[kept].tobytes()]),
                         "context": pa.array([context[kept].tobytes()]), "n": pa.array([n[kept].tobytes()])})

    return doc_text(docs).select("text").mapInArrow(run, GRAMS).groupBy("bucket").applyInArrow(merged, GRAMS)


def build(docs: DataFrame, rounds: int = COUNT_ROUNDS) -> tuple[DataFrame, int, int, int]:
    """(packed arcs, number of buckets, N, V) learned from all rows of ``docs``.

    Arcs are (bucket, key, n, left): the n-grams with their counts and, for those that are
    contexts, the weight of failing (1 for others), keys in order.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = rounds * max(2, -(-size // (BUCKET_BYTES * rounds)))
    with batch_rows(spark, TEXT_ROWS):
        parts = []
        for r in range(rounds):
            parts.append(written(count_grams(docs, buckets, r, rounds), "lm-grams"))
            released(spark)
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionByName(p)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for context, n in zip(b.column("context").to_pylist(), b.column("n").to_pylist()):
                own = np.frombuffer(n, np.int64)[np.frombuffer(context, np.uint64) == 0]
                yield pa.RecordBatch.from_arrays([pa.array([int(own.sum())]), pa.array([own.size])], ["n", "v"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the arcs of a context take of its count, to the context's bucket."""
        for b in batches:
            for context, n in zip(b.column("context").to_pylist(), b.column("n").to_pylist()):
                context, n = np.frombuffer(context, np.uint64), np.frombuffer(n, np.int64)
                arcs = context != 0
                keys, _, total = summed(context[arcs], context[arcs], np.round((n[arcs] - DISCOUNT) * 4).astype(np.int64))
                yield batch_of(list(packed(buckets, keys, total)), ["bucket", "key", "quarters"])

    def joined(key: tuple, grams: pa.Table, taken: pa.Table) -> pa.Table:
        keys, n = unpacked(grams["key"], np.uint64), unpacked(grams["n"], np.int64)
        of, _, quarters = summed(*(unpacked(taken["key"], np.uint64),) * 2, unpacked(taken["quarters"], np.int64))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        left = np.ones(keys.size, np.float32)
        at, found = lookup(keys, of)
        # Below 1 for every context, so that a state shows by its weight.
        left[at[found]] = np.clip(1.0 - quarters[found] / 4.0 / n[at[found]], 1e-7, 1.0 - 1e-7)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "key": pa.array([keys.tobytes()]),
                         "n": pa.array([n.tobytes()]), "left": pa.array([left.tobytes()])})

    with batch_rows(spark, PACKED_ROWS):
        total = grams.select("context", "n").mapInArrow(totals, "n long, v long").agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        shares = grams.select("context", "n").mapInArrow(taken, "bucket int, key binary, quarters binary")
        arcs = written(grams.select("bucket", "key", "n").groupBy("bucket").cogroup(shares.groupBy("bucket")).applyInArrow(
            joined, "bucket int, key binary, n binary, left binary"), "lm-arcs")
    dropped(*parts)
    return arcs, buckets, int(total[0]), int(total[1])


def lookup(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted ``keys``, whether they hold what was asked)."""
    at = np.searchsorted(keys, asked)
    at[at == keys.size] = 0
    return at, (keys[at] == asked) if keys.size else np.zeros(asked.size, bool)


class Arcs:
    """What a chunk's texts need of the model: sorted keys of n-grams, their counts and failure weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, left: np.ndarray, tokens: int, types: int):
        self.keys, self.counts, self.left, self.size = keys, counts, left, tokens + types + 1.0
        # Keys are even, so their first bits lead next to a key's place.
        bits = max(1, min(24, keys.size.bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.padded = np.r_[keys, np.uint64(MASK)]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, failure weights) of n-grams: 0 and 1 of those that the model lacks."""
        if not self.keys.size:
            return np.zeros(keys.size, np.int64), np.ones(keys.size)
        at = self.first[(keys >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.padded[at] < keys)
        while behind.size:
            at[behind] += 1
            behind = behind[self.padded[at[behind]] < keys[behind]]
        found = self.padded[at] == keys
        at[~found] = 0
        return np.where(found, self.counts[at], 0), np.where(found, self.left[at], 1.0).astype(np.float64)

    def read(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(log weight, log base probability, known) of the tokens, window by window."""
        n, left = self.of(words[:1])  # the end token in front of the first text
        start = int(left[0] < 1.0)
        state = start
        for a in range(0, words.size - 1, WINDOW):
            # The window's tokens with the one before them, whose n-grams are the contexts.
            lead = min(a, 1)
            window = words[a - lead:a + WINDOW + 1]
            (n1, left1), (n2, left2), (n3, _) = (self.of(g) for g in gram_keys(window))
            if not lead:
                n1, left1, n2, left2, n3 = np.r_[n, n1], np.r_[left, left1], np.r_[0, n2], np.r_[1.0, left2], np.r_[0, n3]
            fail = (np.zeros(n1.size - 1), np.log10(left1[:-1]), np.log10(left2[:-1]))
            p1 = (n1[1:] + 1.0) / self.size
            has = (np.ones(p1.size, bool), n2[1:] > 0, n3[1:] > 0)
            low = left1[:-1] * p1
            p2 = np.where(has[1], (n2[1:] - DISCOUNT) / np.maximum(n1[:-1], 1) + low, low)
            p3 = np.where(has[2], (n3[1:] - DISCOUNT) / np.maximum(n2[:-1], 1) + left2[:-1] * p2, 1.0)
            arc = np.log10(np.stack([p1, p2, p3]))
            # The state behind each token: its pair or its word if that has arcs; behind an end
            # token a new text starts.
            behind = np.where(left2[1:] < 1.0, 2, np.where(left1[1:] < 1.0, 1, 0))
            behind = np.where(window[1 + lead:] == END_KEY, start, behind)
            at, weight = np.r_[state, behind[:-1]], np.zeros(p1.size)
            for level in (2, 1):  # failure arcs, from the longest context down
                failing = (at == level) & ~has[level]
                weight[failing] += fail[level][failing]
                at[failing] = level - 1
            state = int(behind[-1])
            yield weight + arc[at, np.arange(p1.size)], arc[0], n1[1:] > 0


def traverse(words: np.ndarray, sizes: np.ndarray, arcs: Arcs) -> list[tuple[int, int, float, float]]:
    """(tokens, known tokens, base score, score) of every text, each read once from left to right."""
    text = np.repeat(np.arange(sizes.size), sizes)
    sums, at = np.zeros((3, sizes.size)), 0
    for weight, base, known in arcs.read(words):
        own = text[at:at + weight.size]
        for total, x in zip(sums, (weight, base, known)):
            total += np.bincount(own, x, sizes.size)
        at += weight.size
    return list(zip(sizes.tolist(), np.rint(sums[2]).astype(np.int64).tolist(), sums[1].tolist(), sums[0].tolist()))


def score(docs: DataFrame, arcs: DataFrame, buckets: int, tokens: int, types: int, rounds: int = SCORE_ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row, written to the shared folder."""
    spark = docs.sparkSession
    rows = doc_text(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = rounds * max(1, -(-size // (CHUNK_BYTES * rounds)))
    own = F.xxhash64("doc_id", "text")
    rows = rows.withColumn("h", own).withColumn("times", F.lit(1).cast("long"))
    # A row may be repeated any number of times; its copies would share a chunk, so they are scored once.
    hot = written(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select("h"), "lm-hot")
    if not hot.isEmpty():
        once = rows.join(hot, "h", "left_semi").groupBy("doc_id", "text", "h").agg(F.count("*").alias("times"))
        rows = rows.join(hot, "h", "left_anti").unionByName(once)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(chunks)).cast("int")).drop("h")

    def asked(key: tuple, texts: pa.Table) -> pa.Table:
        """The distinct n-grams of a chunk, packed for each bucket."""
        keys = np.concatenate([*gram_keys(word_keys(utf8(texts["text"].combine_chunks()))[0]), np.array([END_KEY], np.uint64)])
        keys.sort()
        keys = keys[(keys != 0) & np.r_[True, keys[1:] != keys[:-1]]]
        out = batch_of(list(packed(buckets, keys)), ["bucket", "key"])
        return pa.table({"chunk": pa.array([key[0].as_py()] * out.num_rows, pa.int32()), "bucket": out["bucket"], "key": out["key"]})

    def answered(key: tuple, arcs: pa.Table, asked: pa.Table) -> pa.Table:
        """What the bucket knows of each chunk's n-grams."""
        keys, n, left = unpacked(arcs["key"], np.uint64), unpacked(arcs["n"], np.int64), unpacked(arcs["left"], np.float32)
        out = []
        for chunk, own in zip(asked["chunk"].to_pylist(), asked["key"].to_pylist()):
            own = np.frombuffer(own, np.uint64)
            at, found = lookup(keys, own)
            at = at[found]
            out.append((chunk, [own[found].tobytes(), n[at].tobytes(), left[at].tobytes()]))
        answer = batch_of(out, ["chunk", "key", "n", "left"])
        return pa.Table.from_batches([answer])

    def scored(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.schema([(c, pa.int64()) for c in ("doc_id", "times", "n_tokens", "n_known")]
                             + [(c, pa.float64()) for c in ("base_score", "score")]).empty_table()
        known = unpacked(answers["key"], np.uint64)
        order = np.argsort(known)
        words, sizes = word_keys(utf8(texts["text"].combine_chunks()))
        found = traverse(words, sizes, Arcs(known[order], unpacked(answers["n"], np.int64)[order],
                                            unpacked(answers["left"], np.float32)[order], tokens, types))
        n, seen, base, lm = (list(c) for c in zip(*found))
        return pa.table({"doc_id": texts["doc_id"], "times": texts["times"], "n_tokens": pa.array(n, pa.int64()),
                         "n_known": pa.array(seen, pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(lm, pa.float64())})

    parts = []
    for r in range(rounds):
        mine = rows.filter(F.col("chunk") % rounds == r)
        with batch_rows(spark, TEXT_ROWS):
            requests = mine.select("chunk", "text").groupBy("chunk").applyInArrow(asked, "chunk int, bucket int, key binary")
            answers = written(arcs.groupBy("bucket").cogroup(requests.groupBy("bucket")).applyInArrow(
                answered, "chunk int, key binary, n binary, left binary"), "lm-answers")
            parts.append(written(mine.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, SCORED), "lm-scores"))
        dropped(answers)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times")


def query(docs: DataFrame) -> DataFrame:
    """Scores of all rows, learned from those whose crc32(doc_id) mod 7 is not 2."""
    arcs, buckets, tokens, types = build(docs.filter(crc_mod("doc_id", 7) != 2))
    return score(docs, arcs, buckets, tokens, types).select(
        "doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
