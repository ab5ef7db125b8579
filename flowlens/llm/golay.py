"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprint.  A text's words (A-Z lower-cased, white space of ASCII) give ``SHINGLE``-word
shingles; a fingerprint bit is set when over half of the shingles' XXH64 values (seed 42)
have it.  Fewer words: one shingle of them all; none (null and empty texts): zero.

Candidates.  The binary Golay code of length 23 is perfect: each 23-bit word lies within 3
bits of exactly one codeword.  Let centre(x) be that codeword's index and keys(x) the
centres of x and its 23 neighbours (one to six indices).  Words one bit apart satisfy
centre(y) in keys(x); words two bits apart share a key.  A fingerprint is cut into three
segments of 22, 21 and 21 bits.  Of at most four differing bits the two least hit segments
hold at most two, so either
  * two segments differ by at most one bit each: with the keys (keys(a), centre(b)) and
    (centre(a), keys(b)) both fingerprints hold (centre_y(a), centre_x(b)); or
  * one segment is equal and the others differ by two: (segment value, keys of the next).
Fingerprints that share a key are candidates; each is verified by its exact distance.

Scale.  Work is on distinct fingerprints, so groups of equal texts cost one row.  Keys that
many fingerprints share are cut into blocks that meet pairwise in tasks of their own (no
task sees more than two blocks); inside a run only a spanning forest of the verified links
is returned, never all pairs.  Links go through ``components``.

Results.  Repeated rows share their fingerprint and component; null doc_ids keep their row,
and a component whose ids are all null has a null id; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import LOWER, batch_rows, doc_text, hex16, kept, map_arrow, takes_worker, utf8, written
from flowlens.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
SEGMENTS = (22, 21, 21)
BLOCK = 4096  # a key with more than two blocks of fingerprints is cut into blocks
SHORT = 32  # runs up to this length are compared pair by pair in one vectorised pass
KEY_BATCH = 20_000  # rows of an Arrow batch once texts have become fingerprints
# Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of every n-word shingle of a text, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))  # ends[i]: where word i - 1 stops
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a + 1:b], SEED) for a, b in zip(ends, ends[n:])], np.uint64)


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes as a signed 64-bit integer."""
    h = shingle_hashes(text, n)
    if not h.size:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, h.size, 8192):
        part = np.unpackbits(h[at:at + 8192, None].view(np.uint8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """(doc_id, fp) and the long columns ``keep``: one row per row of ``docs``."""
    names = ["doc_id", *keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in utf8(batch.column("text"))]
        return pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(fps, pa.int64())], [*names, "fp"])

    return map_arrow(doc_text(docs, *keep), run, ", ".join(f"`{c}` long" for c in [*names, "fp"]))


@lru_cache(maxsize=1)
def centres() -> np.ndarray:
    """Index of the nearest codeword of every 23-bit word."""
    kept(__name__, centres.cache_clear)
    words = np.zeros(1, np.int64)
    for i in range(12):  # the span of the generator's shifts
        words = np.concatenate([words, words ^ (GENERATOR << i)])
    table = np.full(1 << 23, -1, np.int16)
    index = np.arange(words.size, dtype=np.int16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            table[words ^ sum(1 << b for b in bits)] = index
    return table


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u, out = fp.view(np.uint64), []
    for width in SEGMENTS:
        out.append((u & np.uint64((1 << width) - 1)).astype(np.int64))
        u = u >> np.uint64(width)
    return out


def segment_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, keys): keys has a row per word of six indices, -1 where there are fewer."""
    table = centres()
    found = np.stack([table[x], *[table[x ^ (1 << b)] for b in range(23)]], axis=1)
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found.sort(axis=1)
    return table[x].astype(np.int64), found[:, -6:].astype(np.int64)


def fingerprint_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of every fingerprint, each once."""
    segs = segments(fp)
    decoded = [segment_keys(s) for s in segs]
    rows, keys = [], []

    def add(table: int, at: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        rows.append(at)
        keys.append((np.int64(table) << 48) | (high << 12) | low)

    for table, (a, b) in enumerate(combinations(range(3), 2)):
        (ca, ka), (cb, kb) = decoded[a], decoded[b]
        at, col = np.nonzero(ka >= 0)  # centre of b with the keys of a
        add(table, at, cb[at], ka[at, col])
        at, col = np.nonzero((kb >= 0) & (kb != cb[:, None]))  # keys of b with the centre of a
        add(table, at, kb[at, col], ca[at])
    for a in range(3):  # the segment's value with the keys of the next
        keys_next = decoded[(a + 1) % 3][1]
        at, col = np.nonzero(keys_next >= 0)
        add(3 + a, at, segs[a][at], keys_next[at, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.asarray(batch.column("fp"))
        at, key = fingerprint_keys(fp)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], ["key", "fp"])

    return map_arrow(fps.select("fp"), run, "key long, fp long")


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= distance


def forest(fp: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints: each one reached is
    compared with those not reached yet, so a dense group costs little more than its size."""
    rest, left, right = fp, [], []
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            hit = _near(rest, x, distance)
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                left.append(np.full(new.size, x))
                right.append(new)
                queue.extend(new)
    return left, right


def _run_links(run: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted input): short runs lag by lag, all at once;
    long ones by their spanning forest."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, run.size])
    left, right = [], []
    short = np.repeat(sizes <= SHORT, sizes)
    for lag in range(1, int(min(SHORT, sizes.max(initial=1)))):
        i = np.flatnonzero((run[lag:] == run[:-lag]) & short[lag:])
        if not i.size:
            break
        i = i[_near(fp[i], fp[i + lag], distance)]
        left.append(fp[i])
        right.append(fp[i + lag])
    for at, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        a, b = forest(fp[at:at + size], distance)
        left += a
        right += b
    none = [np.empty(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _in_runs(df: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Links among rows that share ``by``; a run holds two blocks at most."""
    sorted_rows = df.repartition(*by).sortWithinPartitions(*by)

    def links(table: pa.Table) -> pa.RecordBatch:
        key = np.zeros(table.num_rows, np.int64)
        for c in by:  # consecutive numbers of the runs
            v = np.asarray(table.column(c))
            key[1:] |= v[1:] != v[:-1]
        a, b = _run_links(np.cumsum(key), np.asarray(table.column("fp")), distance)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_worker(__name__)
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < 200_000:
                continue
            same = np.ones(held.num_rows, bool)  # the last run may go on in the next batch
            for c in by:
                v = np.asarray(held.column(c))
                same &= v == v[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    return sorted_rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect the same
    components as all pairs at ``distance`` or fewer differing bits."""
    if distance > DISTANCE:
        raise ValueError(f"the keys find up to {DISTANCE} differing bits")
    # The keys are recomputed by each reader: that is cheaper than storing them.
    keyed = _keyed(fps)
    hot = (keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * block)
           .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    hot = written(hot, "hot-keys")
    if hot.isEmpty():
        return _in_runs(keyed, ["key"], distance)
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A row of block i goes to the pairs (i, j) and (j, i) of blocks, i included.
    split = (keyed.join(hot, "key").withColumn("i", mine)
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp"))
    cold = keyed.join(hot.select("key"), "key", "left_anti")
    return _in_runs(cold, ["key"], distance).unionByName(
        _in_runs(split, ["key", "lo", "hi"], distance)).distinct()


def rooted(known: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, first, root) of a table of distinct fingerprints: root is the least fingerprint
    of those reachable at ``distance`` or fewer differing bits."""
    known = written(known, "distinct-fingerprints")
    with batch_rows(known.sparkSession, KEY_BATCH):
        roots = components(links(known, distance)).select(F.col("node").alias("fp"), "root")
    return known.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def first_rows(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(row) of one row of each component: the least by doc_id (nulls last), text hash and row.

    ``rows`` has doc_id, fp, hash and row, a number of its own for each row.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "row")
    linked = rooted(rows.groupBy("fp").agg(F.min(rank).alias("first")), distance)
    return linked.groupBy("root").agg(F.min("first").alias("first")).select("first.row")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable through
    fingerprints at ``distance`` or fewer differing bits."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    # One row per fingerprint; its least doc_id is found by partial aggregation.
    linked = rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), distance)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
