"""Vector codes: a vector's parts as indices into learned codebooks, by Orchard's search.

Vectors.  Components become integers floor(256 x).  A vector is cut into ``PARTS`` equal
consecutive parts; each part position has a codebook that starts as that part of the
``ENTRIES`` smallest ids and is refined by rounds of assignment and componentwise
floor(sum / count).

Search.  For every entry a list of all other entries by distance is kept.  From a first
guess (the entry nearest in the first component) the search reads the list of its best
entry so far: an unvisited entry is compared and marked; a better one makes the search
jump to that entry's list; once the listed distance exceeds twice the current one, the
triangle inequality excludes the rest and the search ends.  Distances are compared as
squared integers, so "beyond twice" is more than four times the square, ties are kept and
go to the lower index.  All vectors of a batch advance together, one list place a step.

Spark.  Every round is one scan: tasks keep sums and counts by (part, entry, place), a
bounded table, which Spark adds up; the driver holds codebooks only (``PARTS`` x
``ENTRIES`` x width integers).  The codes are written once, labels get their error by a
grouped sum that is joined back, so a label with a third of all rows is one partial row
a task and a join that Spark may split.

Results.  Rows whose vector is null or holds a null or non-finite component are dropped.
A shorter vector counts as padded with zeros to the longest, whose length is padded to a
multiple of ``PARTS``.  Rows without id come after all others, equal ids in the order of
their components; every row is coded on its own.  Fewer rows than ``ENTRIES`` give shorter
codebooks, an empty table no rows.  Components saturate where sums of squares would leave
64 bits (for 64 components beyond 2**27, that is x beyond half a million).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch_rows, written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
ROWS_AT_ONCE = 4096


def kept(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the vectors that take part, as integers (saturated to 62 bits)."""
    x = F.col("embedding")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    scaled = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-2.0 ** 62)), F.lit(2.0 ** 62)))
    return embeddings.filter(x.isNotNull() & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda c: scaled(c).cast("long")).alias("v"))


def matrix(rows: pa.Array, width: int, parts: int) -> np.ndarray:
    """A list column as integers [row, part, place], padded with zeros and saturated."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((sizes.size, parts * width), np.int64)
    row = np.repeat(np.arange(sizes.size), sizes)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    # A difference has twice the limit; its squares over all components sum up below 2**62.
    limit = 1 << ((62 - (parts * width - 1).bit_length()) // 2 - 1)
    return np.clip(out, -limit, limit - 1).reshape(-1, parts, width)


class Codebook:
    """Entries of one part position with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        lists = np.argsort(gaps, axis=1, kind="stable")
        own = lists == np.arange(len(entries))[:, None]
        self.near = lists[~own].reshape(len(entries), -1)  # all others, by distance, then index
        self.gaps = np.take_along_axis(gaps, self.near, axis=1)
        self.by_first = np.argsort(entries[:, 0], kind="stable")
        self.firsts = entries[self.by_first, 0]

    def guess(self, x: np.ndarray) -> np.ndarray:
        """An entry whose first component is next to that of x."""
        at = np.searchsorted(self.firsts, x[:, 0])
        return self.by_first[np.minimum(at, len(self.entries) - 1)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance) of every row of x, and the number of distances
        that were computed."""
        best = self.guess(x)
        square = ((x - self.entries[best]) ** 2).sum(axis=1)
        seen = np.zeros((len(x), len(self.entries)), bool)
        seen[np.arange(len(x)), best] = True
        place, computed = np.zeros(len(x), np.int64), len(x)
        at = np.arange(len(x)) if self.near.shape[1] else np.empty(0, np.int64)
        while at.size:
            go = self.gaps[best[at], place[at]] <= 4 * square[at]
            at = at[go]
            entry = self.near[best[at], place[at]]
            place[at] += 1
            fresh = ~seen[at, entry]
            rows, entry = at[fresh], entry[fresh]
            seen[rows, entry] = True
            d = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
            computed += rows.size
            better = (d < square[rows]) | ((d == square[rows]) & (entry < best[rows]))
            rows, entry = rows[better], entry[better]
            best[rows], square[rows], place[rows] = entry, d[better], 0
            at = at[place[at] < self.near.shape[1]]  # the list is read to its end: all were visited
        return best, square, computed


@dataclass
class Coder:
    """The codebooks of all part positions: integers [part, entry, place]."""

    books: np.ndarray

    def __post_init__(self) -> None:
        self.searchers = [Codebook(b) for b in self.books]

    def assign(self, rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parts [row, part, place], entries [row, part], squares [row, part]) of a list column."""
        parts, _, width = self.books.shape
        x = matrix(rows, width, parts)
        found = [s.nearest(x[:, p]) for p, s in enumerate(self.searchers)]
        return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def refined(vectors: DataFrame, coder: Coder) -> Coder:
    """One round: every entry becomes the floored mean of its parts; unused entries stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(coder.books)
    parts, entries, width = coder.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            x, entry, _ = coder.assign(b.column("v"))
            cell = (entry + np.arange(parts) * entries).reshape(-1)
            np.add.at(sums, cell, x.reshape(-1, width))
            counts += np.bincount(cell, minlength=parts * entries)
        used = np.flatnonzero(counts)
        cell, place = np.repeat(used, width), np.tile(np.arange(width), used.size)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cell, place, sums[used].reshape(-1), counts[cell])],
                                         ["cell", "place", "total", "n"])

    cells = (vectors.select("v").mapInArrow(run, "cell long, place long, total long, n long").groupBy("cell", "place")
             .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
    books = coder.books.reshape(parts * entries, width).copy()
    for r in cells:  # PARTS x ENTRIES x width at most
        books[r["cell"], r["place"]] = r["total"] // r["n"]
    return Coder(books.reshape(parts, entries, width))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coder | None:
    """Codebooks learned from all rows of ``kept``; None without rows."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-longest // parts))
    start = matrix(pa.array([r["v"] for r in first], pa.list_(pa.int64())), width, parts)
    coder = Coder(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        coder = refined(vectors, coder)
    return coder


def encode(vectors: DataFrame, coder: Coder) -> DataFrame:
    """(vec_id, label, code, error) of every row: the entries' indices as two hex digits a part and
    the summed squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(coder.books)
    label = next(f for f in vectors.schema.fields if f.name == "label").dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            if b.num_rows:
                _, entry, square = coder.assign(b.column("v"))
                codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(square.sum(axis=1))],
                    ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def query(embeddings: DataFrame) -> DataFrame:
    """The contract's row of every kept vector."""
    spark, vectors = embeddings.sparkSession, kept(embeddings)
    with batch_rows(spark, ROWS_AT_ONCE):
        coder = train(vectors)
        if coder is None:
            return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        coded = written(encode(vectors, coder), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(coder.digest()).alias("codebooks_sha256"))


def _round_sql(books: str, assigned: str) -> str:
    """SQL of one assignment: every part's nearest entry of ``books``."""
    return f"""{assigned} AS (
  SELECT vec_id, part, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': entry}}) AS best
  FROM p JOIN {books} USING (part) GROUP BY vec_id, part)"""


def _mean_sql(books: str, assigned: str, means: str) -> str:
    """SQL of the entries after an assignment."""
    return f"""{means} AS (
  SELECT part, entry, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT part, best.e AS entry, i, sum(x[i]) AS total, count(*) AS n
      FROM p JOIN {assigned} USING (vec_id, part), range(1, (SELECT max(len(x)) + 1 FROM p)) AS r(i) GROUP BY ALL)
    GROUP BY part, entry) m USING (part, entry))"""


ORACLE_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (
  SELECT vec_id, j AS part, v[j * (len(v) // 16) + 1:(j + 1) * (len(v) // 16)] AS x FROM k, range(16) AS r(j)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{_round_sql("b0", "a1")},
{_mean_sql("b0", "a1", "b1")},
{_round_sql("b1", "a2")},
{_mean_sql("b1", "a2", "b2")},
{_round_sql("b2", "a3")},
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded JOIN k USING (vec_id)
"""
