"""SimHash document fingerprints and permuted block tables (DataFrame functions only).

Fingerprint.  Terms are pairs of adjacent words (the word itself in a one-word text).  A
term's hash votes on 64 signed bits with the term's frequency as weight: +weight where the
hash has a one, -weight where it has a zero; positive totals become ones.  Votes are
counted 32 bits at a time: ``hash >> k & 0x0000000100000001`` holds the ones of two bits in
two 32-bit lanes, so 32 plain sums inside one generated aggregate count all 64 bits.
Words split at ASCII white space and keep their case; no words (null, empty): zero.

Likeness of two fingerprints: 1 - (differing bits) / 64.

Search.  ``near_pairs`` finds all pairs within ``radius`` bits: the 64 bits are cut into
``radius + 2`` blocks; in some pair of blocks two near fingerprints agree, so one table per
pair of blocks - the permutation that leads with these two - is joined on its leading bits
and candidates are verified.  It works on distinct fingerprints; pairs of equal
fingerprints are membership, not pairs.

Results.  Equal texts have equal fingerprints; repeated rows keep their rows; an empty
table gives no rows.  Lanes are exact up to 2^31 terms a text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions.exprs import binary_search_expr
from flowlens.llm.common import WORD, hex16, written

BITS = 64
LANES = (1 << 32) | 1
DOCS_PER_BUCKET = 512
MAX_BUCKETS = 20_000


def term_hashes(text: Column) -> Column:
    """XXH64-based hash of every adjacent word pair of a text."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    # (h1, h2), (h2, h3), ...; the last word pairs with nothing: a null, which no aggregate counts.
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                       lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.when(F.size(words) <= 1, words).otherwise(pairs)


def vote_sums(term: str) -> list[Column]:
    """Aggregates: the number of terms, and the ones of bits k and k + 32 in two lanes."""
    return [F.count(term).alias("__n"),
            *[F.sum(F.shiftright(term, k).bitwiseAND(F.lit(LANES))).alias(f"__v{k}") for k in range(32)]]


def majority() -> Column:
    """The fingerprint from ``vote_sums``: bits with a positive signed total."""
    out = F.lit(0).cast("long")
    for k in range(32):
        v = F.coalesce(F.col(f"__v{k}"), F.lit(0))
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
        out = out.bitwiseOR(F.when(2 * low > F.col("__n"), F.lit(1 << k)).otherwise(F.lit(0).cast("long")))
        bit = 1 << (k + 32) if k < 31 else -(1 << 63)
        out = out.bitwiseOR(F.when(2 * high > F.col("__n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fp: one row per distinct ``keys`` (which should identify a text)."""
    terms = rows.select(*keys, F.explode_outer(term_hashes(F.coalesce(F.col(text), F.lit("")))).alias("__term"))
    return terms.groupBy(*keys).agg(*vote_sums("__term")).select(*keys, majority().alias("fp"))


def likeness(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of ``radius + 2`` blocks of nearly equal width."""
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def near_pairs(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance) for all pairs a < b of distinct values of ``fp`` that differ in at
    most ``radius`` bits."""
    blocks = block_bounds(radius)
    bits = lambda first, width: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
    tables = [F.struct(F.lit(i).alias("table"), bits(*x).alias("lead"), bits(*y).alias("next"))
              for i, (x, y) in enumerate(combinations(blocks, 2))]
    rows = fps.select("fp").filter("fp IS NOT NULL").distinct().select(
        "fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.*")
    left, right = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return (left.join(right, ["table", "lead", "next"]).filter((F.col("a") < F.col("b")) & (distance <= radius))
            .select("a", "b", distance.alias("distance")).distinct())


def _bucket(ids: DataFrame, per_bucket: int) -> Column:
    """Number of the range that a row's ``__key`` falls in: bounds are approximate quantiles,
    at most ``MAX_BUCKETS``, found by halving, so ranges hold about ``per_bucket`` rows
    whatever the ids are."""
    n = ids.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // per_bucket)))
    if buckets == 1:
        return F.lit(0)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(ids.agg(F.percentile_approx("__key", shares, max(10_000, 4 * buckets)).alias("b")).first()["b"]))
    steps = len(cuts).bit_length()
    return binary_search_expr(F.lit(cuts + [(1 << 63) - 1] * ((1 << steps) - 1 - len(cuts))), F.col("__key"), steps)


def next_texts(docs: DataFrame, per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """(bucket, row, doc_id, text, next_text): every document with the text of the next by
    ascending doc_id (null first, equal ids by text), the first after the last.

    One shuffle by id range; windows work inside a range, and the first document of each
    range (one row per range) serves the last of the range before.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__key"))
    d = d.withColumn("bucket", _bucket(d.select("__key"), per_bucket))
    # The least id of each range: at most MAX_BUCKETS rows of two numbers, so it may be broadcast.
    least = d.groupBy("bucket").agg(F.min("__key").alias("__key")).select("__key")
    firsts = d.join(F.broadcast(least), "__key").groupBy("bucket").agg(F.min("text").alias("first"))
    around = W.orderBy("bucket")  # one row per range
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follow = firsts.select(F.col("bucket").alias("__b"), F.lit(True).alias("__last"),
                           F.coalesce(F.lead("first").over(around), F.first("first").over(whole)).alias("follow"))
    order = W.partitionBy("bucket").orderBy("__key", "text")
    rows = d.withColumn("row", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    # Texts are never null here, so a missing next text marks the last row of a range.
    joined = rows.join(follow, (F.col("bucket") == F.col("__b")) & (F.col("next_text").isNull() == F.col("__last")),
                       "left")
    return joined.select("bucket", "row", "doc_id", "text", F.coalesce("next_text", "follow").alias("next_text"))


def edited_documents(docs: DataFrame, per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """``next_texts`` with n_chars and edited: the last half of the code points (rounded
    down) replaced by the first as many, or all, of the next document."""
    rows = next_texts(docs, per_bucket).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    return rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))


def compare_with_edits(docs: DataFrame, per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp for every document."""
    rows = edited_documents(docs, per_bucket)
    keys = ["bucket", "row", "doc_id", "n_chars", "edited_sha256"]
    both = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        *keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                 F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("t"))
    # Grouping starts with the bucket, by which the rows lie already: no further shuffle.
    fps = fingerprints(both.select(*keys, "t.kind", "t.text"), [*keys, "kind"])
    fps = written(fps.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
                                         F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp")),
                  "edited-fingerprints")
    around = W.orderBy("bucket")  # one row per range
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follow = fps.filter("row = 1").select(
        F.col("bucket").alias("__b"), F.coalesce(F.lead("fp").over(around), F.first("fp").over(whole)).alias("__follow"))
    next_fp = F.lead("fp").over(W.partitionBy("bucket").orderBy("row"))
    return (fps.withColumn("__next", next_fp).join(follow, F.col("bucket") == F.col("__b"))
            .select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
                    F.coalesce("__next", "__follow").alias("next_fp")))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compare_with_edits(docs).select(
        "doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"),
        hex16("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"))
