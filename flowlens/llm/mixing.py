"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Targets.  A document's size is its number of words (null text: 0).  Sources, ordered by
code point with null last, weigh ``weights`` in turn and share all words by weight; a source
stops at ``max_copies`` times its size and what it cannot use is shared again by weight
until none is above.  That fixed point is min(cap, weight x level) for one common level,
which running sums over the sources ordered by cap / weight give directly.

Sampling.  Each document of a source is due target / size copies: the whole part is
certain, the fraction p is its inclusion probability.  Pareto sampling ranks a source's
documents by [U / (1 - U)] / [p / (1 - p)] with U a hash of the document and takes them in
that order up to the fixed size, which is counted in words as the targets are: the sample
stops where the words taken come nearest to what the whole copies leave open.

Scale.  Within a source the rank grows with U, so U's leading 16 bits cut each source into
65,536 ordered buckets.  One partial aggregate over (source, bucket) gives sizes, targets
and the bucket in which a source's sample ends (found 256 steps at a time); only rows of
those few buckets are ordered by a window.  Documents meet the one-row-per-source table by a join; no source, however
hot, is gathered anywhere.

Results.  No source's words, or none open: whole copies only (0 of 0-word sources).
Repeated rows are documents of their own (ties in U are broken by doc_id and size, and rows
equal in all three are interchangeable).  An empty table gives no rows.  Input columns that
clash with the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import WORD, written

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-0"
BUCKET_BITS = 16
RESULT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """52 bits of md5(seed:doc_id:md5 of the text) as an integer: U is this plus a half, over 2^52.

    The text counts, so rows without an id, or with the same one, spread over all buckets.
    """
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))]
    key = F.concat_ws(":", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (source, source_size), one row per source, with target (in words)."""
    # One row per source: these windows never see documents.
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumn("__w", w).withColumn("__cap", max_copies * F.col("source_size").cast("double"))
    by_cap = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    # The level if exactly the sources before this one were at their caps; it grows as long
    # as the next source is above its own, so the common level is the largest.
    level = (total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest)
    df = df.withColumn("__level", level)
    df = df.withColumn("__common", F.max("__level").over(everything))
    target = F.least(F.col("__cap"), F.col("__common") * F.col("__w"))
    return df.withColumn("target", target).drop("__w", "__cap", "__level", "__common")


def _first_above(steps: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, __open, __last, __before): each source's first step (of at most 256) at which
    __start plus the running total passes __open, and that total before it."""
    so_far = W.partitionBy("source").orderBy("__step").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.col("__start") + F.sum("__cell").over(so_far)
    rows = steps.join(limits, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__upto", total)
    end = F.min_by(F.struct("__step", (F.col("__upto") - F.col("__cell")).alias("before")), "__step")
    return (rows.filter(F.col("__upto") > F.col("__open")).groupBy("source", "__open").agg(end.alias("__end"))
            .select("source", "__open", F.col("__end.__step").alias("__last"), F.col("__end.before").alias("__before")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES,
        seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target (of its source), copies and taken."""
    rows = docs.select(
        *[F.col(c) for c in docs.columns if c not in RESULT],
        word_count("text").alias("size"),
        uniform(seed=seed).alias("__u"),
    ).withColumn("__bucket", F.shiftright("__u", 52 - BUCKET_BITS).cast("int"))
    cells = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__cell"))
    sizes = cells.groupBy("source").agg(F.sum("__cell").alias("source_size"))
    plan = targets(sizes, weights, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (plan.withColumn("__whole", F.least(F.floor(rate), F.lit(max_copies)).cast("int"))
            .withColumn("__p", rate - F.col("__whole"))
            .withColumn("__open", F.col("target") - F.col("__whole") * F.col("source_size")))
    # The bucket in which each source's sample ends, and the words taken before it: first
    # among 256 stretches of buckets, then among the 256 buckets of that stretch.
    limits = plan.select(F.col("source").alias("__s"), "__open", F.lit(0).cast("long").alias("__start"))
    stretch = F.shiftright("__bucket", BUCKET_BITS // 2)
    stretches = cells.groupBy("source", stretch.alias("__step")).agg(F.sum("__cell").alias("__cell"))
    coarse = _first_above(stretches, limits)
    inside = cells.join(coarse.select(F.col("source").alias("__t"), F.col("__last").alias("__stretch")),
                        F.col("source").eqNullSafe(F.col("__t")) & (stretch == F.col("__stretch")))
    fine = _first_above(inside.select("source", F.col("__bucket").alias("__step"), "__cell"),
                        coarse.select(F.col("source").alias("__s"), "__open", F.col("__before").alias("__start")))
    plan = (plan.join(fine.select(F.col("source").alias("__s"), "__last", "__before"),
                      F.col("source").eqNullSafe(F.col("__s")), "left")
            .select(F.col("source").alias("__s"), "source_size", "target", "__whole", "__p", "__open",
                    F.coalesce("__last", F.lit(1 << BUCKET_BITS)).alias("__last"), "__before"))
    # One row per source, stored: its size is then known, so Spark broadcasts it while it is
    # below the session's threshold and documents are not shuffled by source.
    plan = written(plan.coalesce(1), "mix-plan")
    due = rows.join(plan, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # Pareto rank: random odds over inclusion odds.
    u = (F.col("__u") + 0.5) / float(1 << 52)
    odds = F.col("__p") / (1 - F.col("__p"))
    due = due.withColumn("__rank", F.when(F.col("__p") > 0, (u / (1 - u)) / odds))
    settled = due.filter(F.col("__bucket") != F.col("__last")).withColumn(
        "__extra", F.when((F.col("__p") > 0) & (F.col("__bucket") < F.col("__last")), 1).otherwise(0))
    in_order = W.partitionBy("source").orderBy("__rank", "__u", "doc_id", "size")
    upto = F.col("__before") + F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    # Taken while that brings the words nearer to the open size; nothing after the first miss.
    nearer = 2 * (F.col("__open") - F.col("__upto")) + F.col("size") > 0
    edge = (due.filter(F.col("__bucket") == F.col("__last")).withColumn("__upto", upto)
            .withColumn("__extra", F.when((F.col("__p") > 0) & nearer, 1).otherwise(0)).drop("__upto"))
    out = settled.unionByName(edge).withColumn("copies", (F.col("__whole") + F.col("__extra")).cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[c for c in docs.columns if c not in RESULT], *RESULT)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was taken, with its own columns."""
    plain = docs.select([F.col(c) for c in docs.columns])
    out = mix(plain.select(*[F.col(c).alias(f"__in_{c}") for c in plain.columns],
                           *[F.col(c) for c in ("doc_id", "text", "source")]), **options)
    out = out.withColumn("__copy", F.explode(F.expr("array_repeat(1, copies)")))
    return out.select(*[F.col(f"__in_{c}").alias(c) for c in plain.columns])


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies)."""
    return mix(docs.select("doc_id", "text", "source")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))[1:13])::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1.0::DOUBLE AS w,
             3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source IS NULL, source
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS open,
             sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
n AS (SELECT *, CAST(whole + CASE WHEN source_size > 0 AND target / source_size > whole AND 2 * (open - upto) + size > 0
                                  THEN 1 ELSE 0 END AS INTEGER) AS copies FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size,
       CAST(target AS DOUBLE) AS target, CAST(copies * size AS BIGINT) AS taken, copies FROM n
"""
