"""Exact ranks and running sums over distinct values without a single-partition window.

Several operators need the cumulative distribution of a column: percentile rank (FE3), ROC
and PR running sums (EV5-EV8, DR6).  A global ``Window.orderBy`` would pull every row into one
task.  Instead:

1. aggregate to one row per distinct value (map-side partial aggregation; a value that
   holds a third of all rows becomes one row),
2. range-partition these rows by (key, value) and store them with the number of their
   partition: partitions are consecutive slices of the order, and there are as many as
   ``spark.sql.shuffle.partitions`` allows and the bytes ask for,
3. add up each slice (a table of partitions and keys) and prefix-sum the slices,
4. finish with a running sum inside each (key, partition).

The result is exact; no bound on the number of values or buckets is built in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import finite_or_null, quote
from flowlens.operators.common import stored
from flowlens.operators.selection import not_nan, quantile_table

SLICE = "__slice"


def sliced(agg: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``agg`` in order of (keys, value), stored once with the number of its range partition."""
    ranged = agg.repartitionByRange(*keys, value)
    return stored(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def cumulative_by_value(agg: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """Add ``<m>_below`` (sum of m over smaller values of the same key) and ``<m>_total``.

    ``agg`` must hold one row per (keys, value) with non-null values.
    """
    keys, rows = list(keys), sliced(agg, keys, value)
    # One row per slice and key; the prefix sums of a key are over its slices only.
    sums = rows.groupBy(*keys, SLICE).agg(*[F.sum(m).alias(f"__sum_{m}") for m in measures])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"__of_{k}") for k in keys], F.col(SLICE).alias("__of"),
        *[F.coalesce(F.sum(f"__sum_{m}").over(before), F.lit(0)).alias(f"__off_{m}") for m in measures],
        *[F.sum(f"__sum_{m}").over(whole).alias(f"{m}_total") for m in measures])
    same = F.col(SLICE) == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    local = Window.partitionBy(*keys, SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, same).select(
        *agg.columns,
        *[(F.col(f"__off_{m}") + F.coalesce(F.sum(m).over(local), F.lit(0))).alias(f"{m}_below") for m in measures],
        *[F.col(f"{m}_total") for m in measures])


def value_counts_long(df: DataFrame, cols: list[str], finite: bool = True) -> DataFrame:
    """(column, v, n): distinct values of each column with their counts, one shuffle.

    NULL and NaN are dropped; +-inf too unless ``finite=False`` (ranks keep infinities).
    """
    clean = finite_or_null if finite else not_nan
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), clean(quote(c)).alias("v")) for c in cols
    ])).alias("s")).select("s.column", "s.v").where(F.col("v").isNotNull())
    return long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))


def ranked_values(df: DataFrame, cols: list[str], finite: bool = True) -> DataFrame:
    """(column, v, n, n_below, n_total) for every distinct value of each column."""
    return cumulative_by_value(value_counts_long(df, cols, finite), ["column"], "v", ["n"])


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column, p, value): exact linear-interpolated quantiles of several columns at once, as a
    table of columns x probabilities; a column without finite values yields no rows."""
    table = quantile_table(df, cols, probs)
    rows = [(c, float(p), float(v)) for c in cols for p, v in table[c].items()]
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")
