"""Profiling aggregations (AG1-AG7).  Every statistic is one distributed aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.exprs import quote


def distributions(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n, total) of several columns by grouping sets: one scan, one shuffle.

    The empty grouping set gives the total, which reaches the other rows as a scalar
    subquery over the same exchange, so no task ever sees all values of a column.
    """
    sets = df.groupingSets([[F.col(quote(c))] for c in cols] + [[]], *[F.col(quote(c)) for c in cols])
    found = sets.agg(F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__set"))
    none = 2 ** len(cols) - 1  # all columns rolled up
    total = found.where(F.col("__set") == none).select(F.col("__n")).scalar()
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        own = F.col("__set") == none - 2 ** (len(cols) - 1 - i)
        which, value = F.when(own, c).otherwise(which), F.when(own, F.col(quote(c)).cast("string")).otherwise(value)
    return found.where(F.col("__set") != none).select(
        which.alias("column"), value.alias("value"), F.col("__n").alias("n"), total.alias("total"))


def distribution(df: DataFrame, col: str, count_name: str = "n", pct_name: str = "pct") -> DataFrame:
    """AG1 / AG2: count and percentage per value; the total is the empty grouping set's."""
    found = df.groupingSets([[F.col(quote(col))], []], F.col(quote(col))).agg(
        F.count(F.lit(1)).alias(count_name), F.grouping_id().alias("__set"))
    total = found.where(F.col("__set") == 1).select(F.col(count_name)).scalar()
    return found.where(F.col("__set") == 0).select(col, count_name, (F.col(count_name) * 100.0 / total).alias(pct_name))


def value_counts_desc(df: DataFrame, col: str) -> DataFrame:
    """AG3 / AG7: counts per value, largest first (ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))


def long_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) for several columns at once, values as text (NULL kept)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(quote(c)).cast("string").alias("value")) for c in cols
    ])).alias("s")).select("s.column", "s.value")


def top_values(df: DataFrame, cols: list[str], k: int = 5, salt: int = 1024) -> DataFrame:
    """AG4: the k most frequent values of each column (value_counts().head(k); ties by value).

    One shuffle counts all columns.  The top-k then runs in two stages so that a column
    with billions of distinct values is never ranked in one task: first per (column, salt
    bucket of the value), keeping k candidates each, then per column over at most
    salt x k candidates.
    """
    counts = long_strings(df, cols).where(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("value")]
    salted = counts.withColumn("__s", F.pmod(F.xxhash64("value"), F.lit(salt)))
    local = salted.withColumn("__r", F.row_number().over(Window.partitionBy("column", "__s").orderBy(*order)))
    cand = local.where(F.col("__r") <= k).drop("__r", "__s")
    w = Window.partitionBy("column").orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_candidates(df: DataFrame, fragments: tuple[str, ...] = ("label", "attack", "class")) -> list[str]:
    """AG4: columns whose name suggests a label."""
    return [c for c in df.columns if any(f in c.lower() for f in fragments)]


def shape_and_types(df: DataFrame) -> dict:
    """AG4: row count (one count job) and column counts per data type (schema only)."""
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    return {"rows": df.count(), "columns": len(df.columns), "dtypes": kinds}


def missing_counts(df: DataFrame, cols: list[str] | None = None, inf_is_missing: bool = True) -> DataFrame:
    """AG5: (column, n_missing) for every column, one aggregate; NaN (and +-inf) count as missing."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for c in cols:
        x = F.col(quote(c))
        miss = x.isNull()
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            miss = miss | F.isnan(x)
            if inf_is_missing:
                miss = miss | (F.abs(x) == F.lit(float("inf")))
        exprs.append(F.sum(miss.cast("int")).cast("bigint").alias(c))
    row = df.agg(*exprs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(quote(c)).alias("n_missing")) for c in cols
    ])).alias("s")).select("s.column", "s.n_missing")


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """AG6: (column, n_distinct) ignoring NULL.  Exact: one shuffle of (column, value) pairs;
    ``approx=True`` uses HyperLogLog++ (no shuffle of values)."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(quote(c)).alias(c) for c in cols])
        return row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(quote(c)).cast("bigint").alias("n_distinct")) for c in cols
        ])).alias("s")).select("s.column", "s.n_distinct")
    pairs = long_strings(df, cols).where(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
