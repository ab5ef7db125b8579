"""Live baselines (DR7): mergeable moments per key, kept as a versioned table.

A run's rows become (key, n, mean, m2); two such tables merge by the pairwise update of Chan,
Golub and LeVeque, so a baseline grows run by run without reading old rows again, and equals a
recomputation over all of them.  Streams read the newest version in every micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.exprs import safe_div
from flowlens.operators.rules import whitelist_filter
from flowlens.sources.versioned import VersionedTable


def baseline_schema(key: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(key.name, key.dataType), T.StructField("n", T.LongType()),
                         T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())])


def moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, m2) over the non-null values of every key."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull()).groupBy(key).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merge_moments(parts: DataFrame, key: str) -> DataFrame:
    """One row per key from any number of partial rows (one per run, so a key's list is short)."""

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        delta = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"),
                        (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"))

    rows = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    merged = parts.where("n > 0").groupBy(key).agg(F.aggregate(rows, zero, add).alias("m"))
    return merged.select(key, "m.n", "m.mean", "m.m2")


def update_baseline(table: VersionedTable, df: DataFrame, key: str, value: str) -> int:
    """Merge the moments of ``df`` into the newest version and commit the result."""
    known = table.versions()
    since = known[-1] if known else 0
    parts = table.read(since or None).unionByName(moments(df, key, value)) if since else moments(df, key, value)
    return table.replace(merge_moments(parts, key), since=since)


def deviation(df: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """Every row with the mean and sample deviation of its key and its own distance in deviations."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    base = baseline.select(key, F.col("mean").alias("base_mean"), std.alias("base_std"))
    return df.join(base, key, "left").withColumn(
        "deviation", safe_div(F.col(value) - F.col("base_mean"), F.col("base_std")))


def live_deviation(table: VersionedTable, key: str, value: str, write: Callable[[DataFrame, int], None],
                   whitelist: VersionedTable | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch against the baseline and the whitelist as they
    are when it runs; ``write`` gets the rows (DR4, DR7 on streams)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch if whitelist is None else whitelist_filter(batch, whitelist.read(), key)
        write(deviation(rows, table.read(), key, value), batch_id)

    return run
