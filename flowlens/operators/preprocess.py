"""Preprocessing fit / transform (PP1-PP8).

``Preprocessor.fit`` computes every statistic as a distributed aggregate and keeps the
result as a small, JSON-serialisable fit table (medians, modes, category lists,
means / population standard deviations).  ``transform`` is a single projection of
column expressions with the fitted values as literals, so it streams, stays inside
whole-stage codegen, and never joins.

Fitted from scratch:
* numeric medians: exact, linear interpolation (``operators.selection``), for *all*
  numeric columns so that train and serve see the same imputer;
* string modes: count per (column, value) then ``min_by(value, (-n, value))`` (ties to
  the smallest value), bounded memory per column;
* cardinality guard (>100 distinct -> drop) decided at fit from the same counts;
* ordinal codes: lexicographic order of the kept categories; unseen -> #categories;
* scaling: mean and population std of the imputed + encoded columns (second pass);
  zero std divides by 1.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.functions.exprs import finite_or_null, numeric_columns, quote, string_columns
from flowlens.operators.profile import long_strings
from flowlens.operators.ranking import cumulative_by_value
from flowlens.operators.selection import quantile_table
from flowlens.sources.sinks import read_report, write_report


def _string_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return (long_strings(df, cols).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def string_stats(df: DataFrame, cols: list[str], most: int | None = None) -> DataFrame:
    """PP2 + PP3 fit table: (column, n_distinct, mode) from one (column, value) count table;
    with ``most`` also ``values``, the first ``most`` + 1 values of each column in order.

    Mode = most frequent value, ties to the smallest (``min_by`` keeps bounded state).  The
    values are cut before they move (a group limit below the shuffle), so columns with any
    number of values cost as little as others.
    """
    counts = _string_counts(df, cols)
    stats = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.min_by("value", F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("mode"))
    if most is None:
        return stats
    first = counts.withColumn("__r", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    first = first.where(F.col("__r") <= most + 1).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))
    return stats.join(first, "column")


def category_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """PP4 fit table: (column, value, code) with codes in lexicographic order per column.

    A value's code is the number of smaller values of its column, a running sum over range
    partitions: any number of values per column.
    """
    pairs = long_strings(df, cols).where(F.col("value").isNotNull()).distinct().withColumn("__one", F.lit(1))
    return cumulative_by_value(pairs, ["column"], "value", ["__one"]).select(
        "column", "value", F.col("__one_below").cast("int").alias("code"))


class PreprocessorModel:
    def __init__(self, state: dict):
        self.state = state

    # -- persistence (IO8) --
    def to_json(self) -> str:
        return json.dumps(self.state, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "PreprocessorModel":
        return cls(json.loads(text))

    def save(self, spark: SparkSession, path: str) -> str:
        return write_report(spark, self.state, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PreprocessorModel":
        return cls(read_report(spark, path))

    @property
    def feature_order(self) -> list[str]:
        return list(self.state["feature_order"])

    # -- column expressions --
    def imputed(self, c: str) -> Column:
        s = self.state
        if c in s["medians"]:
            med = s["medians"][c]
            x = finite_or_null(quote(c))
            return F.coalesce(x, F.lit(med if med is not None else None).cast("double"))
        if c in s["modes"]:
            mode = s["modes"][c]
            return F.coalesce(F.col(quote(c)).cast("string"), F.lit(mode).cast("string"))
        return F.col(quote(c))

    def encoded(self, c: str) -> Column:
        cats = self.state["categories"][c]
        m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(i))])
        # PP5: unseen category -> index len(cats) (Spark's handleInvalid='keep').
        return F.coalesce(F.element_at(m, self.imputed(c)), F.lit(len(cats))).cast("double")

    def scaled(self, c: str, x: Column) -> Column:
        mean = self.state["means"].get(c)
        std = self.state["stds"].get(c)
        if mean is None:
            return x
        return (x - F.lit(mean)) / F.lit(std if std else 1.0)

    def transform(self, df: DataFrame, scale: bool = True) -> DataFrame:
        """PP7: impute -> encode -> scale; pass-through columns ride along untouched."""
        s = self.state
        keep = [c for c in s["passthrough"] if c in df.columns]
        out = []
        for c in s["feature_order"]:
            if c in s["categories"]:
                x = self.encoded(c)
            else:
                x = self.imputed(c).cast("double") if c in df.columns else F.lit(s["medians"].get(c)).cast("double")
            out.append((self.scaled(c, x) if scale else x).alias(c))
        return df.select(*[F.col(quote(k)) for k in keep], *out)


class Preprocessor:
    def __init__(self, passthrough: list[str] = ("unified_label", "source_dataset"),
                 high_cardinality: int = C.HIGH_CARDINALITY):
        self.passthrough = list(passthrough)
        self.high_cardinality = high_cardinality

    def fit(self, df: DataFrame) -> PreprocessorModel:
        nums = numeric_columns(df, self.passthrough)
        strs = string_columns(df, self.passthrough)
        # PP1: exact medians of the finite values of every numeric column.
        q = quantile_table(df, nums, [0.5])
        medians = {c: q[c].get(0.5) for c in nums}
        # PP2 / PP3 / PP4: one count table of (column, value) for all string columns.
        modes, categories, dropped, n_distinct = {}, {}, [], {}
        if strs:
            stats = {r["column"]: r for r in string_stats(df, strs, self.high_cardinality).collect()}
            for c in strs:
                n_distinct[c] = stats[c]["n_distinct"] if c in stats else 0
                if n_distinct[c] > self.high_cardinality:
                    dropped.append(c)
                    continue
                modes[c] = stats[c]["mode"] if c in stats else None
                categories[c] = sorted({*(stats[c]["values"] if c in stats else ()), *(["nan"] if modes[c] is None else [])})
        feature_order = [c for c in df.columns if c in set(nums) | set(categories)]
        state = {"medians": medians, "modes": {c: (m if m is not None else "nan") for c, m in modes.items()},
                 "categories": categories, "dropped": dropped, "n_distinct": n_distinct,
                 "passthrough": self.passthrough, "feature_order": feature_order, "means": {}, "stds": {}}
        model = PreprocessorModel(state)
        # PP6: mean / population std of the imputed and encoded values (second pass).
        unscaled = model.transform(df, scale=False)
        if feature_order:
            row = unscaled.agg(*[F.avg(quote(c)).alias(f"m_{i}") for i, c in enumerate(feature_order)],
                               *[F.stddev_pop(quote(c)).alias(f"s_{i}") for i, c in enumerate(feature_order)]).first()
            for i, c in enumerate(feature_order):
                state["means"][c] = row[f"m_{i}"]
                state["stds"][c] = row[f"s_{i}"]
        return model
