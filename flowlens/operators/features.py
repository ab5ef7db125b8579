"""Feature engineering (FE1-FE16).

``FeatureEngineer.fit(df)`` computes every data-dependent statistic in a few distributed
aggregates (means / sample stds, exact quartiles and quintile edges, entropies) and
returns a ``FeatureModel`` whose ``transform`` is a projection with those statistics as
literals.  Fitting on the training frame and applying to test or stream rows is the
default; ``create_advanced_features(df)`` fits and applies on the same frame, as the
batch helper does.

The one statistic that is per row and data dependent, the percentile rank (FE3), is
computed on the frame it is applied to: exact average-tie ranks over distinct values
(``operators.ranking``), joined back on the value.

Order of the families: statistical, time, connection, traffic pattern, entropy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import config as C
from flowlens.functions.exprs import numeric_columns, quote, safe_div, string_columns
from flowlens.operators.common import stored
from flowlens.operators.ranking import ranked_values
from flowlens.operators.selection import quantile_table
from flowlens.sources.sinks import read_report, write_report

QUINTILE_PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def _num(c: str, types: dict) -> Column:
    """A column as a number; timestamps as epoch seconds."""
    if isinstance(types.get(c), (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return (F.unix_micros(F.col(quote(c)).cast("timestamp")) / 1e6)
    return F.col(quote(c)).cast("double")


def bin_by_edges(x: Column, edges: list[float]) -> Column:
    """FE5 / FE13: bin index = number of inner edges strictly below x; NULL x -> NULL."""
    inner = edges[1:-1]
    if not inner:
        return F.when(x.isNotNull(), F.lit(0))
    idx = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    return F.when(x.isNotNull(), idx)


class FeatureModel:
    """Fitted statistics; ``save`` and ``load`` carry them to another process or a stream."""

    def __init__(self, state: dict):
        self.state = state

    def save(self, spark: SparkSession, path: str) -> str:
        return write_report(spark, self.state, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureModel":
        return cls(read_report(spark, path))

    def transform(self, df: DataFrame, with_percentile: bool = True) -> DataFrame:
        """Apply the fitted features; the percentile ranks (FE3) are those of ``df`` itself."""
        s = self.state
        types = {f.name: f.dataType for f in df.schema.fields}
        cols = [F.col(quote(c)) for c in df.columns]
        # FE1 / FE2: statistical features of the first numeric columns.
        for c in s["stat_columns"]:
            st = s["stats"][c]
            x = F.col(quote(c)).cast("double")
            cols.append(safe_div(x - F.lit(st["mean"]), F.lit(st["std"])).alias(f"{c}_zscore"))
            iqr = None if st["q75"] is None or st["q25"] is None else st["q75"] - st["q25"]
            cols.append(safe_div(x - F.lit(st["median"]), F.lit(iqr)).alias(f"{c}_robust_scaled"))
        # FE4 / FE5: time features.
        for c in s["time_columns"]:
            x = _num(c, types)
            cols.append(F.log1p(F.abs(x)).alias(f"{c}_log"))
            edges = s["quintile_edges"].get(c)
            cols.append((bin_by_edges(x, edges) if edges and len(edges) > 1 else F.lit(None).cast("int"))
                        .alias(f"{c}_binned"))
        present = set(df.columns)
        # FE6
        if {"duration", "src_bytes"} <= present:
            cols.append(safe_div(F.col("src_bytes"), F.col("duration") + 1).alias("bytes_per_seconds"))
        # FE7 / FE8: connection counts.
        for c in [c for c in C.COUNT_COLUMNS if c in present]:
            cols.append(F.log1p(F.col(quote(c)).cast("double")).alias(f"{c}_log"))
            if "duration" in present:
                cols.append(safe_div(F.col(quote(c)), F.col("duration") + 1).alias(f"{c}_rate"))
        # FE9
        if set(C.ERROR_RATE_PAIR) <= present:
            a, b = C.ERROR_RATE_PAIR
            cols.append(((F.col(a) + F.col(b)) / 2).alias("total_error_rate"))
        # FE10
        if {"src_bytes", "dst_bytes"} <= present:
            cols.append(safe_div(F.col("src_bytes"), F.col("dst_bytes") + 1).alias("bytes_ratio"))
            cols.append((F.col("src_bytes") + F.col("dst_bytes")).alias("total_bytes"))
            cols.append(F.abs(F.col("src_bytes") - F.col("dst_bytes")).alias("bytes_diff"))
        # FE11: row mean of the available service rates, skipping NULLs.
        svc = [c for c in C.SERVICE_RATE_COLUMNS if c in present]
        if svc:
            total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in svc), F.lit(0.0))
            n = sum((F.col(c).isNotNull().cast("int") for c in svc), F.lit(0))
            cols.append(safe_div(total, n).alias("service_concentration"))
        # FE12 / FE13: constant entropy columns.
        for name, value in sorted(s["entropies"].items()):
            cols.append(F.lit(value).cast("double").alias(name))
        if with_percentile and s["stat_columns"]:
            # Looked up before the features are made: the joins carry the columns of ``df`` only.
            suffix = s.get("percentile_suffix", "_percentile")
            df = percentile_ranks(df, s["stat_columns"], suffix, key=s.get("key"))
            cols += [F.col(quote(f"{c}{suffix}")) for c in s["stat_columns"]]
        return df.select(*cols)


RANK_ROW_BYTES = 64  # of a hashed (value, rank) pair, generously


def percentile_ranks(df: DataFrame, cols: list[str], suffix: str = "_percentile", key: str | None = None) -> DataFrame:
    """FE3: rank(pct=True) with average ties over non-null values, one column per input.

    One pass ranks the distinct values of all columns.  A column whose rank table stays below
    ``spark.sql.autoBroadcastJoinThreshold`` (its rows are counted) is looked up by a broadcast
    join; all others share, with ``key`` (a unique row key), one join on (column, value) and
    one regroup by key; without a key each is a join of its own that Spark plans by size.
    """
    ranked = ranked_values(df, cols, finite=False).select(
        "column", "v", ((F.col("n_below") + (F.col("n") + 1) / 2.0) / F.col("n_total")).alias("pct"))
    ranked = stored(ranked, "percentiles")
    sizes = {r["column"]: r["n"] for r in ranked.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    small = [c for c in cols if sizes.get(c, 0) * RANK_ROW_BYTES <= limit]
    large = [c for c in cols if c not in small]

    def value(c: str) -> Column:
        x = F.col(quote(c)).cast("double")
        return F.when(F.isnan(x), None).otherwise(x)

    out = df
    for i, c in enumerate(small if key is not None else cols):
        table = ranked.where(F.col("column") == c).select(F.col("v").alias(f"__v{i}"), F.col("pct").alias(f"{c}{suffix}"))
        table = F.broadcast(table) if c in small else table
        out = out.join(table, value(c) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    if key is not None and large:
        long = df.select(F.col(quote(key)).alias("__key"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in large])).alias("__e")).select(
            "__key", "__e.column", "__e.v")
        hit = long.join(ranked, ["column", "v"])
        wide = hit.groupBy("__key").agg(*[F.max(F.when(F.col("column") == c, F.col("pct"))).alias(f"{c}{suffix}")
                                          for c in large])
        out = out.join(wide, F.col(quote(key)) == F.col("__key"), "left").drop("__key")
    return out.select(*[F.col(quote(c)) for c in df.columns], *[F.col(quote(f"{c}{suffix}")) for c in cols])


FAMILIES = ("statistical", "time", "flow", "entropy")


class FeatureEngineer:
    """Fits the families asked for and nothing else: flow features need no pass at all.

    ``stat_columns``, ``entropy_strings`` and ``entropy_bytes`` list the columns of a family;
    by default all that qualify.  The result's columns never depend on the number of rows.
    """

    def __init__(self, exclude: list[str] = ("unified_label",), stat_columns: list[str] | None = None,
                 misspelt_suffix: bool = False, key: str | None = None, families: tuple[str, ...] = FAMILIES,
                 entropy_strings: list[str] | None = None, entropy_bytes: list[str] | None = None):
        self.key = key
        self.exclude = list(exclude)
        self.stat_columns = stat_columns
        self.families = families
        self.entropy_strings, self.entropy_bytes = entropy_strings, entropy_bytes
        self.suffix = "_percetile" if misspelt_suffix else "_percentile"

    def fit(self, df: DataFrame) -> FeatureModel:
        types = {f.name: f.dataType for f in df.schema.fields}
        stat_cols = self.stat_columns if self.stat_columns is not None else numeric_columns(df, self.exclude)
        stat_cols = list(stat_cols) if "statistical" in self.families else []
        time_cols = [c for c in C.TIME_COLUMNS if c in df.columns] if "time" in self.families else []
        stats = {}
        # The quartiles of the statistical columns and the quintile edges of the time columns
        # (timestamps as epoch seconds) share their scans.
        qcols = list(dict.fromkeys(stat_cols + time_cols))
        qdf = df.select(*[_num(c, types).alias(c) for c in qcols])
        quartiles = [0.25, 0.5, 0.75]
        q = quantile_table(qdf, qcols, {c: quartiles * (c in stat_cols) + QUINTILE_PROBS * (c in time_cols) for c in qcols},
                           finite=False)
        if stat_cols:
            row = df.agg(*[F.avg(quote(c)).alias(f"m{i}") for i, c in enumerate(stat_cols)],
                         *[F.stddev_samp(quote(c)).alias(f"s{i}") for i, c in enumerate(stat_cols)]).first()
            for i, c in enumerate(stat_cols):
                stats[c] = {"mean": row[f"m{i}"], "std": row[f"s{i}"], "median": q[c].get(0.5),
                            "q25": q[c].get(0.25), "q75": q[c].get(0.75)}
        edges = {}
        for c in time_cols:
            vals = [q[c].get(p) for p in QUINTILE_PROBS]
            edges[c] = sorted({v for v in vals if v is not None})
        entropies = self._entropies(df) if "entropy" in self.families else {}
        return FeatureModel({"stat_columns": stat_cols, "stats": stats, "time_columns": time_cols,
                             "quintile_edges": edges, "entropies": entropies, "percentile_suffix": self.suffix,
                             "key": self.key})

    def _entropies(self, df: DataFrame) -> dict:
        """FE12 + FE13 in two passes: one for min / max / distinct counts, one for all entropies."""
        out = {}
        strs = string_columns(df, self.exclude)
        byte_cols = [c for c in df.columns if "byte" in c.lower() and c in numeric_columns(df)]
        if not strs and not byte_cols:
            return out
        strs = self.entropy_strings if self.entropy_strings is not None else strs
        byte_cols = self.entropy_bytes if self.entropy_bytes is not None else byte_cols
        # Pass 1: whether a column varies (least and greatest value differ, or it has a null
        # beside a value), non-null counts and byte ranges: plain partial aggregates.
        aggregates = []
        for tag, cols in (("s", strs), ("b", byte_cols)):
            for i, c in enumerate(cols):
                x = F.col(quote(c))
                aggregates += [F.min(x).alias(f"{tag}lo{i}"), F.max(x).alias(f"{tag}hi{i}"), F.count(x).alias(f"{tag}n{i}"),
                               F.max(x.isNull()).alias(f"{tag}null{i}")]
        first = df.agg(*aggregates).first()
        varies = lambda tag, i: first[f"{tag}n{i}"] > 0 and first[f"{tag}lo{i}"] != first[f"{tag}hi{i}"]
        picked = [c for i, c in enumerate(strs) if varies("s", i) or (first[f"sn{i}"] > 0 and first[f"snull{i}"])]
        chosen = [(i, c) for i, c in enumerate(byte_cols) if varies("b", i)]
        items = [F.struct(F.lit(f"{c}_entropy").alias("k"), F.col(quote(c)).cast("string").alias("v")) for c in picked]
        totals = {f"{c}_entropy": first[f"sn{strs.index(c)}"] for c in picked}
        totals.update({f"{c}_entropy": first[f"bn{i}"] for i, c in chosen})
        for i, c in chosen:
            lo, hi = float(first[f"blo{i}"]), float(first[f"bhi{i}"])
            inner = [lo + k * (hi - lo) / C.ENTROPY_BINS for k in range(1, C.ENTROPY_BINS)]
            b = bin_by_edges(F.col(quote(c)).cast("double"), [lo] + inner + [hi])
            items.append(F.struct(F.lit(f"{c}_entropy").alias("k"), b.cast("string").alias("v")))
        if not items:
            return out
        # Pass 2: counts per (feature, value) for every feature at once, then a plain aggregate
        # per feature with the non-null totals of pass 1 as literals (no window over values).
        counts = (df.select(F.explode(F.array(*items)).alias("e")).select("e.k", "e.v")
                  .where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
        total = F.element_at(F.create_map(*[x for k, t in totals.items() for x in (F.lit(k), F.lit(t))]), F.col("k"))
        p = F.col("n") / total
        ent = counts.select("k", p.alias("p")).groupBy("k").agg(
            (-F.sum(F.col("p") * F.log2(F.col("p") + F.lit(C.ENTROPY_EPS)))).alias("entropy"))
        values = {r["k"]: r["entropy"] for r in ent.collect()}
        for name in [f"{c}_entropy" for c in picked] + [f"{c}_entropy" for _, c in chosen]:
            out[name] = values.get(name)
        return out


def create_advanced_features(df: DataFrame, exclude: list[str] = ("unified_label",),
                             key: str | None = None, **options) -> DataFrame:
    """All families, statistics fitted on the same frame (the batch helper's behaviour)."""
    return FeatureEngineer(exclude, key=key, **options).fit(df).transform(df)


def one_hot(df: DataFrame, cols: list[str], categories: dict[str, list[str]] | None = None,
            keep: bool = True) -> DataFrame:
    """FE14: one 0/1 column ``<c>_<value>`` per category (pd.get_dummies shape).

    Categories come from the fit (a bounded distinct list per column); unseen values
    get all zeros.
    """
    if categories is None:
        categories = {}
        for c in cols:
            vals = df.select(F.col(quote(c)).cast("string")).where(F.col(quote(c)).isNotNull()).distinct()
            n = vals.limit(C.HIGH_CARDINALITY + 1).count()
            if n > C.HIGH_CARDINALITY:
                raise ValueError(f"{c}: more than {C.HIGH_CARDINALITY} categories")
            categories[c] = sorted(r[0] for r in vals.collect())
    out = [F.col(quote(c)) for c in df.columns if keep or c not in cols]
    for c in cols:
        for v in categories[c]:
            out.append(F.coalesce((F.col(quote(c)).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*out)


def pca_features(df: DataFrame, input_cols: list[str], k: int = C.PCA_COMPONENTS, keep: list[str] = ()):
    """FE15: centred (not scaled) PCA with k = min(k, #features).

    Returns (frame with pca_1..pca_k, explained variance ratios).  Spark's PCA does not
    centre the projection, so the input is centred first; each component's sign is fixed
    so that its largest-magnitude loading is positive.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = min(k, len(input_cols))
    va = VectorAssembler(inputCols=input_cols, outputCol="__x", handleInvalid="keep")
    assembled = va.transform(df.na.fill(0.0, subset=input_cols))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__x", outputCol="__xc").fit(assembled)
    xc = centred.transform(assembled)
    model = PCA(k=k, inputCol="__xc", outputCol="__pc").fit(xc)
    xc = model.transform(xc)
    pc = model.pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    arr = vector_to_array(F.col("__pc"))
    out = xc.select(*[F.col(quote(c)) for c in keep],
                    *[(arr[j] * F.lit(signs[j])).alias(f"pca_{j + 1}") for j in range(k)])
    return out, [float(v) for v in model.explainedVariance.toArray()]


def explained_variance_summary(ratios: list[float]) -> dict:
    return {"total": float(sum(ratios)), "top10": float(sum(ratios[:10])),
            "components": len(ratios), "finite": all(math.isfinite(r) for r in ratios)}
