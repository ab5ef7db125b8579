"""Union and feature alignment (UN1-UN3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.exprs import is_numeric, quote


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UN1: union by column name, columns missing in a frame become NULL.

    Boolean columns that meet integer columns of the same name are cast to int first
    (Spark refuses BOOLEAN with INT); column order is the order of first appearance.
    """
    if not frames:
        raise ValueError("nothing to union")
    kinds: dict[str, set] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(type(f.dataType))
    mixed_bool = {n for n, ks in kinds.items() if T.BooleanType in ks and len(ks) > 1}
    fixed = [df.select(*[F.col(quote(c)).cast("int").alias(c) if c in mixed_bool else F.col(quote(c))
                         for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fixed)


def union_zero_filled(frames: list[DataFrame], exclude: list[str] = ()) -> DataFrame:
    """UN2: UN1, then numeric NULLs (missing columns included) -> 0."""
    u = union_by_name(frames)
    ex = set(exclude)
    return u.select(*[F.coalesce(F.col(quote(f.name)), F.lit(0).cast(f.dataType)).alias(f.name)
                      if is_numeric(f.dataType) and f.name not in ex else F.col(quote(f.name))
                      for f in u.schema.fields])


def canonical_feature_order(n: int = 90) -> list[str]:
    """The 41 canonical KDD feature names, padded with feature_<i> up to ``n`` columns."""
    from flowlens.config import KDD_FEATURES

    names = list(KDD_FEATURES[:n])
    return names + [f"feature_{i}" for i in range(len(names), n)]


def align_features(df: DataFrame, feature_order: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """UN3: add missing features as 0, NULL -> 0, saved order, extra columns dropped.

    Without a saved order the canonical 90-column layout is used.
    """
    feature_order = feature_order or canonical_feature_order()
    present = set(df.columns)
    cols = [F.coalesce(F.col(quote(c)).cast("double"), F.lit(0.0)).alias(c) if c in present
            else F.lit(0.0).alias(c) for c in feature_order]
    return df.select(*[F.col(quote(k)) for k in keep if k in present], *cols)
