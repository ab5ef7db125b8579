"""Projections and row filters (PR1-PR8): schema decided on the driver, rows never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.exprs import finite_or_null, numeric_columns, quote


def select_features(df: DataFrame, cap: int | None = None, keep: list[str] = (),
                    exclude: list[str] = ()) -> DataFrame:
    """PR1 + PR2: first ``cap`` numeric columns (excluding label / id columns) plus ``keep``."""
    ex = set(exclude) | set(keep)
    feats = numeric_columns(df, ex)
    if cap is not None:
        feats = feats[:cap]
    return df.select(*[quote(c) for c in feats + [k for k in keep if k in df.columns]])


def feature_names(df: DataFrame, cap: int | None = None, exclude: list[str] = ()) -> list[str]:
    feats = numeric_columns(df, exclude)
    return feats[:cap] if cap is not None else feats


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """PR3: NULL -> 0 in numeric columns (strings untouched).  NaN counts as missing too."""
    cols = cols if cols is not None else numeric_columns(df)
    out = []
    wanted = set(cols)
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if f.name in wanted:
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                c = F.when(F.isnan(c), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
            else:
                c = F.coalesce(c, F.lit(0).cast(f.dataType))
            c = c.alias(f.name)
        out.append(c)
    return df.select(*out)


def nonfinite_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """PR4: +-inf (and NaN) -> NULL in floating columns."""
    frac = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    targets = set(cols if cols is not None else frac) & set(frac)
    return df.select(*[finite_or_null(quote(c)).alias(c) if c in targets else F.col(quote(c))
                       for c in df.columns])


def filter_label(df: DataFrame, label_col: str, value) -> DataFrame:
    """PR5: rows of one label (e.g. normal-only training rows)."""
    return df.where(F.col(label_col) == F.lit(value))


def packet_features(df: DataFrame, map_col: str, feature_order: list[str], keep: list[str] = ()) -> DataFrame:
    """PR6: loose key/value packet -> ordered double features.

    Missing key -> 0, text that does not parse as a number -> 0.0; padded numbers parse.
    """
    feats = [F.coalesce(F.expr(f"try_cast(element_at(`{map_col}`, '{name}') AS double)"), F.lit(0.0)).alias(name)
             for name in feature_order]
    return df.select(*[F.col(k) for k in keep], *feats)


def decoded_packet_fields(df: DataFrame, length_col: str = "length", protocol_col: str = "protocol",
                          tcp_col: str = "tcp", ip_col: str = "ip", absent: str = "zero") -> DataFrame:
    """PR7: fields of a decoded packet; tcp/ip parts may be absent (NULL struct).

    ``absent='zero'`` gives 0 for a missing part, ``absent='null'`` leaves it out (NULL).
    """
    def part(struct_col: str, field: str) -> Column:
        v = F.col(struct_col).getField(field).cast("int")
        return F.coalesce(v, F.lit(0)) if absent == "zero" else v

    return df.select(
        "*",
        F.col(length_col).cast("int").alias("packet_length"),
        F.coalesce(F.col(protocol_col).cast("int"), F.lit(0)).alias("protocol_no"),
        part(tcp_col, "flags").alias("tcp_flags"),
        part(tcp_col, "window_size").alias("window_size"),
        part(ip_col, "ttl").alias("ip_ttl"),
        part(ip_col, "tos").alias("ip_tos"),
    )


def select_saved(df: DataFrame, feature_order: list[str]) -> DataFrame:
    """PP8: keep the saved feature list in its saved order."""
    return df.select(*[quote(c) for c in feature_order])
