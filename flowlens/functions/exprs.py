"""Column-expression helpers shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order (booleans are not numbers, decimals are)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ex]


def finite_or_null(c: str | Column) -> Column:
    """NaN and +-inf become NULL (pandas treats them as missing after the inf->NaN step)."""
    c = col(c)
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL on a zero denominator instead of raising (ANSI) or inf."""
    return F.try_divide(a, b)


def round6(c: Column) -> Column:
    return F.round(c, 6)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def round_binary(c: Column, digits: int = 6) -> Column:
    """round(x * 10^d) / 10^d on the binary value, the rule DuckDB's round() follows.

    Spark's own round(x, d) rounds the shortest decimal text of x, which differs on values
    such as 16.6421875 that are not exactly representable; rounding the scaled binary
    value gives bit-identical results in both engines.
    """
    scale = float(10 ** digits)
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(round_half_up(x * F.lit(scale)) / F.lit(scale))


def round_half_up(x: Column) -> Column:
    """round(x) of a double, halves away from zero, in plain arithmetic: Spark's own writes every
    value as decimal text and reads it back.  ``rint`` takes halves to the even side, and the
    difference to it is exact."""
    size = F.abs(x)
    near = F.rint(size)
    whole = near + F.when(size - near == 0.5, 1.0).otherwise(0.0)
    return F.when(x < 0, 0.0 - whole).otherwise(whole)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column; used for stable value hashes across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FRACTIONAL_TYPES):
            out.append(round_binary(F.col(quote(f.name)), digits).alias(f.name))
        else:
            out.append(F.col(quote(f.name)))
    return df.select(*out)


def binary_search_expr(bounds: Column, v: Column, steps: int) -> Column:
    """Index of the bucket of ``v`` in a sorted ``bounds`` array of length 2**steps - 1.

    Returns the number of bounds <= v (0 .. 2**steps - 1) with ``steps`` comparisons per
    row: an unrolled binary search written as ``aggregate`` over a short sequence, so a
    row never scans the whole array.
    """
    return F.aggregate(
        F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)),
        F.lit(0),
        lambda acc, s: acc + F.when(
            v >= F.element_at(bounds, acc + F.pow(F.lit(2), s).cast("int")), F.pow(F.lit(2), s).cast("int")
        ).otherwise(F.lit(0)),
    )
