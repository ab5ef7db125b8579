"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back.

    Several readers then share one computation (a checkpoint would run the last stage twice),
    and a lost executor costs a re-read.
    """
    from flowlens.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge single-row aggregates with different columns into one row, without a join.

    The rows are unioned by name (missing columns are NULL) and each column keeps its one
    non-null value: an aggregate over as many rows as there are frames.
    """
    from functools import reduce

    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in u.columns])
