"""Sinks (IO6, IO7, AL11): results go out as distributed writes, never through the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


# Spark's default text formats stop at milliseconds; these keep all six digits, and readers
# use the same ones.
CSV_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TEXT_TIMES = {"timestampFormat": CSV_TIMESTAMP, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """IO6 / AL11: write a result (predictions, FP/FN rows, alerts, importances).

    Parquet by default; CSV gets a header; JSON writes one object per line; both keep
    microseconds.  ``mode="overwrite"`` with no rows clears an earlier export (AL11 reset).
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**TEXT_TIMES).option("header", True).csv(path)
    elif fmt == "json":
        w.options(**TEXT_TIMES).json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(fmt)
    return path


def write_report(spark: SparkSession, report: dict, path: str) -> str:
    """IO7: a small report (metrics, statistics) as one JSON row, written by Spark."""
    payload = json.dumps(report, default=str, sort_keys=True)
    spark.createDataFrame([(payload,)], "report string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_report(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()
    return json.loads(rows[0][0]) if rows else {}
