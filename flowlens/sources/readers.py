"""Dataset readers (IO1-IO5): parquet / CSV by name, format dispatch, missing sources."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowlens.config import DatasetSpec
from flowlens.sources.sinks import CSV_TIMESTAMP, TEXT_TIMES

log = logging.getLogger(__name__)


class MissingSource(FileNotFoundError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def infer_csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Infer a CSV schema over all rows, once, to pin it for later reads (IO2)."""
    return (spark.read.option("header", True).option("inferSchema", True)
            .option("timestampFormat", CSV_TIMESTAMP).csv(path).schema)


def read_any(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """IO5: reader chosen by format or by file suffix; always the whole source.

    Parquet, CSV (header) and JSON are supported.  With a pinned ``schema`` a CSV or JSON
    value that does not parse fails the read instead of turning into NULL.
    """
    fmt = (fmt or ("csv" if path.lower().endswith(".csv") else
                   "json" if path.lower().endswith((".json", ".jsonl")) else "parquet")).lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.options(**TEXT_TIMES)
    if schema is not None:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    if fmt == "json":
        return reader.json(path)
    reader = reader.option("header", True)
    return (reader if schema is not None else reader.option("inferSchema", True)).csv(path)


def load_dataset(spark: SparkSession, spec: DatasetSpec, schema: T.StructType | None = None) -> DataFrame:
    """IO1/IO2: load one dataset by its descriptor."""
    return read_any(spark, spec.path, spec.format, schema)


def load_datasets(spark: SparkSession, specs: Mapping[str, DatasetSpec], on_missing: str = "skip") -> dict[str, DataFrame]:
    """IO4: load several datasets; a missing one is skipped (or raises), none left -> error."""
    out: dict[str, DataFrame] = {}
    for name, spec in specs.items():
        if not _exists(spark, spec.path):
            if on_missing == "error":
                raise MissingSource(spec.path)
            log.warning("skipping missing dataset %s at %s", name, spec.path)
            continue
        out[name] = load_dataset(spark, spec)
    if not out:
        raise MissingSource("no dataset could be loaded")
    return out
