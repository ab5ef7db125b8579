"""Readers: format dispatch, missing sources, CSV schema inference pinned for the real read."""

import pytest
from pyspark.sql import functions as F

from flowlens.config import DatasetSpec
from flowlens.session import scratch_path
from flowlens.sources import readers, tables

from paths import SF_SMALL


def test_missing_sources_and_csv_inference(spark):
    path = tables.table_path(SF_SMALL, "lineitem")
    assert readers.read_any(spark, path).count() == spark.read.parquet(path).count()
    specs = {"ok": DatasetSpec("ok", tables.table_path(SF_SMALL, "events"), "event_type", "view"),
             "gone": DatasetSpec("gone", tables.table_path(SF_SMALL, "nope"), "x", "y")}
    assert list(readers.load_datasets(spark, specs, on_missing="skip")) == ["ok"]
    with pytest.raises(readers.MissingSource):
        readers.load_datasets(spark, specs, on_missing="error")
    with pytest.raises(readers.MissingSource):
        readers.load_datasets(spark, {"gone": specs["gone"]})
    csv = scratch_path(spark, "cic-csv")
    tables.flows_cic(spark, SF_SMALL).write.option("header", True).csv(csv)
    schema = readers.infer_csv_schema(spark, csv)
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    assert types["flow_duration"] == "double" and types["Label"] == "string"
    df = readers.read_any(spark, csv, fmt="csv", schema=schema)   # folder without suffix: name the format
    assert df.count() == 1500 and df.where(F.col("Label") == "BENIGN").count() > 0


def test_csv_inference_sees_every_row_and_bad_values_fail(spark):
    path = scratch_path(spark, "late-text")
    rows = [(str(i),) for i in range(2000)] + [("late text",)]
    spark.createDataFrame(rows, "v string").coalesce(1).write.option("header", True).csv(path)
    assert readers.infer_csv_schema(spark, path).simpleString() == "struct<v:string>"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.read_any(spark, path, "csv", "v int").collect()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_exports_keep_microseconds(spark, fmt):
    from flowlens.sources.sinks import write_table

    df = spark.sql("SELECT 1 AS id, timestamp_ntz'2024-01-01 00:00:00.123456' AS a, timestamp'2024-01-01 05:00:00.000001' AS b")
    path = scratch_path(spark, "times")
    write_table(df, path, fmt=fmt)
    assert readers.read_any(spark, path, fmt, df.schema).collect() == df.collect()
