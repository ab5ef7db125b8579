"""Structured Streaming scoring and roll-ups (ST1-ST6).

The reference scores one packet at a time in a loop.  Here a flow stream is a
``readStream`` over files (a Kafka source is only a format switch), every transform is
row-local or a windowed aggregate with a watermark, sinks are checkpointed so a
restarted query neither loses nor duplicates output:

* ST1 scoring and ST2 alerts: append to a parquet file sink (exactly-once with its
  checkpoint);
* ST3 periodic statistics and ST5 live hourly traffic: ``foreachBatch`` writes each
  micro-batch's rows under ``batch_id=<id>`` with overwrite, so a replayed batch
  replaces its own output (idempotent);
* ST4 running totals: unkeyed aggregate in complete mode;
* ST6 duplicate deliveries: ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import alerts as A

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None,
                fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """A flow stream.  Files (parquet / json / csv) by default; ``fmt='kafka'`` with the
    usual ``kafka.bootstrap.servers`` / ``subscribe`` options reads records whose value is
    JSON in ``schema`` (the source is only a format switch; the rest of the plan is the same)."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**(options or {})).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    folder, name = one_file(spark, path)
    if name:
        r = r.option("pathGlobFilter", name)
    return r.format(fmt).load(folder)


def one_file(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """(folder, None) of a folder, (its folder, its name) of a single file: a file source
    watches folders."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jpath) and fs.getFileStatus(jpath).isFile():
        return jpath.getParent().toString(), jpath.getName()
    return path, None


def run_available_now(df: DataFrame, checkpoint: str, sink: str | None = None, mode: str = "append",
                      batch_fn: Callable[[DataFrame, int], None] | None = None, name: str | None = None):
    """Run a streaming frame over everything available, then stop (tests, backfills, scheduled jobs).

    Returns the finished query (its ``lastProgress`` feeds ``progress_rates``)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if name:
        w = w.queryName(name)
    if batch_fn is not None:
        q = w.foreachBatch(batch_fn).start()
    else:
        q = w.format("parquet").start(sink)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each micro-batch lands under batch_id=<id>, replays overwrite it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ST1: apply a row-local scorer (a fitted PipelineModel.transform or a decision rule)."""
    return scorer(stream)


def alert_stream(scored: DataFrame, **kw) -> DataFrame:
    """ST2: alerts of a scored stream (AL1 shape)."""
    return A.alerts(scored, **kw)


def periodic_stats(scored: DataFrame, window: str = "60 seconds", flag_col: str = "is_attack",
                   ts_col: str = "ts") -> DataFrame:
    """ST3: per-window partial counts of one micro-batch (merged by ``merge_periodic``)."""
    return (scored.groupBy(F.window(ts_col, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(flag_col).cast("int")).alias("attacks"))
            .select(F.col("w.start").alias("window_start"), "total", "attacks"))


def merge_periodic(spark: SparkSession, path: str) -> DataFrame:
    """ST3: sum the partial counts of all micro-batches per window."""
    parts = spark.read.parquet(path)
    return parts.groupBy("window_start").agg(F.sum("total").cast("bigint").alias("total"),
                                             F.sum("attacks").cast("bigint").alias("attacks"))


def running_totals(scored: DataFrame, flag_col: str = "is_attack") -> DataFrame:
    """ST4: unkeyed running aggregate since the start of the stream (complete mode)."""
    flag = F.col(flag_col).cast("int")
    return scored.agg(F.count(F.lit(1)).alias("total"), F.sum(flag).cast("bigint").alias("attacks"),
                      (F.count(F.lit(1)) - F.sum(flag)).cast("bigint").alias("normal"))


def hourly_live(scored: DataFrame, flag_col: str = "is_attack", ts_col: str = "ts",
                watermark: str = WATERMARK) -> DataFrame:
    """ST5: 1-hour tumbling windows with a watermark; rows later than it are dropped.

    Spark filters late input against the watermark of the previous micro-batch, so a
    late row is dropped from the second batch after the one that moved the watermark on.
    """
    return (scored.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(flag_col).cast("int")).alias("attacks"))
            .select(F.col("w.start").alias("hour"), "total", "attacks"))


def latest_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """ST5 read side: for update-mode output, the last written row per key wins."""
    parts = spark.read.parquet(path)
    w = Window.partitionBy(key).orderBy(F.col("batch_id").desc())
    return parts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r", "batch_id")


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Complete-mode output: the rows written by the newest micro-batch."""
    parts = spark.read.parquet(path)
    newest = parts.agg(F.max("batch_id").alias("batch_id"))
    return parts.join(F.broadcast(newest), "batch_id").drop("batch_id")


def dedupe_stream(stream: DataFrame, key: str = "flow_id", ts_col: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """ST6: drop repeated deliveries of the same flow within the watermark."""
    return stream.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key])


def progress_rates(query) -> dict:
    """AL5 live: input and processing rates of the last micro-batch (StreamingQueryProgress)."""
    p = query.lastProgress or {}
    return {"batch_id": p.get("batchId"), "input_rows": p.get("numInputRows"),
            "rows_per_sec": p.get("processedRowsPerSecond"), "batch_ms": (p.get("durationMs") or {}).get("triggerExecution")}
