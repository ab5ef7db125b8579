"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlens.session import ensure_checkpoint_dir, ensure_python_package

# White space and words as every contract of this subpackage defines them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# bytes.split() without arguments splits on exactly the bytes of SPACE; this table
# lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Rows of an Arrow batch handed to Python: texts are long, so batches stay small and a
# worker's memory does not depend on how rows fall into partitions.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and bound the Arrow batches."""
    ensure_checkpoint_dir(spark)
    ensure_python_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand ``rows`` rows at a time to Python (for narrow tables)."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowlens-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, so a
    lost executor costs a re-read and never a recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more, and releases their jobs' shuffle files."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs that nothing refers to any more (it waits
    for the driver's garbage collection)."""
    spark._jvm.System.gc()


# What this Python worker keeps from task to task: by module, the call that lets it go.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(module: str, let_go: Callable[[], None]) -> None:
    """``module`` keeps something in this worker until a task of another module runs here (see ``takes_worker``)."""
    _KEPT[module] = let_go


def takes_worker(module: str) -> None:
    """Called as a task starts: lets go of what other modules keep.  Workers outlive their stages, so
    what one operator has kept would otherwise add to the memory of those after it."""
    for other in [m for m in _KEPT if m != module]:
        _KEPT.pop(other)()
    pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Row-wise Arrow mapping: ``fn`` turns one record batch into one record batch."""
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_worker(module)
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def doc_text(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id long, text string with null as empty) and ``extra`` columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def crc_mod(col: str | Column, k: int) -> Column:
    """crc32 of the id as text modulo ``k`` (null id: as the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % k).cast("int")


def hash_sample(rows: DataFrame, size: int, by: str = "doc_id") -> DataFrame:
    """The ``size`` rows of least md5 of ``by`` (all, if fewer): the same on every layout.

    Rows are first cut at a hash that leaves about twice ``size``, so no task hands on more
    than its share of the sample.  ``by`` should tell rows apart; rows with equal ids are
    kept or left out in the order of their other columns.
    """
    n = rows.count()
    key = F.md5(F.coalesce(F.col(by).cast("string"), F.lit("")))
    if n > 2 * size:
        share = min(1.0, 2.0 * size / n + 1e-4)
        rows = rows.filter(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") < share * 16.0 ** 8)
    return rows.orderBy(key, *rows.columns).limit(size)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def hex16(col: str | Column) -> Column:
    """A long as 16 lower-case hex digits of its two's complement."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.lpad(F.hex(c), 16, "0"))
