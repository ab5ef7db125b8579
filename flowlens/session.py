"""Spark session and shared-folder helpers.

Everything in the package takes a ``SparkSession`` from the caller; this module only
builds one for tests and benches and resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours should carry.  ANSI stays on (bad casts raise, so the
# library uses try_cast / try_divide on purpose), time zone is UTC, AQE re-plans joins
# and shuffle partition counts at run time and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # MIN / MAX / COUNT over parquet answered from footers when possible (e.g. newest ts).
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "flowlens", extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    from pyspark import SparkConf

    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    # Under spark-submit the master comes from the launcher; only default to local otherwise.
    if master or not SparkConf().contains("spark.master"):
        builder = builder.master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("FLOWLENS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    On a cluster the operator sets ``spark.checkpoint.dir`` to a shared file system; we only
    read it, and without it a cluster session is refused.  A session of one machine
    (master ``local``) falls back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="flowlens-ckpt-")  # one machine: every task sees it
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def apply_session_defaults(spark: SparkSession) -> None:
    """Set the runtime-settable part of BASE_CONF on a session built elsewhere."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.ui"):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on some deployments
            pass


_SHIPPED: set[int] = set()


def ensure_python_package(spark: SparkSession) -> None:
    """Ship this package to the executors' Python workers (once per SparkContext).

    Operators that run Python on executors (``applyInPandas`` / ``mapInPandas``) pickle
    functions of this package by reference; workers must be able to import it.  The
    package is zipped on the driver and distributed with ``addPyFile`` (the same as
    ``--py-files``); nothing is read from executor-local folders.
    """
    import zipfile

    import flowlens

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(flowlens.__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="flowlens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(id(sc))
