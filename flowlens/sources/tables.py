"""Driver tables and the flow-record views built on them.

The reference expects labelled flow datasets (KDD-, UNSW- and CIC-shaped).  None ship, so
the test inputs are views over the driver's generated tables.  Each view reads only the
columns it needs, so the parquet scan prunes columns and row filters on top of a view
push down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def _mod(c: str, k: int) -> Column:
    return F.col(c) % F.lit(k)


FLOW_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The events table as a file stream: read where it lies, in its own files.

    Event time becomes a session-zone ``timestamp`` (watermarks need it).
    """
    from flowlens.streaming.stream import read_stream

    path = table_path(sf_dir, "events")
    e = read_stream(spark, path, spark.read.parquet(path).schema, max_files=max_files).select(*FLOW_COLUMNS)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def flows(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """KDD-like flows: one row per event, label column ``target`` (normal label ``normal``).

    ``events`` may be a stream of the events table instead of the table itself.

    Carries on purpose: a padded / mixed-case label, a label unknown to every taxonomy,
    nulls in ``flag``, ``diff_srv_rate`` and ``ttl``, +inf and NaN in ``flow_rate``.
    """
    e = events if events is not None else read_table(spark, sf_dir, "events", FLOW_COLUMNS)
    eid, val, etype = F.col("event_id"), F.col("value"), F.col("event_type")
    target = (F.when((etype == "error") & (val > 50), "neptune")
              .when(etype == "error", " Smurf ")
              .when((etype == "signup") & (val > 100), "portsweep")
              .when((etype == "purchase") & (val > 150), "guess_passwd")
              .when((etype == "view") & (val > 200), "rootkit")
              .when((etype == "click") & (val > 300), "zero_day")
              .otherwise("normal"))
    return e.select(
        eid.alias("flow_id"),
        F.col("ts"),
        F.concat(F.lit("10.0.0."), _mod("user_id", 250).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.1."), _mod("event_id", 50).cast("string")).alias("dst_ip"),
        ((eid * 7919) % 1024).cast("int").alias("dst_port"),
        F.when(_mod("event_id", 3) == 0, "tcp").when(_mod("event_id", 3) == 1, "udp").otherwise("icmp")
        .alias("protocol_type"),
        etype.alias("service"),
        F.when(_mod("event_id", 29) == 0, F.lit(None).cast("string"))
        .when(_mod("event_id", 4) == 0, "S0").otherwise("SF").alias("flag"),
        (val / 10).alias("duration"),
        F.floor(val * 100).cast("bigint").alias("src_bytes"),
        F.floor(val * _mod("event_id", 7)).cast("bigint").alias("dst_bytes"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("conn_count"),
        (_mod("user_id", 20) + 1).cast("int").alias("srv_count"),
        (_mod("event_id", 11).cast("double") / 10).alias("serror_rate"),
        (_mod("event_id", 6).cast("double") / 5).alias("srv_serror_rate"),
        (_mod("event_id", 5).cast("double") / 4).alias("same_srv_rate"),
        F.when(_mod("event_id", 17) == 0, F.lit(None).cast("double"))
        .otherwise(_mod("event_id", 9).cast("double") / 8).alias("diff_srv_rate"),
        F.when(_mod("event_id", 13) == 0, F.lit(None).cast("int"))
        .otherwise((32 + _mod("event_id", 200)).cast("int")).alias("ttl"),
        F.when(_mod("event_id", 101) == 0, F.lit(float("inf")))
        .when(_mod("event_id", 103) == 0, F.lit(float("nan"))).otherwise(val).alias("flow_rate"),
        target.alias("target"),
    )


def flows_unsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNSW-like flows: numeric ``label`` 0/1, category ``attack_cat``, an ``id`` column."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax"])
    k = _mod("l_partkey", 12)
    cat = (F.when(k == 0, "Exploits").when(k == 1, "Generic").when(k == 2, "Fuzzers")
           .when(k == 3, "Reconnaissance").when(k == 4, "DoS").when(k == 5, "Worms").otherwise("Normal"))
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_discount").alias("dur"),
        F.floor("l_extendedprice").cast("bigint").alias("sbytes"),
        F.floor(F.col("l_quantity") * 3).cast("bigint").alias("dbytes"),
        F.col("l_tax").alias("rate"),
        F.col("l_linenumber").alias("spkts"),
        cat.alias("attack_cat"),
        F.when(k < 6, 1).otherwise(0).alias("label"),
    )


def flows_cic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIC-like flows: string ``Label`` with ``BENIGN`` as the normal value."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    k = _mod("o_orderkey", 20)
    names = ["DDoS", "PortScan", "FTP-Patator", "Web Attack - XSS", "Web Attack - Brute Force", "Bot",
             "Infiltration", "DoS Hulk", "Heartbleed"]
    label = F.lit("BENIGN")
    for i in reversed(range(len(names))):
        label = F.when(k == i, names[i]).otherwise(label)
    return o.select(
        F.col("o_orderkey").alias("flow_no"),
        (F.col("o_totalprice") / 100).alias("flow_duration"),
        _mod("o_custkey", 500).cast("int").alias("packet_count"),
        label.alias("Label"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed attack probabilities of three imaginary models over ``flows`` (many ties)."""
    f = flows(spark, sf_dir).select("flow_id", "ts", "service", "src_ip", "dst_ip", "target", "srv_count")
    normal = F.lower(F.trim("target")) == "normal"
    fid = F.col("flow_id")
    return f.select(
        "flow_id", "ts", "service", "src_ip", "dst_ip",
        F.when(normal, 0).otherwise(1).alias("y"),
        (((fid * 37) % 101).cast("double") / 100).alias("p_a"),
        (((fid * 53 + F.col("srv_count")) % 21).cast("double") / 20).alias("p_b"),
        F.when(normal, (fid % 60).cast("double") / 100)
        .otherwise((40 + fid % 60).cast("double") / 100).alias("p_c"),
    )


def scored_flows(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``flows`` with the ``scores`` columns added in the same projection (no join)."""
    f = flows(spark, sf_dir, events)
    normal = F.lower(F.trim("target")) == "normal"
    fid = F.col("flow_id")
    return f.select(
        "*",
        F.when(normal, 0).otherwise(1).alias("y"),
        (((fid * 37) % 101).cast("double") / 100).alias("p_a"),
        (((fid * 53 + F.col("srv_count")) % 21).cast("double") / 20).alias("p_b"),
        F.when(normal, (fid % 60).cast("double") / 100)
        .otherwise((40 + fid % 60).cast("double") / 100).alias("p_c"),
    )


VIEWS = {"flows": flows, "flows_unsw": flows_unsw, "flows_cic": flows_cic, "scores": scores,
         "scored_flows": scored_flows}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver tables and the flow views as temp views (SQL use)."""
    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)
