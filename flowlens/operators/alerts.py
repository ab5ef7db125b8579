"""Alerts, counters and roll-ups over scored traffic (AL1-AL12)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.functions.exprs import safe_div


def severity(type_col: Column | str, confidence: Column | str,
             critical_types: list[str] = C.SEVERITY_CRITICAL_TYPES,
             bands: tuple[float, float] = C.SEVERITY_BANDS) -> Column:
    """AL8: Critical for listed attack types, else High / Medium / Low by confidence band."""
    t = F.col(type_col) if isinstance(type_col, str) else type_col
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return (F.when(t.isin(*critical_types), F.lit("Critical"))
            .when(c >= bands[0], F.lit("High"))
            .when(c >= bands[1], F.lit("Medium"))
            .otherwise(F.lit("Low")))


def alerts(scored: DataFrame, flag_col: str = "is_attack", id_col: str = "flow_id", ts_col: str = "ts",
           type_col: str = "attack_type", confidence_col: str = "confidence", src_col: str = "src_ip",
           dst_col: str = "dst_ip", feature_cols: list[str] | None = None) -> DataFrame:
    """AL1: one alert row per flagged flow.

    ``features`` carries the first five feature values as a map (the daemon's alert shape).
    """
    cols = [
        F.col(id_col).alias("alert_id"),
        F.col(ts_col).alias("ts"),
        F.col(type_col).alias("type"),
        severity(type_col, confidence_col).alias("severity"),
        F.col(src_col).alias("source"),
        F.col(dst_col).alias("destination"),
        F.col(confidence_col).alias("confidence"),
        F.concat(F.col(type_col), F.lit(" detected from "), F.col(src_col)).alias("description"),
    ]
    if feature_cols:
        fc = feature_cols[:5]
        cols.append(F.create_map(*[x for c in fc for x in (F.lit(c), F.col(c).cast("double"))]).alias("features"))
    return scored.where(F.col(flag_col)).select(*cols)


def last_alerts(alert_df: DataFrame, n: int = C.RECENT_ALERTS, ts_col: str = "ts", id_col: str = "alert_id") -> DataFrame:
    """AL2: the newest ``n`` alerts (top-k: per-partition top-n, then one small merge)."""
    return alert_df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n)


def counters(df: DataFrame, flag_col: str = "is_attack", error_col: str | None = None) -> DataFrame:
    """AL3: total / normal / attack / (error) counts and attack rate in %, 0 when empty."""
    flag = F.col(flag_col).cast("int")
    aggs = [F.count(F.lit(1)).alias("total"),
            F.coalesce(F.sum(flag), F.lit(0)).cast("bigint").alias("attack")]
    if error_col:
        aggs.append(F.coalesce(F.sum(F.col(error_col).cast("int")), F.lit(0)).cast("bigint").alias("error"))
    out = df.agg(*aggs)
    normal = F.col("total") - F.col("attack") - (F.col("error") if error_col else F.lit(0))
    return out.select("*", normal.cast("bigint").alias("normal"),
                      F.coalesce(safe_div(F.col("attack") * 100.0, F.col("total")), F.lit(0.0)).alias("attack_rate"))


def packets_per_second(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """AL4: rows / elapsed seconds between the first and last row (NULL for < 2 distinct ts)."""
    secs = F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6
    out = df.agg(F.count(F.lit(1)).alias("total"), (F.max(secs) - F.min(secs)).alias("elapsed_sec"))
    return out.select("*", safe_div(F.col("total").cast("double"), F.col("elapsed_sec")).alias("packets_per_sec"))


def latency_stats(df: DataFrame, latency_col: str) -> DataFrame:
    """AL5: mean processing time over all rows of a latency column."""
    return df.agg(F.count(F.col(latency_col)).alias("n"), F.avg(latency_col).alias("mean_time"))


def hourly_traffic(df: DataFrame, flag_col: str = "is_attack", ts_col: str = "ts",
                   last_n: int | None = None) -> DataFrame:
    """AL6: per hour total / attacks / normal.

    ``last_n`` restricts to the last ``last_n`` clock hours up to the newest row (the
    dashboard's window).  The newest timestamp is one cheap aggregate (answered from
    parquet footers when ``ts`` is a scanned column); the window then becomes a plain
    ``ts >=`` predicate that reaches the parquet scan, so only the newest row groups are
    read instead of aggregating every hour and keeping the last ones.
    """
    if last_n:
        newest = df.agg(F.max(ts_col)).first()[0]
        if newest is None:
            return hourly_traffic(df.limit(0), flag_col, ts_col)
        start = newest.replace(minute=0, second=0, microsecond=0) - datetime.timedelta(hours=last_n - 1)
        df = df.where(F.col(ts_col) >= F.lit(start).cast(df.schema[ts_col].dataType))
    out = (df.groupBy(F.date_trunc("hour", F.col(ts_col)).alias("hour"))
           .agg(F.count(F.lit(1)).alias("total"),
                F.coalesce(F.sum(F.col(flag_col).cast("int")), F.lit(0)).cast("bigint").alias("attacks")))
    return out.select("hour", "total", "attacks", (F.col("total") - F.col("attacks")).alias("normal"))


def type_distribution(df: DataFrame, type_col: str = "type") -> DataFrame:
    """AL7 / AG3: count and percentage per type, largest first."""
    from flowlens.operators.profile import distribution

    return distribution(df.select(F.col(type_col).alias("type")), "type", "n", "percentage").orderBy(F.col("n").desc(), F.col("type"))


def monitoring_report(scored: DataFrame, alert_df: DataFrame, flag_col: str = "is_attack", ts_col: str = "ts",
                      latency_col: str | None = None, n_recent: int = C.RECENT_ALERTS,
                      info_chars: int = C.ALERT_INFO_CHARS) -> DataFrame:
    """AL9: one row with run duration, counts, mean time, attack rate and the newest alerts.

    The recent-alert list is built from a top-k (at most ``n_recent`` rows), never from
    the full alert set.
    """
    secs = F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6
    aggs = [F.count(F.lit(1)).alias("total"),
            F.coalesce(F.sum(F.col(flag_col).cast("int")), F.lit(0)).cast("bigint").alias("attacks"),
            (F.max(secs) - F.min(secs)).alias("duration_sec")]
    if latency_col:
        aggs.append(F.avg(latency_col).alias("mean_time"))
    stats = scored.agg(*aggs).withColumn(
        "attack_rate", F.coalesce(safe_div(F.col("attacks") * 100.0, F.col("total")), F.lit(0.0)))
    recent = last_alerts(alert_df, n_recent).select(
        F.struct("ts", "alert_id", "type", F.substring("description", 1, info_chars).alias("info")).alias("a"))
    packed = recent.agg(F.sort_array(F.collect_list("a"), asc=False).alias("recent_alerts"))
    from flowlens.operators.common import combine_rows

    return combine_rows(stats, packed)


def performance_summary(df: DataFrame, y_col: str = "y", pred_col: str = "pred", ts_col: str | None = "ts") -> DataFrame:
    """AL10: binary accuracy, precision, recall, F1, false-positive rate, rows per second."""
    y, p = F.col(y_col).cast("int"), F.col(pred_col).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
            F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
            F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
            F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn")]
    if ts_col:
        secs = F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6
        aggs.append((F.max(secs) - F.min(secs)).alias("elapsed_sec"))
    c = df.agg(*aggs)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec = F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(safe_div(tp, tp + fn), F.lit(0.0))
    out = c.select(
        safe_div(tp + tn, F.col("n")).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        F.coalesce(safe_div(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1_score"),
        F.coalesce(safe_div(fp, fp + tn), F.lit(0.0)).alias("false_positive_rate"),
        (safe_div(F.col("n").cast("double"), F.col("elapsed_sec")) if ts_col else F.lit(None).cast("double"))
        .alias("processing_speed"),
    )
    return out


def run_summary(spark: SparkSession, facts: dict) -> DataFrame:
    """AL12: small key/value summary of a run (sizes, features, classes, model metrics)."""
    rows = [(str(k), str(v)) for k, v in facts.items()]
    return spark.createDataFrame(rows, "key string, value string")


def model_facts(metrics: DataFrame) -> DataFrame:
    """AL12: (key, value) of a table of metrics with one row per model."""
    names = [c for c in metrics.columns if c != "model"]
    facts = F.array(*[F.struct(F.concat_ws(": ", "model", F.lit(c)).alias("key"), F.col(c).cast("double").alias("value")) for c in names])
    return metrics.select(F.explode(facts).alias("f")).select("f.*")
