"""Detection rules declared by the reference's documentation (DR1-DR7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import quote, safe_div


def rate_per_window(df: DataFrame, key: str, ts_col: str = "ts", window: str = "1 second") -> DataFrame:
    """DR1 profile: rows per (key, tumbling window); window start as a plain timestamp column."""
    w = F.window(F.col(ts_col).cast("timestamp"), window)
    return df.groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), key, "n")


# Documented thresholds (fixed values): packets and connections per second, ports per minute.
PACKET_RATE, CONNECTION_RATE, PORT_SCAN_PORTS = 1000, 100, 50


def rate_alerts(df: DataFrame, key: str, threshold: int = PACKET_RATE, ts_col: str = "ts", window: str = "1 second") -> DataFrame:
    """DR1: keys whose row count in a window exceeds ``threshold`` (packets / connections per second)."""
    return rate_per_window(df, key, ts_col, window).where(F.col("n") > threshold)


def distinct_ports(df: DataFrame, key: str = "src_ip", port: str = "dst_port", ts_col: str = "ts",
                   window: str = "1 minute", approx: bool = False) -> DataFrame:
    """DR2 profile: distinct destination ports per (source, window); exact in batch,
    HyperLogLog in streaming (``approx=True``)."""
    w = F.window(F.col(ts_col).cast("timestamp"), window)
    agg = F.approx_count_distinct(port) if approx else F.count_distinct(port)
    return df.groupBy(w.alias("w"), F.col(key)).agg(agg.alias("n_ports")).select(
        F.col("w.start").alias("window_start"), key, "n_ports")


def port_scan_alerts(df: DataFrame, threshold: int = PORT_SCAN_PORTS, **kw) -> DataFrame:
    """DR2: more than ``threshold`` distinct ports in a window."""
    return distinct_ports(df, **kw).where(F.col("n_ports") > threshold)


def whitelist_filter(df: DataFrame, whitelist: DataFrame, key: str) -> DataFrame:
    """DR4: drop rows whose key is in the first column of ``whitelist`` (anti join; Spark broadcasts
    the list while it is small in bytes)."""
    wl = whitelist.select(F.col(whitelist.columns[0]).alias(key)).distinct()
    return df.join(wl, key, "left_anti")


SKETCH_BITS = 12  # 4,096 registers: standard error 1.6 %


def port_sketches(df: DataFrame, key: str = "src_ip", port: str = "dst_port", ts_col: str = "ts",
                  window: str = "1 minute", bits: int = SKETCH_BITS) -> DataFrame:
    """DR2 store: (window_start, key, sketch), a mergeable distinct-count state of at most some 2**bits
    bytes per (key, window), whatever the traffic."""
    w = F.window(F.col(ts_col).cast("timestamp"), window)
    return df.groupBy(w.alias("w"), F.col(key)).agg(F.hll_sketch_agg(port, F.lit(bits)).alias("sketch")).select(
        F.col("w.start").alias("window_start"), key, "sketch")


def merged_ports(sketches: DataFrame, key: str = "src_ip", window: str = "1 day") -> DataFrame:
    """DR2 roll-up: (window_start, key, n_ports) of longer windows from stored sketches alone; ports
    seen in several short windows count once."""
    w = F.window("window_start", window)
    return sketches.groupBy(w.alias("w"), F.col(key)).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_ports")).select(
        F.col("w.start").alias("window_start"), key, "n_ports")


def tune_threshold(roc: DataFrame, target_fpr: float = 0.01) -> DataFrame:
    """DR6: the threshold with the highest TPR whose FPR stays within the target (ties: highest threshold)."""
    ok = roc.where(F.col("fpr") <= F.lit(target_fpr))
    return ok.orderBy(F.col("tpr").desc(), F.col("threshold").desc()).limit(1)


def baseline_deviation(df: DataFrame, key: str, value: str, normal_flag: str) -> DataFrame:
    """DR7: per-key mean / std of ``value`` over normal rows, joined back, z-score of every row.

    The baseline has one row per key; Spark broadcasts it while it is small in bytes and splits
    hot keys otherwise.  ``operators.baseline`` keeps it between runs.
    """
    base = df.where(F.col(normal_flag)).groupBy(key).agg(F.avg(value).alias("base_mean"),
                                                          F.stddev_samp(value).alias("base_std"))
    out = df.join(base, key, "left")
    return out.withColumn("deviation", safe_div(F.col(value) - F.col("base_mean"), F.col("base_std")))


def f_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """DR5: (feature, f_score), the ANOVA F of each feature against a class label.

    One aggregate per class (partial sums per task); the classes are then combined.  Missing
    values count as 0; a feature without variance inside the classes has no score.
    """
    x = {c: F.coalesce(F.nanvl(F.col(quote(c)).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features}
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[a for i, c in enumerate(features) for a in (
            F.avg(x[c]).alias(f"m{i}"), F.var_pop(x[c]).alias(f"v{i}"))])
    long = per_class.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(features)])).alias("s")).select("n", "s.*")
    total = long.groupBy("feature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"),
                                        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    both = long.join(total, "feature")
    sums = both.groupBy("feature").agg(
        F.max("rows").alias("rows"), F.max("k").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"))
    return sums.select("feature", safe_div(F.col("between") / (F.col("k") - 1),
                                           F.col("within") / (F.col("rows") - F.col("k"))).alias("f_score"))


def select_top_features(df: DataFrame, features: list[str], label: str, k: int = 50) -> tuple[DataFrame, list[str]]:
    """DR5: keep the k features with the highest ANOVA F score (ties by name; no score: last)."""
    top = f_scores(df, features, label).orderBy(F.col("f_score").desc_nulls_last(), "feature").limit(k).collect()
    picked = {r["feature"] for r in top}
    chosen = [c for c in features if c in picked]
    return df.select(*[c for c in df.columns if c not in features or c in chosen]), chosen
