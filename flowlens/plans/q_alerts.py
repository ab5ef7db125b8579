"""Queries for alerts, counters and roll-ups (AL1-AL12) and the scoring rules (SC2-SC7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import config as C
from flowlens.functions import labels as L
from flowlens.operators import alerts as A
from flowlens.operators import evaluate as EV
from flowlens.operators import scoring as S
from flowlens.plans.registry import query
from flowlens.sources import readers, tables
from flowlens.sources.sinks import write_table
from flowlens.sources.versioned import VersionedTable
from flowlens.session import scratch_path

KDD = C.default_datasets("/")["nsl_kdd_train"]

# SQL fragments shared by the twins below.
ATTACK_SQL = "(CASE WHEN contains(lower(trim(cast(target AS varchar))), 'normal') THEN 0 ELSE 1 END)"
KDD_TYPE_SQL = """(CASE
  WHEN contains(lower(target), 'normal') THEN 'Normal'
  WHEN regexp_matches(lower(target), 'neptune|smurf|back|teardrop|pod|land|apache2|udpstorm|processtable|worm') THEN 'DoS'
  WHEN regexp_matches(lower(target), 'satan|ipsweep|nmap|portsweep|mscan|saint') THEN 'Probe'
  WHEN regexp_matches(lower(target), 'guess_passwd|ftp_write|imap|phf|multihop|warezmaster|warezclient|spy|named|snmpguess') THEN 'R2L'
  WHEN regexp_matches(lower(target), 'buffer_overflow|loadmodule|rootkit|perl|sqlattack|xterm|ps|httptunnel') THEN 'U2R'
  ELSE 'Other' END)"""
SCORED_SQL = f"""scored AS (
  SELECT flow_id, ts, src_ip, dst_ip, duration, src_bytes, dst_bytes, y, p_c,
         p_c > 0.55 AS is_attack,
         CASE WHEN p_c > 0.55 THEN p_c ELSE 1 - p_c END AS confidence,
         {KDD_TYPE_SQL} AS attack_type
  FROM scored_flows)"""
ALERTS_SQL = f"""WITH {SCORED_SQL},
alerts AS (
  SELECT flow_id AS alert_id, ts, attack_type AS type,
         CASE WHEN attack_type IN ('DDoS', 'DoS', 'U2R') THEN 'Critical'
              WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' ELSE 'Low' END AS severity,
         src_ip AS source, dst_ip AS destination, confidence,
         concat(attack_type, ' detected from ', src_ip) AS description
  FROM scored WHERE is_attack)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows: fixed probability p_c through the threshold rule, KDD attack type."""
    df = tables.scored_flows(spark, sf_dir)
    df = S.threshold_rule(df, "p_c", C.ATTACK_THRESHOLD)
    return df.withColumn("attack_type", L.kdd_category("target"))


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts(scored(spark, sf_dir))


@query("AL6_hourly_traffic", f"""
SELECT date_trunc('hour', ts) AS hour, count(*) AS total, cast(sum({ATTACK_SQL}) AS bigint) AS attacks,
       count(*) - cast(sum({ATTACK_SQL}) AS bigint) AS normal
FROM flows GROUP BY 1""")
def al6_hourly_traffic(spark, sf_dir):
    """Flagship: label flows (LB1) and roll them up per hour (AL6)."""
    from flowlens.operators.labelling import prepare_labels

    df = prepare_labels(tables.flows(spark, sf_dir), KDD, "nsl_kdd_train")
    return A.hourly_traffic(df.withColumn("is_attack", F.col("unified_label") == 1))


@query("AL6_last_24_hours", f"""
SELECT date_trunc('hour', ts) AS hour, count(*) AS total, cast(sum({ATTACK_SQL}) AS bigint) AS attacks,
       count(*) - cast(sum({ATTACK_SQL}) AS bigint) AS normal
FROM flows WHERE ts >= (SELECT date_trunc('hour', max(ts)) - INTERVAL 23 HOUR FROM flows) GROUP BY 1""")
def al6_last_24(spark, sf_dir):
    """Dashboard view: the last 24 clock hours up to the newest flow (time-window filter pushed to the scan)."""
    df = tables.flows(spark, sf_dir).withColumn("is_attack", L.binary_label("target", "normal") == 1)
    return A.hourly_traffic(df, last_n=24)


@query("AL1_alerts", ALERTS_SQL + "SELECT * FROM alerts")
def al1_alerts(spark, sf_dir):
    return alert_rows(spark, sf_dir)


@query("AL2_last_alerts", ALERTS_SQL + "SELECT * FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 10")
def al2_last_alerts(spark, sf_dir):
    return A.last_alerts(alert_rows(spark, sf_dir), C.RECENT_ALERTS)


@query("AL3_counters", f"""WITH {SCORED_SQL}
SELECT count(*) AS total, cast(coalesce(sum(CAST(is_attack AS int)), 0) AS bigint) AS attack,
       cast(count(*) - coalesce(sum(CAST(is_attack AS int)), 0) AS bigint) AS normal,
       coalesce(coalesce(sum(CAST(is_attack AS int)), 0) * 100.0 / nullif(count(*), 0), 0.0) AS attack_rate
FROM scored""")
def al3_counters(spark, sf_dir):
    return A.counters(scored(spark, sf_dir))


@query("AL4_packets_per_second", """
SELECT count(*) AS total, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_sec,
       count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS packets_per_sec
FROM flows""")
def al4_pps(spark, sf_dir):
    return A.packets_per_second(tables.flows(spark, sf_dir))


@query("AL5_mean_time", "SELECT count(duration) AS n, avg(duration) AS mean_time FROM flows")
def al5_mean_time(spark, sf_dir):
    return A.latency_stats(tables.flows(spark, sf_dir), "duration")


@query("AL7_attack_types", ALERTS_SQL + """
SELECT type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percentage FROM alerts GROUP BY type""")
def al7_attack_types(spark, sf_dir):
    return A.type_distribution(alert_rows(spark, sf_dir), "type")


@query("AL8_severity", ALERTS_SQL + "SELECT severity, count(*) AS n FROM alerts GROUP BY severity")
def al8_severity(spark, sf_dir):
    return alert_rows(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("AL9_monitoring_report", ALERTS_SQL + """,
stats AS (
  SELECT count(*) AS total, cast(sum(CAST(is_attack AS int)) AS bigint) AS attacks,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_sec, avg(duration) AS mean_time,
         coalesce(sum(CAST(is_attack AS int)) * 100.0 / nullif(count(*), 0), 0.0) AS attack_rate
  FROM scored),
recent AS (SELECT * FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 10)
SELECT s.*, (SELECT count(*) FROM recent) AS n_recent,
       (SELECT alert_id FROM recent ORDER BY ts DESC, alert_id DESC LIMIT 1) AS newest_alert_id,
       (SELECT substring(description, 1, 100) FROM recent ORDER BY ts DESC, alert_id DESC LIMIT 1) AS newest_info
FROM stats s""")
def al9_report(spark, sf_dir):
    sc = scored(spark, sf_dir)
    rep = A.monitoring_report(sc, A.alerts(sc), latency_col="duration")
    return rep.select("total", "attacks", "duration_sec", "mean_time", "attack_rate",
                      F.size("recent_alerts").cast("bigint").alias("n_recent"),
                      F.col("recent_alerts")[0]["alert_id"].alias("newest_alert_id"),
                      F.col("recent_alerts")[0]["info"].alias("newest_info"))


@query("AL10_performance_summary", """
WITH c AS (
  SELECT count(*) AS n,
         sum(CASE WHEN y = 1 AND p_c > 0.55 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN y = 0 AND p_c > 0.55 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN y = 0 AND NOT p_c > 0.55 THEN 1 ELSE 0 END) AS tn,
         sum(CASE WHEN y = 1 AND NOT p_c > 0.55 THEN 1 ELSE 0 END) AS fn,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_sec
  FROM scores),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec FROM c)
SELECT (tp + tn) / n AS accuracy, prec AS precision, rec AS recall,
       coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) AS f1_score,
       coalesce(fp / nullif(fp + tn, 0), 0.0) AS false_positive_rate,
       n / nullif(elapsed_sec, 0) AS processing_speed
FROM m""")
def al10_performance(spark, sf_dir):
    df = tables.scores(spark, sf_dir).withColumn("pred", (F.col("p_c") > C.ATTACK_THRESHOLD).cast("int"))
    return A.performance_summary(df, "y", "pred", "ts")


ALERT_SCHEMA = T.StructType([
    T.StructField("alert_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("type", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("destination", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("description", T.StringType()),
])


@query("AL11_alert_export", ALERTS_SQL + "SELECT * FROM alerts")
def al11_export(spark, sf_dir):
    """Export the alerts as CSV into the shared folder and read the export back."""
    path = scratch_path(spark, "alert-export")
    write_table(alert_rows(spark, sf_dir), path, fmt="csv")
    return readers.read_any(spark, path, "csv", ALERT_SCHEMA)


@query("AL11_clear_and_reset", ALERTS_SQL + """
SELECT step, CASE WHEN step IN ('cleared') THEN 0 WHEN step IN ('exported') THEN (SELECT count(*) FROM alerts WHERE alert_id % 2 = 0)
             ELSE (SELECT count(*) FROM alerts) END AS n_alerts, version
FROM (VALUES ('exported', 1), ('appended', 2), ('after a failed write', 2), ('cleared', 3), ('before the reset', 2)) s(step, version)""")
def al11_clear(spark, sf_dir):
    """Export, append, a write that fails half way, clear, and the version from before the reset."""
    alerts = alert_rows(spark, sf_dir)
    table = VersionedTable(spark, scratch_path(spark, "alert-log"), alerts.schema)
    even = F.col("alert_id") % 2 == 0
    steps = [("exported", table.replace(alerts.where(even)))]
    steps.append(("appended", table.append(alerts.where(~even))))
    bad = F.when(F.col("alert_id") > 0, F.raise_error(F.lit("sink lost")).cast("string")).otherwise(F.col("type"))
    try:
        table.append(alerts.withColumn("type", bad))
    except Exception as e:  # noqa: BLE001 - the failure is the point of this step
        if "sink lost" not in str(e):
            raise
    steps.append(("after a failed write", table.versions()[-1]))
    steps.append(("cleared", table.clear()))
    steps.append(("before the reset", steps[1][1]))
    counted = [table.read(v).agg(F.count(F.lit(1)).alias("n_alerts")).select(
        F.lit(s).alias("step"), "n_alerts", F.lit(v).alias("version")) for s, v in steps]
    return reduce(DataFrame.unionByName, counted)


@query("AL12_run_summary", f"""WITH {SCORED_SQL},
c AS (SELECT count(*) AS total, sum(CAST(is_attack AS int)) AS attack, count(DISTINCT attack_type) AS classes FROM scored),
t AS (SELECT CAST(sum(round(0.2 * n)) AS BIGINT) AS test_rows FROM (SELECT count(*) AS n FROM scored GROUP BY attack_type))
SELECT 'rows' AS key, cast(total AS varchar) AS value FROM c
UNION ALL SELECT 'attacks', cast(attack AS varchar) FROM c
UNION ALL SELECT 'attack_rate', cast(round(attack * 100.0 / total, 6) AS DOUBLE)::varchar FROM c
UNION ALL SELECT 'classes', cast(classes AS varchar) FROM c
UNION ALL SELECT 'train_rows', cast(total - test_rows AS varchar) FROM c, t
UNION ALL SELECT 'test_rows', cast(test_rows AS varchar) FROM t
UNION ALL SELECT 'features', '12'""")
def al12_run_summary(spark, sf_dir):
    """Counters of a run with the sizes of its split, its features and classes."""
    from flowlens.operators.split import stratified_split
    from flowlens.plans.q_models import CATEGORICAL, FEATURES

    sc = scored(spark, sf_dir)
    train, test = stratified_split(sc, "attack_type", "flow_id", C.TEST_FRACTION)
    c = A.counters(sc).first()
    facts = {"rows": c["total"], "attacks": c["attack"], "attack_rate": round(c["attack_rate"], 6),
             "classes": sc.select("attack_type").distinct().count(), "train_rows": train.count(),
             "test_rows": test.count(), "features": len(FEATURES) + len(CATEGORICAL)}
    return A.run_summary(spark, facts)


MODELS = ("p_a", "p_b", "p_c")


def _model_facts_sql(m: str) -> str:
    """Accuracy, weighted precision / recall / F1 of one score column cut at 0.5, as (key, value)."""
    return f"""
SELECT '{m}: ' || k AS key, v AS value FROM (
  WITH s AS (SELECT y, CASE WHEN {m} > 0.5 THEN 1 ELSE 0 END AS p FROM scores),
  c AS (SELECT l.c, (SELECT count(*) FROM s WHERE y = l.c) AS n, (SELECT count(*) FROM s WHERE p = l.c) AS np,
               (SELECT count(*) FROM s WHERE y = l.c AND p = l.c) AS tp FROM (VALUES (0), (1)) l(c)),
  r AS (SELECT n, tp, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END AS pr, CASE WHEN n > 0 THEN tp::DOUBLE / n ELSE 0 END AS re FROM c),
  f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r),
  a AS (SELECT sum(tp)::DOUBLE / sum(n) AS accuracy, sum(n * pr) / sum(n) AS "precision", sum(n * re) / sum(n) AS recall,
               sum(n * f1) / sum(n) AS f1 FROM f)
  SELECT * FROM (SELECT 'accuracy' AS k, accuracy AS v FROM a UNION ALL SELECT 'precision', "precision" FROM a
                 UNION ALL SELECT 'recall', recall FROM a UNION ALL SELECT 'f1', f1 FROM a))"""


@query("AL12_model_metrics", " UNION ALL ".join(_model_facts_sql(m) for m in MODELS))
def al12_model_metrics(spark, sf_dir):
    """The run summary's metrics, one row per model and metric, from one count over all models."""
    s = tables.scores(spark, sf_dir)
    long = s.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col("y").alias("y"), (F.col(m) > 0.5).cast("int").alias("p"))
                                        for m in MODELS])).alias("e")).select("e.*")
    return A.model_facts(EV.metric_rows(long))


# --- scoring rules on the fixed score table (SC2-SC7) ---------------------------------------


@query("SC2_argmax_rule", """
SELECT flow_id, CASE WHEN p_c > 1 - p_c THEN 1 ELSE 0 END AS predicted_class,
       CASE WHEN p_c > 1 - p_c THEN 'DoS/DDoS' ELSE 'Normal' END AS class_name,
       greatest(p_c, 1 - p_c) AS probability, p_c > 1 - p_c AS is_attack
FROM scores""")
def sc2_argmax(spark, sf_dir):
    df = tables.scores(spark, sf_dir).withColumn("probs", F.array(1 - F.col("p_c"), F.col("p_c")))
    return S.argmax_rule(df, "probs").select("flow_id", "predicted_class", "class_name", "probability", "is_attack")


@query("SC3_threshold_rule", """
SELECT flow_id, CASE WHEN p_c > 0.55 THEN 'Attack' ELSE 'Normal' END AS label,
       CASE WHEN p_c > 0.55 THEN p_c ELSE 1 - p_c END AS confidence, p_c AS attack_prob
FROM scores""")
def sc3_threshold(spark, sf_dir):
    df = S.threshold_rule(tables.scores(spark, sf_dir), "p_c", C.ATTACK_THRESHOLD)
    return df.select("flow_id", "label", "confidence", F.col("p_c").alias("attack_prob"))


@query("SC4_alert_gate", "SELECT flow_id, p_c FROM scores WHERE p_c > 0.55 AND p_c > 0.7")
def sc4_gate(spark, sf_dir):
    df = S.threshold_rule(tables.scores(spark, sf_dir), "p_c", C.ATTACK_THRESHOLD)
    return S.alert_gate(df, "is_attack", "p_c", C.ALERT_CONFIDENCE).select("flow_id", "p_c")


@query("SC6_bad_rows", """
SELECT flow_id,
  CASE WHEN try_cast(raw AS double) IS NULL THEN 'Error' WHEN try_cast(raw AS double) > 0.55 THEN 'Attack' ELSE 'Normal' END AS label,
  CASE WHEN try_cast(raw AS double) IS NULL THEN 0.0 WHEN try_cast(raw AS double) > 0.55 THEN try_cast(raw AS double)
       ELSE 1 - try_cast(raw AS double) END AS confidence,
  try_cast(raw AS double) IS NOT NULL AS valid
FROM (SELECT flow_id, CASE WHEN flow_id % 97 = 0 THEN 'bad' ELSE cast(p_c AS varchar) END AS raw FROM scores)""")
def sc6_bad_rows(spark, sf_dir):
    df = tables.scores(spark, sf_dir).select(
        "flow_id", F.when(F.col("flow_id") % 97 == 0, F.lit("bad")).otherwise(F.col("p_c").cast("string")).alias("raw"))
    return S.guarded_threshold_rule(df, "raw", C.ATTACK_THRESHOLD).select("flow_id", "label", "confidence", "valid")


@query("SC7_correct_mark", """
SELECT flow_id, y AS expected, CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END AS predicted,
       y = CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END AS correct
FROM scores""")
def sc7_correct(spark, sf_dir):
    df = tables.scores(spark, sf_dir).withColumn("predicted", (F.col("p_c") > C.ATTACK_THRESHOLD).cast("int"))
    return S.correctness_mark(df.withColumnRenamed("y", "expected"), "expected", "predicted").select(
        "flow_id", "expected", "predicted", "correct")


@query("SC6_quarantine", """
SELECT flow_id, raw FROM (SELECT flow_id, CASE WHEN flow_id % 97 = 0 THEN 'bad' ELSE cast(p_c AS varchar) END AS raw
FROM scores) WHERE try_cast(raw AS double) IS NULL""")
def sc6_quarantine(spark, sf_dir):
    """Rows whose score does not parse, as routed to the quarantine sink."""
    df = tables.scores(spark, sf_dir).select(
        "flow_id", F.when(F.col("flow_id") % 97 == 0, F.lit("bad")).otherwise(F.col("p_c").cast("string")).alias("raw"))
    _, bad = S.split_quarantine(S.guarded_threshold_rule(df, "raw", C.ATTACK_THRESHOLD))
    return bad.select("flow_id", "raw")
