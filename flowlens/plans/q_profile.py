"""Queries for profiling aggregates (AG1-AG7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import labelling as LB
from flowlens.operators import profile as P
from flowlens.operators import union as UN
from flowlens.plans.q_labels import CIC_TYPE_SQL, KDD_TYPE_SQL, LB1_SQL, UNSW_DOS_SQL, UNSW_TYPE_SQL
from flowlens.plans.registry import query
from flowlens.sources import tables

SPECS = C.default_datasets("/")


def unified(spark, sf_dir):
    """Three labelled sources, unioned by name (modular loader shape)."""
    frames = [LB.prepare_labels(tables.flows(spark, sf_dir), SPECS["nsl_kdd_train"], "nsl_kdd_train"),
              LB.prepare_labels(tables.flows_unsw(spark, sf_dir), SPECS["unsw_train"], "unsw_train"),
              LB.prepare_labels(tables.flows_cic(spark, sf_dir), SPECS["cicids2017"], "cicids2017")]
    return UN.union_by_name([f.select("unified_label", "source_dataset") for f in frames])


UNIFIED_SQL = f"""WITH u AS (
  SELECT {LB1_SQL} AS unified_label, 'nsl_kdd_train' AS source_dataset FROM flows
  UNION ALL SELECT CASE WHEN contains(lower(trim(attack_cat)), 'normal') THEN 0 ELSE 1 END, 'unsw_train' FROM flows_unsw
  UNION ALL SELECT CASE WHEN contains(lower(trim(Label)), 'benign') THEN 0 ELSE 1 END, 'cicids2017' FROM flows_cic)
"""


@query("AG1_label_distribution", UNIFIED_SQL + """
SELECT unified_label, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM u GROUP BY 1""")
def ag1(spark, sf_dir):
    return P.distribution(unified(spark, sf_dir), "unified_label")


@query("AG2_source_distribution", UNIFIED_SQL + """
SELECT source_dataset, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM u GROUP BY 1""")
def ag2(spark, sf_dir):
    return P.distribution(unified(spark, sf_dir), "source_dataset")


@query("AG1_AG2_grouping_sets", UNIFIED_SQL + """
SELECT 'unified_label' AS column, CAST(unified_label AS VARCHAR) AS value, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
FROM u GROUP BY unified_label
UNION ALL SELECT 'source_dataset', source_dataset, count(*), CAST(sum(count(*)) OVER () AS BIGINT) FROM u GROUP BY source_dataset""")
def ag1_ag2(spark, sf_dir):
    """Labels, sources and the total of the unified set in one scan."""
    return P.distributions(unified(spark, sf_dir), ["unified_label", "source_dataset"])


@query("AG3_attack_type_distribution", f"""
WITH t AS (
  SELECT {KDD_TYPE_SQL} AS attack_type FROM flows
  UNION ALL SELECT {UNSW_TYPE_SQL.format(extra=UNSW_DOS_SQL)} FROM flows_unsw
  UNION ALL SELECT {CIC_TYPE_SQL} FROM flows_cic)
SELECT attack_type, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, attack_type""")
def ag3(spark, sf_dir):
    frames = [LB.add_attack_type(tables.flows(spark, sf_dir), "kdd", "target").select("attack_type"),
              LB.add_attack_type(tables.flows_unsw(spark, sf_dir), "unsw", "attack_cat").select("attack_type"),
              LB.add_attack_type(tables.flows_cic(spark, sf_dir), "cic", "Label").select("attack_type")]
    return P.value_counts_desc(UN.union_by_name(frames), "attack_type")


@query("AG4_top_label_values", """
WITH l AS (
  SELECT 'attack_cat' AS column, cast(attack_cat AS varchar) AS value FROM flows_unsw
  UNION ALL SELECT 'label', cast(label AS varchar) FROM flows_unsw),
c AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) t WHERE rank <= 5""")
def ag4(spark, sf_dir):
    df = tables.flows_unsw(spark, sf_dir)
    return P.top_values(df, P.label_candidates(df), 5)


@query("AG4_shape", "SELECT count(*) AS rows, 8 AS columns FROM flows_unsw")
def ag4_shape(spark, sf_dir):
    df = tables.flows_unsw(spark, sf_dir)
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


MISSING_COLS = ["flag", "duration", "diff_srv_rate", "ttl", "flow_rate", "target"]


@query("AG5_missing_values", """
SELECT 'flag' AS column, cast(count(*) - count(flag) AS bigint) AS n_missing FROM flows
UNION ALL SELECT 'duration', cast(count(*) - count(duration) AS bigint) FROM flows
UNION ALL SELECT 'diff_srv_rate', cast(count(*) - count(diff_srv_rate) AS bigint) FROM flows
UNION ALL SELECT 'ttl', cast(count(*) - count(ttl) AS bigint) FROM flows
UNION ALL SELECT 'flow_rate', cast(sum(CASE WHEN flow_rate IS NULL OR isnan(flow_rate) OR isinf(flow_rate) THEN 1 ELSE 0 END) AS bigint) FROM flows
UNION ALL SELECT 'target', cast(count(*) - count(target) AS bigint) FROM flows""")
def ag5(spark, sf_dir):
    return P.missing_counts(tables.flows(spark, sf_dir), MISSING_COLS)


STRING_COLS = ["src_ip", "dst_ip", "protocol_type", "service", "flag", "target"]


@query("AG6_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct FROM flows" for c in STRING_COLS))
def ag6(spark, sf_dir):
    return P.distinct_counts(tables.flows(spark, sf_dir), STRING_COLS)


@query("AG7_prediction_summary", """
SELECT CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM scores GROUP BY 1""")
def ag7(spark, sf_dir):
    df = tables.scores(spark, sf_dir).withColumn("prediction", F.when(F.col("p_c") > C.ATTACK_THRESHOLD, 1).otherwise(0))
    return P.value_counts_desc(df, "prediction")
