"""Queries for preprocessing (PP1-PP8).  The SQL twins are generated from the column lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import labelling as LB
from flowlens.operators import preprocess as PP
from flowlens.operators import split as SP
from flowlens.operators.ranking import exact_quantiles
from flowlens.plans.q_labels import HASH_SQL, LB1_SQL
from flowlens.plans.registry import query
from flowlens.sources import tables

NUMS = ["duration", "src_bytes", "dst_bytes", "diff_srv_rate", "ttl", "flow_rate"]
STRS = ["flow_tag", "protocol_type", "flag"]
PASS = ["flow_id", "unified_label", "source_dataset"]
FLOW_STRS = ["src_ip", "protocol_type", "flag", "service", "dst_ip"]
KDD = C.default_datasets("/")["nsl_kdd_train"]


def base(spark, sf_dir):
    """Flows with a per-row text tag (always above the cardinality limit, so always dropped)."""
    f = LB.prepare_labels(tables.flows(spark, sf_dir), KDD, "nsl_kdd_train")
    f = f.withColumn("flow_tag", F.concat(F.lit("f"), F.col("flow_id").cast("string")))
    return f.select(*PASS[:1], *STRS, *NUMS, *PASS[1:])


def fin(c: str) -> str:
    return f"CASE WHEN isnan({c}::DOUBLE) OR isinf({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END"


BASE_SQL = f"""base AS (
  SELECT flow_id, concat('f', cast(flow_id AS varchar)) AS flow_tag, protocol_type, flag, {", ".join(NUMS)},
         {LB1_SQL} AS unified_label, 'nsl_kdd_train' AS source_dataset FROM flows)"""
SPLIT_SQL = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unified_label ORDER BY {HASH_SQL}, flow_id) AS rn,
         count(*) OVER (PARTITION BY unified_label) AS n_lab FROM base),
train AS (SELECT * EXCLUDE (rn, n_lab) FROM ranked WHERE rn > round(0.2 * n_lab)),
test AS (SELECT * EXCLUDE (rn, n_lab) FROM ranked WHERE rn <= round(0.2 * n_lab))"""


def prep_sql(fit: str, apply: str, scale: bool = True) -> str:
    """DuckDB twin of Preprocessor.fit(fit).transform(apply)."""
    ctes = [BASE_SQL]
    if fit != "base" or apply != "base":
        ctes.append(SPLIT_SQL)
    ctes.append("med AS (SELECT " + ", ".join(f"quantile_cont({fin(c)}, 0.5) AS {c}" for c in NUMS) + f" FROM {fit})")
    # flow_tag (one value per row) is dropped at fit; the twin keeps only the others and
    # returns no rows unless flow_tag really exceeds the cardinality limit.
    kept = []
    for c in STRS:
        ctes.append(f"""nd_{c} AS (SELECT count(DISTINCT {c}) AS nd FROM {fit})""")
        ctes.append(f"""mode_{c} AS (SELECT {c} AS v FROM {fit} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
        ctes.append(f"""cat_{c} AS (SELECT v, cast(dense_rank() OVER (ORDER BY v) - 1 AS double) AS code
                       FROM (SELECT DISTINCT {c} AS v FROM {fit} WHERE {c} IS NOT NULL) d)""")
        if c != "flow_tag":
            kept.append(c)

    def imputed(src: str) -> str:
        cols = [f"coalesce({fin(f'{src}.{c}')}, med.{c}) AS {c}" for c in NUMS]
        joins = []
        for c in kept:
            cols.append(f"coalesce(cat_{c}.code, (SELECT count(*) FROM cat_{c})::DOUBLE) AS {c}")
            joins.append(f"LEFT JOIN cat_{c} ON cat_{c}.v = coalesce({src}.{c}, (SELECT v FROM mode_{c}))")
        return (f"SELECT {src}.flow_id, {src}.unified_label, {src}.source_dataset, " + ", ".join(cols) +
                f" FROM {src} CROSS JOIN med " + " ".join(joins))

    ctes.append(f"imp_fit AS ({imputed(fit)})")
    ctes.append(f"imp_app AS ({imputed(apply)})")
    feats = NUMS + kept
    ctes.append("st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in feats) +
                " FROM imp_fit)")
    out = [f"({c} - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END) AS {c}" if scale else c
           for c in feats]
    return ("WITH " + ",\n".join(ctes) + "\nSELECT flow_id, unified_label, source_dataset, " + ", ".join(out) +
            " FROM imp_app CROSS JOIN st WHERE (SELECT nd FROM nd_flow_tag) > 100")


@query("PP1_median_impute_fit", " UNION ALL ".join(
    f"SELECT '{c}' AS column, quantile_cont({fin(c)}, 0.5) AS median FROM flows" for c in NUMS))
def pp1(spark, sf_dir):
    return exact_quantiles(tables.flows(spark, sf_dir), NUMS, [0.5]).select("column", F.col("value").alias("median"))


@query("PP2_PP3_string_fit", " UNION ALL ".join(f"""
SELECT '{c}' AS column, (SELECT count(DISTINCT {c}) FROM flows) AS n_distinct,
       (SELECT {c} FROM flows WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
       (SELECT count(DISTINCT {c}) FROM flows) > 100 AS dropped""" for c in FLOW_STRS))
def pp2_pp3(spark, sf_dir):
    st = PP.string_stats(tables.flows(spark, sf_dir), FLOW_STRS)
    return st.select("column", "n_distinct", "mode", (F.col("n_distinct") > C.HIGH_CARDINALITY).alias("dropped"))


@query("PP4_ordinal_codes", " UNION ALL ".join(f"""
SELECT '{c}' AS column, v AS value, cast(dense_rank() OVER (ORDER BY v) - 1 AS int) AS code
FROM (SELECT DISTINCT cast({c} AS varchar) AS v FROM flows WHERE {c} IS NOT NULL) d""" for c in ["protocol_type", "service", "flag"]))
def pp4(spark, sf_dir):
    return PP.category_codes(tables.flows(spark, sf_dir), ["protocol_type", "service", "flag"])


@query("PP5_unseen_category", """
WITH cat AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code
             FROM (SELECT DISTINCT protocol_type AS v FROM flows WHERE protocol_type <> 'icmp') d)
SELECT flow_id, protocol_type, coalesce(cat.code, (SELECT count(*) FROM cat))::DOUBLE AS protocol_code
FROM flows LEFT JOIN cat ON cat.v = protocol_type""")
def pp5(spark, sf_dir):
    """Fit without icmp, transform everything: icmp is unseen and gets index #categories."""
    f = tables.flows(spark, sf_dir).select("flow_id", "protocol_type")
    model = PP.Preprocessor(passthrough=["flow_id"]).fit(f.where(F.col("protocol_type") != "icmp"))
    return f.select("flow_id", "protocol_type", model.encoded("protocol_type").alias("protocol_code"))


@query("PP6_standard_scale", """
SELECT flow_id,
  (duration - avg(duration) OVER ()) / coalesce(nullif(stddev_pop(duration) OVER (), 0), 1) AS duration,
  (src_bytes - avg(src_bytes) OVER ()) / coalesce(nullif(stddev_pop(src_bytes) OVER (), 0), 1) AS src_bytes,
  (same_srv_rate - avg(same_srv_rate) OVER ()) / coalesce(nullif(stddev_pop(same_srv_rate) OVER (), 0), 1) AS same_srv_rate
FROM flows""")
def pp6(spark, sf_dir):
    f = tables.flows(spark, sf_dir).select("flow_id", "duration", "src_bytes", "same_srv_rate")
    return PP.Preprocessor(passthrough=["flow_id"]).fit(f).transform(f)


@query("PP7_preprocess_pipeline", prep_sql("base", "base"))
def pp7(spark, sf_dir):
    b = base(spark, sf_dir)
    return PP.Preprocessor(passthrough=PASS).fit(b).transform(b)


@query("PP8_fit_train_apply_test", prep_sql("train", "test"))
def pp8(spark, sf_dir):
    """Fit on the stratified train split, apply to the test split, saved feature order."""
    b = base(spark, sf_dir)
    train, test = SP.stratified_split(b, "unified_label", "flow_id", C.TEST_FRACTION)
    model = PP.Preprocessor(passthrough=PASS).fit(train)
    return model.transform(test)
