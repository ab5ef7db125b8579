"""Queries for feature engineering (FE1-FE15)."""

from __future__ import annotations


from flowlens import config as C
from flowlens.operators import features as FE
from flowlens.operators import labelling as LB
from flowlens.operators import models as M
from flowlens.operators.common import stored
from flowlens.plans.q_labels import LB1_SQL
from flowlens.plans.registry import ORACLE, query
from flowlens.sources import tables

KDD = C.default_datasets("/")["nsl_kdd_train"]
STAT = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "srv_serror_rate",
        "same_srv_rate", "diff_srv_rate", "ttl"]


def fe_frame(spark, sf_dir):
    """KDD-named flow columns (conn_count -> count) plus the binary label, in tasks for their rows."""
    events = M.spread(tables.read_table(spark, sf_dir, "events", tables.FLOW_COLUMNS))
    f = LB.prepare_labels(tables.flows(spark, sf_dir, events), KDD, "kdd").withColumnRenamed("conn_count", "count")
    return f.select("flow_id", "protocol_type", "service", "flag", *STAT, "unified_label")


FE_SQL = f"""fe AS (
  SELECT flow_id, protocol_type, service, flag, duration, src_bytes, dst_bytes, conn_count AS "count", srv_count,
         serror_rate, srv_serror_rate, same_srv_rate, diff_srv_rate, ttl, {LB1_SQL} AS unified_label FROM flows)"""


def q(c: str) -> str:
    return f'"{c}"'


# The columns of the reference's families on these frames, stated rather than cut by position.
STRINGS, BYTES = ["protocol_type", "service", "flag"], ["src_bytes", "dst_bytes"]
COLUMNS = {"stat_columns": STAT, "entropy_strings": STRINGS, "entropy_bytes": BYTES}


def engineer(spark, sf_dir, *families):
    fe = fe_frame(spark, sf_dir)
    return fe, FE.FeatureEngineer(exclude=["flow_id", "unified_label"], families=families, **COLUMNS).fit(fe)


@query("FE1_zscore", f"WITH {FE_SQL}\nSELECT flow_id, " + ", ".join(
    f"({q(c)} - avg({q(c)}) OVER ()) / nullif(stddev_samp({q(c)}) OVER (), 0) AS {c}_zscore" for c in STAT) + " FROM fe")
def fe1(spark, sf_dir):
    fe, model = engineer(spark, sf_dir, "statistical")
    return model.transform(fe, with_percentile=False).select("flow_id", *[f"{c}_zscore" for c in STAT])


@query("FE2_robust_scale", f"WITH {FE_SQL},\nst AS (SELECT " + ", ".join(
    f"quantile_cont({q(c)}, 0.25) AS {c}_q25, quantile_cont({q(c)}, 0.5) AS {c}_q50, quantile_cont({q(c)}, 0.75) AS {c}_q75"
    for c in STAT) + " FROM fe)\nSELECT flow_id, " + ", ".join(
    f"({q(c)} - {c}_q50) / nullif({c}_q75 - {c}_q25, 0) AS {c}_robust_scaled" for c in STAT) + " FROM fe CROSS JOIN st")
def fe2(spark, sf_dir):
    fe, model = engineer(spark, sf_dir, "statistical")
    return model.transform(fe, with_percentile=False).select("flow_id", *[f"{c}_robust_scaled" for c in STAT])


@query("FE3_percentile_rank", f"WITH {FE_SQL}\nSELECT flow_id, " + ", ".join(
    f"CASE WHEN {q(c)} IS NULL THEN NULL ELSE (rank() OVER (ORDER BY {q(c)}) + (count(*) OVER (PARTITION BY {q(c)}) - 1) / 2.0)"
    f" / count({q(c)}) OVER () END AS {c}_percentile" for c in STAT) + " FROM fe")
def fe3(spark, sf_dir):
    fe = fe_frame(spark, sf_dir)
    return FE.percentile_ranks(fe.select("flow_id", *STAT), STAT, key="flow_id").select(
        "flow_id", *[f"{c}_percentile" for c in STAT])


@query("FE4_FE5_time_features", f"""WITH {FE_SQL},
e AS (SELECT list_sort(list_distinct(quantile_cont(duration, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM fe)
SELECT flow_id, ln(1 + abs(duration)) AS duration_log,
  CASE WHEN duration IS NULL OR len(edges) < 2 THEN NULL
       ELSE CAST(len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda x: duration > x)) AS INTEGER) END AS duration_binned
FROM fe CROSS JOIN e""")
def fe4_fe5(spark, sf_dir):
    fe, model = engineer(spark, sf_dir, "time")
    return model.transform(fe, with_percentile=False).select("flow_id", "duration_log", "duration_binned")


@query("FE6_FE11_flow_features", f"""WITH {FE_SQL}
SELECT flow_id,
  round(src_bytes / nullif(duration + 1, 0), 6) AS bytes_per_seconds,
  round(ln(1 + "count"), 6) AS count_log, round("count" / nullif(duration + 1, 0), 6) AS count_rate,
  round(ln(1 + srv_count), 6) AS srv_count_log, round(srv_count / nullif(duration + 1, 0), 6) AS srv_count_rate,
  round((serror_rate + srv_serror_rate) / 2, 6) AS total_error_rate,
  round(src_bytes / nullif(dst_bytes + 1, 0), 6) AS bytes_ratio, src_bytes + dst_bytes AS total_bytes,
  abs(src_bytes - dst_bytes) AS bytes_diff,
  round((coalesce(same_srv_rate, 0) + coalesce(diff_srv_rate, 0))
    / nullif(CAST(same_srv_rate IS NOT NULL AS int) + CAST(diff_srv_rate IS NOT NULL AS int), 0), 6) AS service_concentration
FROM fe""")
def fe6_fe11(spark, sf_dir):
    fe, model = engineer(spark, sf_dir, "flow")
    return model.transform(fe, with_percentile=False).select(
        "flow_id", "bytes_per_seconds", "count_log", "count_rate", "srv_count_log", "srv_count_rate",
        "total_error_rate", "bytes_ratio", "total_bytes", "bytes_diff", "service_concentration")


def _cat_entropy_sql(c: str) -> str:
    return (f"SELECT '{c}_entropy' AS feature, -sum(p * log2(p + 1e-10)) AS entropy FROM "
            f"(SELECT count(*) / sum(count(*)) OVER () AS p FROM fe WHERE {c} IS NOT NULL GROUP BY {c}) t")


def _byte_entropy_sql(c: str) -> str:
    bins = " + ".join(f"CASE WHEN {c} > lo + {k} * (hi - lo) / 10 THEN 1 ELSE 0 END" for k in range(1, 10))
    return (f"SELECT '{c}_entropy' AS feature, -sum(p * log2(p + 1e-10)) AS entropy FROM "
            f"(SELECT count(*) / sum(count(*)) OVER () AS p FROM "
            f"(SELECT {bins} AS b FROM fe CROSS JOIN (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM fe) m "
            f"WHERE {c} IS NOT NULL) x GROUP BY b) t")


@query("FE12_FE13_entropy", f"WITH {FE_SQL}\n" + "\nUNION ALL\n".join(
    [_cat_entropy_sql(c) for c in ["protocol_type", "service", "flag"]] +
    [_byte_entropy_sql(c) for c in ["src_bytes", "dst_bytes"]]))
def fe12_fe13(spark, sf_dir):
    _, model = engineer(spark, sf_dir, "entropy")
    rows = sorted(model.state["entropies"].items())
    return spark.createDataFrame(rows, "feature string, entropy double")


@query("FE14_one_hot", f"""WITH {FE_SQL}
SELECT flow_id, protocol_type, flag,
  CAST(coalesce(protocol_type = 'icmp', false) AS int) AS protocol_type_icmp,
  CAST(coalesce(protocol_type = 'tcp', false) AS int) AS protocol_type_tcp,
  CAST(coalesce(protocol_type = 'udp', false) AS int) AS protocol_type_udp,
  CAST(coalesce(flag = 'S0', false) AS int) AS flag_S0,
  CAST(coalesce(flag = 'SF', false) AS int) AS flag_SF
FROM fe""")
def fe14(spark, sf_dir):
    fe = fe_frame(spark, sf_dir).select("flow_id", "protocol_type", "flag")
    return FE.one_hot(fe, ["protocol_type", "flag"])


@query("FE15_pca")
def fe15(spark, sf_dir):
    """Centred PCA of the engineered numeric columns; rows keep their flow id."""
    fe = fe_frame(spark, sf_dir)
    cols = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "same_srv_rate"]
    out, ratios = FE.pca_features(fe, cols, k=C.PCA_COMPONENTS, keep=["flow_id"])
    return out


def _all_families_sql() -> str:
    """The families' own twins joined on the flow, the entropies as constants."""
    parts = ["FE1_zscore", "FE2_robust_scale", "FE3_percentile_rank", "FE4_FE5_time_features", "FE6_FE11_flow_features"]
    joins = "\n".join(f"JOIN (SELECT * FROM ({ORACLE[n]}) t{i}) x{i} USING (flow_id)" for i, n in enumerate(parts))
    entropies = ", ".join(f"(SELECT entropy FROM ({ORACLE['FE12_FE13_entropy']}) e WHERE feature = '{c}_entropy') AS {c}_entropy"
                          for c in STRINGS + BYTES)
    return f"WITH {FE_SQL}\nSELECT *, {entropies} FROM fe\n{joins}"


@query("FE_all_families", _all_families_sql())
def fe_all(spark, sf_dir):
    """Every family on the whole frame (statistics fitted on the same frame), stored once for its passes."""
    fe = stored(fe_frame(spark, sf_dir), "flow-frame")
    return FE.create_advanced_features(fe, exclude=["flow_id", "unified_label"], key="flow_id", **COLUMNS)


@query("FE15_pca_variance")
def fe15_variance(spark, sf_dir):
    """Explained-variance ratio per component, with the total and the top-10 share."""
    fe = fe_frame(spark, sf_dir)
    cols = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "same_srv_rate"]
    _, ratios = FE.pca_features(fe, cols, k=C.PCA_COMPONENTS, keep=["flow_id"])
    summary = FE.explained_variance_summary(ratios)
    rows = [(i + 1, float(r), summary["total"], summary["top10"]) for i, r in enumerate(ratios)]
    return spark.createDataFrame(rows, "component int, ratio double, total double, top10 double")
