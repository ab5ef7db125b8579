"""Queries for evaluation (EV1-EV13), voting ensembles (EN1, EN2, EN4) and AD3 on fixed scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import anomaly as AD
from flowlens.operators import ensemble as EN
from flowlens.operators import evaluate as EV
from flowlens.operators import scoring as S
from flowlens.plans.registry import query
from flowlens.sources import tables


def multiscores(spark, sf_dir):
    """Three-class truth and probabilities derived from the fixed scores."""
    s = tables.scores(spark, sf_dir)
    y3 = F.when(F.col("y") == 0, 0).when(F.col("flow_id") % 2 == 0, 1).otherwise(2)
    s = s.select("flow_id", "service", "y", "p_a", "p_b", "p_c", y3.alias("y3"),
                 (1 - F.col("p_c")).alias("p0"), (F.col("p_c") * F.col("p_a")).alias("p1"),
                 (F.col("p_c") * (1 - F.col("p_a"))).alias("p2"))
    return s.withColumn("pred3", EN.argmax(F.array("p0", "p1", "p2")))


MULTI_SQL = """m AS (
  SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred3 FROM (
    SELECT flow_id, service, y, p_a, p_b, p_c,
           CASE WHEN y = 0 THEN 0 WHEN flow_id % 2 = 0 THEN 1 ELSE 2 END AS y3,
           1 - p_c AS p0, p_c * p_a AS p1, p_c * (1 - p_a) AS p2 FROM scores) t)"""
CM_SQL = f"""WITH {MULTI_SQL},
cnt AS (SELECT y3 AS y, pred3 AS p, count(*) AS n FROM m GROUP BY 1, 2),
lab AS (SELECT DISTINCT c FROM (SELECT y AS c FROM cnt UNION SELECT p FROM cnt) u),
cm AS (SELECT a.c AS y, b.c AS p, coalesce(cnt.n, 0) AS n FROM lab a CROSS JOIN lab b
       LEFT JOIN cnt ON cnt.y = a.c AND cnt.p = b.c)
"""


def auc_sql(score: str, positive: str = "y = 1", src: str = "scores", key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    grp = f"GROUP BY {key}" if key else ""
    return f"""SELECT {k}sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {k}{score}::DOUBLE AS s, sum(CASE WHEN {positive} THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN {positive} THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY {k}s) d) c {grp}"""


@query("EV1_accuracy", "SELECT avg(CASE WHEN y = CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM scores")
def ev1(spark, sf_dir):
    df = tables.scores(spark, sf_dir).withColumn("pred", (F.col("p_c") > C.ATTACK_THRESHOLD).cast("int"))
    return EV.accuracy(df, "y", "pred")


@query("EV2_confusion_matrix", CM_SQL + "SELECT y, p, n FROM cm")
def ev2(spark, sf_dir):
    return EV.confusion_matrix(multiscores(spark, sf_dir), "y3", "pred3")


@query("EV3_normalized_confusion", CM_SQL + """
SELECT y, p, round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY y), 0), 3) AS rate FROM cm""")
def ev3(spark, sf_dir):
    return EV.normalized_confusion(EV.confusion_matrix(multiscores(spark, sf_dir), "y3", "pred3"))


@query("EV4_class_report", CM_SQL + """,
per AS (
  SELECT c, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM
    (SELECT y AS c, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1) a
    FULL JOIN (SELECT p AS c, sum(n) AS predicted FROM cm GROUP BY 1) b USING (c)),
t AS (SELECT cast(c AS varchar) AS label, coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
             coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall, support FROM per),
t2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM t)
SELECT label, precision, recall, f1, support::BIGINT AS support FROM t2
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM t2
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support)::BIGINT FROM t2""")
def ev4(spark, sf_dir):
    return EV.class_report(EV.confusion_matrix(multiscores(spark, sf_dir), "y3", "pred3"))


@query("EV5_binary_auc", " UNION ALL ".join(
    f"SELECT '{m}' AS model, * FROM ({auc_sql(m)}) x{i}" for i, m in enumerate(["p_a", "p_b", "p_c"])))
def ev5(spark, sf_dir):
    s = tables.scores(spark, sf_dir)
    long = s.select(F.col("y"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ["p_a", "p_b", "p_c"]])).alias("r"))
    return EV.auc(long.select("y", "r.*"), F.col("y") == 1, "score", ["model"])


OVR_SQL = f"""WITH {MULTI_SQL},
long AS (SELECT y3, 0 AS cls, p0 AS score FROM m UNION ALL SELECT y3, 1, p1 FROM m UNION ALL SELECT y3, 2, p2 FROM m),
per AS ({auc_sql("score", "y3 = cls", "long", "cls")}),
sup AS (SELECT y3 AS cls, count(*) AS support FROM m GROUP BY 1)
"""


@query("EV6_ovr_auc_macro", OVR_SQL + "SELECT avg(coalesce(auc, 0.0)) AS auc FROM per")
def ev6_macro(spark, sf_dir):
    return EV.ovr_auc(multiscores(spark, sf_dir), "y3", {0: "p0", 1: "p1", 2: "p2"}, "macro")


@query("EV6_ovr_auc_weighted", OVR_SQL + """
SELECT sum(coalesce(auc, 0.0) * coalesce(support, 0)) / sum(coalesce(support, 0)) AS auc FROM per LEFT JOIN sup USING (cls)""")
def ev6_weighted(spark, sf_dir):
    return EV.ovr_auc(multiscores(spark, sf_dir), "y3", {0: "p0", 1: "p1", 2: "p2"}, "weighted")


CUM_SQL = """WITH d AS (
  SELECT p_b::DOUBLE AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d)
"""


@query("EV7_roc_points", CUM_SQL + "SELECT s AS threshold, fp::DOUBLE / N AS fpr, tp::DOUBLE / P AS tpr FROM c")
def ev7(spark, sf_dir):
    return EV.roc_points(tables.scores(spark, sf_dir), F.col("y") == 1, "p_b")


@query("EV8_pr_points", CUM_SQL + "SELECT s AS threshold, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / P AS recall FROM c")
def ev8(spark, sf_dir):
    return EV.pr_points(tables.scores(spark, sf_dir), F.col("y") == 1, "p_b")


@query("EV9_false_positives", f"WITH {MULTI_SQL} SELECT flow_id, y3 AS true_label, pred3 AS predicted_label FROM m WHERE y3 = 0 AND pred3 <> 0")
def ev9_fp(spark, sf_dir):
    fp, _ = EV.false_predictions(multiscores(spark, sf_dir), "y3", "pred3")
    return fp.select("flow_id", "true_label", "predicted_label")


@query("EV9_false_negatives", f"WITH {MULTI_SQL} SELECT flow_id, y3 AS true_label, pred3 AS predicted_label FROM m WHERE y3 <> 0 AND pred3 = 0")
def ev9_fn(spark, sf_dir):
    _, fn = EV.false_predictions(multiscores(spark, sf_dir), "y3", "pred3")
    return fn.select("flow_id", "true_label", "predicted_label")


@query("EV9_top_missed", f"""WITH {MULTI_SQL}
SELECT true_label, n FROM (SELECT y3 AS true_label, count(*) AS n FROM m WHERE y3 <> 0 AND pred3 = 0 GROUP BY 1)
ORDER BY n DESC, true_label LIMIT 5""")
def ev9_top(spark, sf_dir):
    _, fn = EV.false_predictions(multiscores(spark, sf_dir), "y3", "pred3")
    return EV.top_counts(fn, "true_label", 5)


def _cmp_sql(m: str) -> str:
    return f"""SELECT '{m}' AS model, * FROM (
  WITH pr AS (SELECT y, CASE WHEN {m} > 0.5 THEN 1 ELSE 0 END AS p FROM scores),
  cnt AS (SELECT y, p, count(*) AS n FROM pr GROUP BY 1, 2),
  per AS (SELECT c, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM
    (SELECT y AS c, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM cnt GROUP BY 1) a
    FULL JOIN (SELECT p AS c, sum(n) AS predicted FROM cnt GROUP BY 1) b USING (c)),
  t AS (SELECT coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS pr, coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS rc,
               support FROM per),
  t2 AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0) AS f FROM t)
  SELECT (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)::DOUBLE FROM pr) AS accuracy,
         sum(pr * support) / sum(support) AS precision, sum(rc * support) / sum(support) AS recall,
         sum(f * support) / sum(support) AS f1, ({auc_sql(m)}) AS auc FROM t2)"""


@query("EV10_model_comparison", " UNION ALL ".join(_cmp_sql(m) for m in ["p_a", "p_b", "p_c"]))
def ev10(spark, sf_dir):
    s = tables.scores(spark, sf_dir)
    for m in ["p_a", "p_b", "p_c"]:
        s = s.withColumn(f"pred_{m}", (F.col(m) > 0.5).cast("int"))
    return EV.model_comparison(s, "y", {m: (f"pred_{m}", m) for m in ["p_a", "p_b", "p_c"]})


@query("EV11_score_histogram", """
WITH r AS (SELECT y, min(p_c) AS lo, max(p_c) AS hi FROM scores GROUP BY y)
SELECT s.y, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((p_c - lo) / (hi - lo) * 30), 29) END AS int) AS bin,
       count(*) AS n
FROM scores s JOIN r USING (y) GROUP BY 1, 2""")
def ev11(spark, sf_dir):
    return EV.score_histogram(tables.scores(spark, sf_dir), "p_c", "y", 30)


@query("EV12_grades", """
WITH a AS (
  SELECT 'p_a' AS model, avg(CASE WHEN y = CASE WHEN p_a > 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
         100.0 * avg(CASE WHEN p_a > 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS attack_rate FROM scores
  UNION ALL SELECT 'p_b', avg(CASE WHEN y = CASE WHEN p_b > 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)::DOUBLE,
         100.0 * avg(CASE WHEN p_b > 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE FROM scores
  UNION ALL SELECT 'p_c', avg(CASE WHEN y = CASE WHEN p_c > 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)::DOUBLE,
         100.0 * avg(CASE WHEN p_c > 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE FROM scores)
SELECT model, accuracy, attack_rate,
  CASE WHEN accuracy >= 0.95 THEN 'EXCELLENT' WHEN accuracy >= 0.9 THEN 'GOOD' WHEN accuracy >= 0.8 THEN 'FAIR' ELSE 'POOR' END AS grade,
  CASE WHEN attack_rate < 5 THEN 'LOW_DETECTION' WHEN attack_rate > 70 THEN 'HIGH_FALSE_POSITIVE' ELSE 'REASONABLE' END AS analysis
FROM a""")
def ev12(spark, sf_dir):
    s = tables.scores(spark, sf_dir)
    long = s.select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p"))
                                              for m in ["p_a", "p_b", "p_c"]])).alias("r")).select("y", "r.*")
    pred = (F.col("p") > 0.5).cast("int")
    agg = long.groupBy("model").agg(F.avg((F.col("y") == pred).cast("double")).alias("accuracy"),
                                    (100.0 * F.avg(pred.cast("double"))).alias("attack_rate"))
    return agg.select("model", "accuracy", "attack_rate", EV.grade(F.col("accuracy")).alias("grade"),
                      EV.rate_analysis(F.col("attack_rate")).alias("analysis"))


@query("EV13_per_type", """
SELECT service, count(*) AS total, sum(CASE WHEN y = CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END THEN 1 ELSE 0 END)::BIGINT AS correct,
  avg(CASE WHEN y = CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
  avg(CASE WHEN p_c > 0.55 THEN p_c ELSE 1 - p_c END) AS avg_confidence,
  CASE WHEN avg(CASE WHEN y = CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 'ok'
       WHEN avg(CASE WHEN y = CASE WHEN p_c > 0.55 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) >= 0.7 THEN 'warn' ELSE 'fail' END AS mark
FROM scores GROUP BY service""")
def ev13(spark, sf_dir):
    s = S.threshold_rule(tables.scores(spark, sf_dir), "p_c", C.ATTACK_THRESHOLD)
    s = s.withColumn("correct", F.col("y") == F.col("is_attack").cast("int"))
    return EV.per_type(s, "service", "correct", "confidence").withColumn("correct", F.col("correct").cast("bigint"))


# --- ensembles on fixed scores ---------------------------------------------------------------


def prob_arrays(spark, sf_dir):
    s = tables.scores(spark, sf_dir)
    return s.select("flow_id", "y", *[F.array(1 - F.col(m), F.col(m)).alias(f"prob_{m}") for m in ["p_a", "p_b", "p_c"]],
                    *[(F.col(m) > 0.5).cast("int").alias(f"pred_{m}") for m in ["p_a", "p_b", "p_c"]])


@query("EN1_soft_vote", """
SELECT flow_id, ((1 - p_a) + (1 - p_b) + (1 - p_c)) / 3 AS p_normal, (p_a + p_b + p_c) / 3 AS p_attack,
  CASE WHEN (p_a + p_b + p_c) / 3 > ((1 - p_a) + (1 - p_b) + (1 - p_c)) / 3 THEN 1 ELSE 0 END AS soft_vote
FROM scores""")
def en1(spark, sf_dir):
    out = EN.soft_vote(prob_arrays(spark, sf_dir), ["prob_p_a", "prob_p_b", "prob_p_c"])
    return out.select("flow_id", F.col("soft_vote_probs")[0].alias("p_normal"),
                      F.col("soft_vote_probs")[1].alias("p_attack"), "soft_vote")


@query("EN2_hard_vote", """
SELECT flow_id, CASE WHEN (CASE WHEN p_a > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN p_b > 0.5 THEN 1 ELSE 0 END)
                          + (CASE WHEN p_c > 0.5 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS hard_vote
FROM scores""")
def en2(spark, sf_dir):
    return EN.hard_vote(prob_arrays(spark, sf_dir), ["pred_p_a", "pred_p_b", "pred_p_c"], 2).select("flow_id", "hard_vote")


@query("EN4_weighted_vote", """
SELECT flow_id, CASE WHEN (0.4 * p_a + 0.3 * p_b + 0.3 * p_c) / 3
                        > (0.4 * (1 - p_a) + 0.3 * (1 - p_b) + 0.3 * (1 - p_c)) / 3 THEN 'Attack' ELSE 'Normal' END AS weighted_vote
FROM scores""")
def en4(spark, sf_dir):
    out = EN.weighted_vote(prob_arrays(spark, sf_dir), ["prob_p_a", "prob_p_b", "prob_p_c"], C.README_ENSEMBLE_WEIGHTS,
                           classes=["Normal", "Attack"])
    return out.select("flow_id", "weighted_vote")


@query("AD3_anomaly_decision", """
WITH o AS (SELECT quantile_cont(-p_a, 0.1) AS off FROM scores)
SELECT flow_id, -p_a - off AS decision, CASE WHEN -p_a - off < 0 THEN -1 ELSE 1 END AS prediction FROM scores CROSS JOIN o""")
def ad3(spark, sf_dir):
    out, _ = AD.decision_rule(tables.scores(spark, sf_dir).select("flow_id", "p_a"), "p_a", C.CONTAMINATION)
    return out.select("flow_id", "decision", "prediction")


@query("AD3_anomaly_count", """
WITH o AS (SELECT quantile_cont(-p_a, 0.1) AS off FROM scores)
SELECT 'p_a' AS model, cast(sum(CASE WHEN -p_a - off < 0 THEN 1 ELSE 0 END) AS bigint) AS anomaly_count FROM scores CROSS JOIN o""")
def ad3_count(spark, sf_dir):
    out, _ = AD.decision_rule(tables.scores(spark, sf_dir).select("flow_id", "p_a"), "p_a", C.CONTAMINATION)
    return AD.anomaly_counts(out.withColumn("model", F.lit("p_a")))
