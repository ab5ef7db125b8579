"""Evaluation (EV1-EV13): metric tables as distributed aggregates.

Counting happens on the scored rows (one aggregate or one small shuffle); everything
after that works on tables whose size is bounded by classes or distinct scores.  ROC /
PR curves and AUC use the exact running sums of ``operators.ranking`` instead of a
global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.functions.exprs import safe_div
from flowlens.operators.ranking import cumulative_by_value


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """EV1."""
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


MAX_LABELS = 1_000  # the confusion matrix is a full grid of labels: more than this is an error


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """EV2: (y, p, n) over the full grid of labels seen in truth or prediction (zeros kept).

    The grid is built by exploding the (class-sized) label set twice; no join of rows.
    """
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = (counts.select(F.explode(F.array("y", "p")).alias("c")).distinct()
              .agg(F.collect_set("c").alias("cs"))
              .select(F.when(F.size("cs") <= MAX_LABELS, F.col("cs")).otherwise(
                  F.raise_error(F.lit(f"more than {MAX_LABELS} labels: not a class column"))).alias("cs")))
    grid = labels.select(F.explode("cs").alias("y"), "cs").select("y", F.explode("cs").alias("p"))
    return grid.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def normalized_confusion(cm: DataFrame, digits: int = 3) -> DataFrame:
    """EV3: rows divided by the true-label total, rounded (tiny table)."""
    w = Window.partitionBy("y")
    return cm.select("y", "p", F.round(safe_div(F.col("n").cast("double"), F.sum("n").over(w)), digits).alias("rate"))


def class_report(cm: DataFrame) -> DataFrame:
    """EV4: per-class precision / recall / F1 / support + macro and weighted averages.

    Zero division -> 0 (the reporting default).  Label column is text so that the two
    average rows fit in it.
    """
    per = cm.groupBy("y").agg(F.sum("n").alias("support"),
                               F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp")) \
        .withColumnRenamed("y", "c")
    pred = cm.groupBy("p").agg(F.sum("n").alias("predicted")).withColumnRenamed("p", "c")
    t = per.join(pred, "c", "full").select(
        "c", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    t = t.select(F.col("c").cast("string").alias("label"), prec.alias("precision"), rec.alias("recall"),
                 "support")
    t = t.withColumn("f1", F.coalesce(safe_div(2 * F.col("precision") * F.col("recall"),
                                               F.col("precision") + F.col("recall")), F.lit(0.0)))
    macro = t.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.sum("support").alias("support"), F.avg("f1").alias("f1"))
    tot = F.sum("support")
    weighted = t.agg(F.lit("weighted avg").alias("label"),
                     safe_div(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                     safe_div(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                     tot.alias("support"),
                     safe_div(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"))
    return t.unionByName(macro).unionByName(weighted).select(
        "label", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))


def score_counts(df: DataFrame, positive: Column, score: str, keys: list[str] = ()) -> DataFrame:
    """(keys, s, pos, neg): positives / negatives per distinct score."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))


def auc(df: DataFrame, positive: Column, score: str, keys: list[str] = ()) -> DataFrame:
    """EV5: exact ROC-AUC with ties (rank-sum over distinct scores).  NULL when a class is absent."""
    cum = cumulative_by_value(score_counts(df, positive, score, keys), list(keys), "s", ["pos", "neg"])
    return cum.groupBy(*keys).agg(
        safe_div(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
                 F.first("pos_total") * F.first("neg_total")).alias("auc"))


def roc_points(df: DataFrame, positive: Column, score: str, keys: list[str] = (),
               max_points: int | None = None) -> DataFrame:
    """EV7: (threshold, fpr, tpr) for every distinct score, predicting positive at score >= threshold.

    ``max_points`` thins the curve: rows are grouped into that many slices of the
    cumulative row count and each slice keeps its lowest threshold (an aggregate, no sort).
    """
    cum = cumulative_by_value(score_counts(df, positive, score, keys), list(keys), "s", ["pos", "neg"])
    if max_points:
        below = F.col("pos_below") + F.col("neg_below")
        total = F.col("pos_total") + F.col("neg_total")
        cum = (cum.withColumn("__slice", F.floor(below * max_points / total))
               .groupBy(*keys, "__slice")
               .agg(F.min_by(F.struct("s", "pos_below", "neg_below", "pos_total", "neg_total"), F.col("s")).alias("p"))
               .select(*keys, "p.*"))
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    return cum.select(*keys, F.col("s").alias("threshold"), safe_div(fp, F.col("neg_total")).alias("fpr"),
                      safe_div(tp, F.col("pos_total")).alias("tpr"))


def pr_points(df: DataFrame, positive: Column, score: str, keys: list[str] = ()) -> DataFrame:
    """EV8: (threshold, precision, recall) for every distinct score."""
    cum = cumulative_by_value(score_counts(df, positive, score, keys), list(keys), "s", ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    return cum.select(*keys, F.col("s").alias("threshold"), safe_div(tp, tp + fp).alias("precision"),
                      safe_div(tp, F.col("pos_total")).alias("recall"))


def ovr_auc(df: DataFrame, y: str, prob_cols: dict, average: str = "macro") -> DataFrame:
    """EV6: one-vs-rest AUC per class and its macro or support-weighted mean.

    ``prob_cols`` maps class value -> probability column.  All classes are scored in one
    pass: rows are unpivoted to (class, score, positive) first.  A class without
    positives or negatives contributes 0 (the failure value).
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("cls"), F.col(c).cast("double").alias("score"), (F.col(y) == F.lit(k)).alias("pos"))
        for k, c in prob_cols.items()])).alias("r")).select("r.*")
    per = auc(long, F.col("pos"), "score", ["cls"]).select("cls", F.coalesce("auc", F.lit(0.0)).alias("auc"))
    support = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    t = per.join(support, "cls", "left").fillna(0, ["support"])
    if average == "weighted":
        return t.agg(safe_div(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("auc"))
    return t.agg(F.avg("auc").alias("auc"))


def false_predictions(df: DataFrame, y: str, p: str, normal=0) -> tuple[DataFrame, DataFrame]:
    """EV9: false positives (y = normal, p != normal) and false negatives, both labels kept."""
    yy, pp = F.col(y), F.col(p)
    fp = df.where((yy == F.lit(normal)) & (pp != F.lit(normal))).withColumn("true_label", yy).withColumn("predicted_label", pp)
    fn = df.where((yy != F.lit(normal)) & (pp == F.lit(normal))).withColumn("true_label", yy).withColumn("predicted_label", pp)
    return fp, fn


def top_counts(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """EV9: the k most common values (value_counts().head(k), ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col)).limit(k)


def metric_row(df: DataFrame, y: str, p: str) -> DataFrame:
    """EV10 helper: accuracy and weighted precision / recall / F1 of one model, one row."""
    return metric_rows(df.select(F.lit("").alias("model"), F.col(y).alias("y"), F.col(p).alias("p"))).drop("model")


def metric_rows(long: DataFrame) -> DataFrame:
    """(model, accuracy, precision, recall, f1) from (model, y, p) rows of any number of models.

    One count of (model, y, p); all metrics follow from that class-sized table.  Averages are
    weighted by support, zero division counts as 0.
    """
    counts = long.groupBy("model", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("c") == F.col("other"), F.col("n")).otherwise(0))
    # Each count serves its true class and its predicted class.
    sides = counts.select("model", F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("p").alias("other"), F.col("n"), F.lit(True).alias("truth")),
        F.struct(F.col("p").alias("c"), F.col("y").alias("other"), F.col("n"), F.lit(False).alias("truth")))).alias("s")).select("model", "s.*")
    per = sides.where(F.col("c").isNotNull()).groupBy("model", "c").agg(
        F.sum(F.when(F.col("truth"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("truth"), F.col("n")).otherwise(0)).alias("predicted"), (hit / 2).alias("tp"))
    prec = F.coalesce(safe_div(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(safe_div(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.select("model", "support", "tp", prec.alias("prec"), rec.alias("rec"))
    f1 = F.coalesce(safe_div(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), F.lit(0.0))
    mean = lambda x: safe_div(F.sum(x * F.col("support")), F.sum("support"))
    return per.groupBy("model").agg(
        safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"), mean(F.col("prec")).alias("precision"),
        mean(F.col("rec")).alias("recall"), mean(f1).alias("f1"))


def model_comparison(df: DataFrame, y: str, models: dict[str, tuple[str, str]]) -> DataFrame:
    """EV10: one row per model: accuracy, weighted precision / recall / F1 and AUC.

    ``models`` maps name -> (prediction column, attack-probability column).  The rows are
    unpivoted to (model, y, prediction, score) once: one count table gives the class metrics
    and one keyed running sum the AUCs of all models.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(y).alias("y"), F.col(p).alias("p"), F.col(s).cast("double").alias("s"))
        for name, (p, s) in models.items()])).alias("r")).select("r.*")
    areas = auc(long, F.col("y") == 1, "s", ["model"])
    return metric_rows(long).join(areas, "model", "left").select("model", "accuracy", "precision", "recall", "f1", "auc")


def score_histogram(df: DataFrame, score: str, cls: str, bins: int = 30) -> DataFrame:
    """EV11: equal-width histogram per class over that class's score range (last bin closed)."""
    s = F.col(score).cast("double")
    rng = df.where(s.isNotNull()).groupBy(cls).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    ranged = df.select(cls, s.alias("s")).where(F.col("s").isNotNull()).join(rng, cls)
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).cast("int")
    return ranged.groupBy(cls, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def grade(value: Column, bands: tuple = C.GRADE_ACCURACY_BANDS) -> Column:
    """EV12: EXCELLENT / GOOD / FAIR / POOR by accuracy bands."""
    return (F.when(value >= bands[0], F.lit("EXCELLENT")).when(value >= bands[1], F.lit("GOOD"))
            .when(value >= bands[2], F.lit("FAIR")).otherwise(F.lit("POOR")))


def rate_analysis(rate_pct: Column) -> Column:
    """EV12: attack-rate sanity band."""
    return (F.when(rate_pct < C.ATTACK_RATE_LOW, F.lit("LOW_DETECTION"))
            .when(rate_pct > C.ATTACK_RATE_HIGH, F.lit("HIGH_FALSE_POSITIVE")).otherwise(F.lit("REASONABLE")))


def type_symbol(acc: Column, bands: tuple = C.GRADE_TYPE_BANDS) -> Column:
    """EV12: per-type mark (ok / warn / fail)."""
    return F.when(acc >= bands[0], F.lit("ok")).when(acc >= bands[1], F.lit("warn")).otherwise(F.lit("fail"))


def per_type(df: DataFrame, type_col: str, correct: str, confidence: str) -> DataFrame:
    """EV13: per traffic type accuracy and mean confidence, with the EV12 mark."""
    out = df.groupBy(type_col).agg(F.count(F.lit(1)).alias("total"),
                                   F.sum(F.col(correct).cast("int")).alias("correct"),
                                   F.avg(F.col(correct).cast("double")).alias("accuracy"),
                                   F.avg(confidence).alias("avg_confidence"))
    return out.withColumn("mark", type_symbol(F.col("accuracy")))


def overall_grade(per_type_df: DataFrame, expected_col: str) -> DataFrame:
    """EV12: overall = mean(attack-type accuracy mean, normal-type accuracy mean), graded."""
    means = per_type_df.groupBy(expected_col).agg(F.avg("accuracy").alias("acc"))
    row = means.agg(F.avg("acc").alias("overall_accuracy"))
    return row.withColumn("grade", grade(F.col("overall_accuracy")))
