"""Queries for model training, scoring and model ensembles (ML1-ML7, EN3, EN5, SC1, SP3, IO8, AD1, AD2).

Model outputs cannot be matched value by value against SQL, so most of these are
rows-only checks with invariant tests in ``tests/``; the class-weight table has a twin.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import evaluate as EV
from flowlens.operators import labelling as LB
from flowlens.operators import models as M
from flowlens.operators.boosting import BoostedTrees
from flowlens.operators.common import dropped, stored
from flowlens.operators import projection as PR
from flowlens.operators import split as SP
from flowlens.operators.stages import AssembleStage, FeatureStage, PreprocessStage
from flowlens.plans.q_labels import KDD_TYPE_SQL
from flowlens.plans.registry import query
from flowlens.session import scratch_path
from flowlens.sources import tables
from flowlens.streaming import stream as ST

FEATURES = ["duration", "src_bytes", "dst_bytes", "conn_count", "srv_count", "serror_rate", "srv_serror_rate",
            "same_srv_rate", "diff_srv_rate", "ttl", "dst_port"]
CATEGORICAL = ["service"]
LABEL = "attack_type"


def raw_frame(spark, sf_dir, events=None):
    """Flows with their class as they come: the fill is part of the fitted pipeline.

    Rows that a scan has in few tasks are spread first, for every reader does much with each.
    """
    if events is None:
        events = M.spread(tables.read_table(spark, sf_dir, "events", tables.FLOW_COLUMNS))
    f = LB.add_attack_type(tables.flows(spark, sf_dir, events), "kdd", "target")
    return f.select("flow_id", "ts", "src_ip", "dst_ip", "service", *FEATURES, LABEL)


def model_frame(spark, sf_dir):
    return PR.fill_zero(raw_frame(spark, sf_dir), FEATURES)


def split(spark, sf_dir):
    """The exact split, assigned once: its rows are written to the shared folder and every
    pass of a fit reads them there instead of running the split again.  The frame is stored
    first, for the split looks at it several times."""
    frame = stored(raw_frame(spark, sf_dir), "split-frame")
    train, test = SP.stratified_split(frame, LABEL, "flow_id", C.TEST_FRACTION)
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    path = scratch_path(spark, "split")
    both.write.partitionBy("is_test").parquet(path)
    dropped(frame)
    rows = spark.read.schema(both.schema).parquet(path)
    return rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")


def fitted_forest(spark, sf_dir, preset="advanced", weighted=True):
    """Balanced class weights as in the reference's presets."""
    train, test = split(spark, sf_dir)
    weight = "weight" if weighted else None
    fit_rows = M.class_weights(train, LABEL) if weighted else train
    model = M.fit_pipeline(fit_rows, FEATURES, M.random_forest(preset, weight=weight), LABEL, categorical=CATEGORICAL)
    return model, train, test


@query("ML1_random_forest")
def ml1(spark, sf_dir):
    """Forest (200 trees, depth 15, sqrt features) fitted on the train split, test split scored."""
    model, _, test = fitted_forest(spark, sf_dir, "advanced")
    return M.score(model, test, keep=["flow_id", LABEL])


@query("ML2_boosted_one_vs_rest")
def ml2(spark, sf_dir):
    """One-vs-rest gradient boosting (100 rounds, depth 5, rate 0.1), probabilities normalised."""
    train, test = split(spark, sf_dir)
    model = M.fit_pipeline(train, FEATURES, M.boosted_ovr(), LABEL, categorical=CATEGORICAL)
    return M.score(model, test, keep=["flow_id", LABEL])


@query("ML2_boosted_multinomial")
def ml2_multinomial(spark, sf_dir):
    """Boosted trees under one softmax over all classes (100 rounds, depth 5, rate 0.1), test rows scored."""
    train, test = split(spark, sf_dir)
    model = M.fit_pipeline(train, FEATURES, BoostedTrees(), LABEL, categorical=CATEGORICAL)
    return M.score(model, test, keep=["flow_id", LABEL])


@query("ML2_boosted_rows", f"""
WITH t AS (SELECT {KDD_TYPE_SQL} AS label FROM flows), c AS (SELECT count(*) AS n FROM t GROUP BY label)
SELECT CAST(sum(round(0.2 * n)) AS BIGINT) AS test_rows, CAST(sum(round(0.2 * n)) AS BIGINT) AS scored_once, true AS beats_majority,
       true AS saved_alike FROM c""")
def ml2_rows(spark, sf_dir):
    """What the data fix of a boosted fit: every test row scored once, probabilities that sum to one,
    more hits than the commonest class has, the same scores after a reload."""
    train, test = split(spark, sf_dir)
    model = M.fit_pipeline(train, FEATURES, BoostedTrees(rounds=5, depth=3), LABEL, categorical=CATEGORICAL)
    again = M.load_model(M.save_model(model, scratch_path(spark, "boosted-model")))
    names = F.array(*[F.lit(x) for x in M.labels_of(model)])
    s = M.chain_probabilities({"a": model, "b": again}, test)
    guess = names[(F.array_position("p_a", F.array_max("p_a")) - 1).cast("int")]
    major = test.groupBy(LABEL).count().agg(F.max("count")).first()[0] or 0
    return s.agg(F.count("*").alias("test_rows"),
                 F.sum((F.abs(F.aggregate("p_a", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).cast("bigint")).alias("scored_once"),
                 (F.sum((guess == F.col(LABEL)).cast("bigint")) >= major).alias("beats_majority"),
                 F.every(F.col("p_a") == F.col("p_b")).alias("saved_alike"))


@query("ML3_class_weights", f"""
WITH t AS (SELECT {KDD_TYPE_SQL} AS attack_type FROM flows),
c AS (SELECT attack_type, count(*) AS n FROM t GROUP BY 1)
SELECT attack_type, n, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight FROM c""")
def ml3(spark, sf_dir):
    w = M.class_weights(model_frame(spark, sf_dir), LABEL)
    return w.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))


@query("ML4_out_of_bag_score")
def ml4(spark, sf_dir):
    """Accuracy over all training rows, each voted by the trees whose bootstrap sample left it out."""
    train, _ = split(spark, sf_dir)
    s = M.out_of_bag(train, FEATURES, LABEL, "flow_id", categorical=CATEGORICAL)
    return s.agg(F.avg((F.col(LABEL) == F.col("oob_class")).cast("double")).alias("oob_score"),
                 F.count("oob_class").alias("rows"))


@query("ML5_feature_importances")
def ml5(spark, sf_dir):
    model, _, _ = fitted_forest(spark, sf_dir, "advanced")
    top = M.feature_importances(model, top=10)
    return spark.createDataFrame(top, "feature string, importance double")


@query("ML6_model_selection")
def ml6(spark, sf_dir):
    """Balanced forest against gradient boosting and logistic regression on the same split; best by accuracy."""
    train, test = split(spark, sf_dir)
    table, best, _ = M.train_and_compare(
        M.class_weights(train, LABEL), test, FEATURES, LABEL,
        {"random_forest": M.random_forest("advanced", weight="weight"), "gradient_boosting": BoostedTrees(rounds=20),
         "logistic_regression": LogisticRegression(labelCol="label", featuresCol="features", maxIter=100)},
        categorical=CATEGORICAL, keep=["flow_id"])
    return table.withColumn("best", F.col("model") == F.lit(best))


@query("ML7_logistic_balanced")
def ml7(spark, sf_dir):
    train, test = split(spark, sf_dir)
    train = M.class_weights(train, LABEL)
    lr = LogisticRegression(labelCol="label", featuresCol="features", maxIter=1000, weightCol="weight")
    model = M.fit_pipeline(train, FEATURES, lr, LABEL, categorical=CATEGORICAL)
    return M.score(model, test, keep=["flow_id", LABEL])


@query("EN3_stacking")
def en3(spark, sf_dir):
    """Out-of-fold forest + logistic probabilities -> balanced logistic meta learner."""
    train, test = split(spark, sf_dir)
    base = {"rf": lambda: M.random_forest("binary"),
            "lr": lambda: LogisticRegression(labelCol="label", featuresCol="features", maxIter=100)}
    out = M.stacking(train, test, FEATURES, LABEL, "flow_id", base, C.CV_FOLDS, categorical=CATEGORICAL)
    return out.select("flow_id", LABEL, F.col("prediction").cast("int").alias("prediction"))


def ensemble_scores(spark, sf_dir):
    """(labels, {model: scored test rows}) of the base models, their soft vote, their weighted vote
    (by training accuracy) and their stack; base models and votes come from one pass."""
    train, test = split(spark, sf_dir)
    lr = LogisticRegression(labelCol="label", featuresCol="features", maxIter=100)
    models = {"random_forest": M.fit_pipeline(train, FEATURES, M.random_forest("binary"), LABEL, categorical=CATEGORICAL),
              "logistic_regression": M.fit_pipeline(train, FEATURES, lr, LABEL, categorical=CATEGORICAL)}
    full = {"rf": models["random_forest"], "lr": models["logistic_regression"]}  # the stack's bases on all rows
    labels = M.labels_of(models["random_forest"])
    names = [f"p_{m}" for m in models]
    hit = lambda p: F.col(LABEL) == F.array(*[F.lit(x) for x in labels])[
        (F.array_position(F.col(p), F.array_max(p)) - 1).cast("int")]
    trained = M.chain_probabilities(models, train).agg(*[F.avg(hit(p).cast("double")).alias(p) for p in names]).first()
    scored = stored(M.chain_probabilities(models, test).select(LABEL, *names), "en5-scored")
    total = sum(trained[p] for p in names)
    mixes = {m: [float(p == f"p_{m}") for p in names] for m in models}
    mixes["soft_vote"] = [1.0 / len(names)] * len(names)
    mixes["weighted_vote"] = [trained[p] / total for p in names]

    def frame(rows, p):
        return rows.select(LABEL, (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("prediction"),
                           *[F.col(p)[i].alias(f"prob_{x}") for i, x in enumerate(labels)])

    out = {}
    for name, weights in mixes.items():
        mean = [sum((F.col(p)[i] * w for p, w in zip(names, weights)), F.lit(0.0)) for i in range(len(labels))]
        out[name] = frame(scored.select(LABEL, F.array(*mean).alias("__p")), "__p")
    base = {"rf": lambda: M.random_forest("binary"),
            "lr": lambda: LogisticRegression(labelCol="label", featuresCol="features", maxIter=100)}
    stack = M.stacking(train, test, FEATURES, LABEL, "flow_id", base, 2, categorical=CATEGORICAL, full=full)
    out["stacking"] = frame(stored(stack.select(LABEL, vector_to_array("probability").alias("__p")), "en5-stack"), "__p")
    return labels, out


@query("EN5_ensemble_evaluation")
def en5(spark, sf_dir):
    """Accuracy / weighted F1 / AUC of the base models, the votes and the stack."""
    labels, scored = ensemble_scores(spark, sf_dir)
    return M.evaluate_models(scored, LABEL, labels)


@query("EN5_class_report", f"""
WITH t AS (SELECT {KDD_TYPE_SQL} AS label, flow_id FROM flows),
r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', cast(flow_id AS varchar))), flow_id) AS i,
             count(*) OVER (PARTITION BY label) AS n FROM t),
s AS (SELECT label, count(*) AS support FROM r WHERE i <= round(0.2 * n) GROUP BY 1)
SELECT m.model, s.label, s.support, true AS valid FROM s, (VALUES ('soft_vote'), ('stacking')) m(model)""")
def en5_report(spark, sf_dir):
    """Per-class report of the soft vote and the stack: the supports are the test split's, the
    metrics lie between 0 and 1 and agree with each other."""
    labels, scored = ensemble_scores(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in labels])
    out = []
    for model in ("soft_vote", "stacking"):
        s = scored[model].select(F.col(LABEL).alias("y"), F.get(names, F.col("prediction")).alias("p"))
        rep = EV.class_report(EV.confusion_matrix(s, "y", "p")).where(~F.col("label").endswith(" avg") & (F.col("support") > 0))
        f1 = F.col("f1") * (F.col("precision") + F.col("recall"))
        valid = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & (F.abs(f1 - 2 * F.col("precision") * F.col("recall")) < 1e-9)
        out.append(rep.select(F.lit(model).alias("model"), "label", "support", valid.alias("valid")))
    return out[0].unionByName(out[1])


@query("ML_split_rows", f"""
WITH t AS (SELECT {KDD_TYPE_SQL} AS label, flow_id FROM flows),
c AS (SELECT label, count(*) AS n FROM t GROUP BY 1)
SELECT label, CAST(round(0.2 * n) AS BIGINT) AS test_rows, CAST(round(0.2 * n) AS BIGINT) AS scored_once,
       CAST(n - round(0.2 * n) AS BIGINT) AS oob_rows FROM c""")
def ml_split_rows(spark, sf_dir):
    """What the data fix of ML1, ML4 and ML7: the scored test rows of each label with probabilities that
    sum to one, and the training rows that out-of-bag trees vote on."""
    train, test = split(spark, sf_dir)
    model = M.fit_pipeline(M.class_weights(train, LABEL), FEATURES, M.random_forest("binary", weight="weight"), LABEL, categorical=CATEGORICAL)
    total = sum((F.col(f"prob_{x}") for x in M.labels_of(model)), F.lit(0.0))
    scored = M.score(model, test, keep=["flow_id", LABEL]).groupBy(F.col(LABEL).alias("label")).agg(
        F.count("flow_id").alias("test_rows"), F.sum((F.abs(total - 1) < 1e-9).cast("bigint")).alias("scored_once"))
    oob = M.out_of_bag(train, FEATURES, LABEL, "flow_id", trees=24, categorical=CATEGORICAL)
    voted = oob.groupBy(F.col(LABEL).alias("label")).agg(F.count("oob_class").alias("oob_rows"))
    return voted.join(scored, "label", "left").select(  # a class of one row has no test row
        "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("test_rows", "scored_once")], "oob_rows")


@query("SC1_batch_scoring")
def sc1(spark, sf_dir):
    """Score every flow with a forest fitted on the train split."""
    model, _, _ = fitted_forest(spark, sf_dir, "binary")
    return M.score(model, raw_frame(spark, sf_dir), keep=["flow_id"])


@query("SC1_scored_rows", f"""
SELECT count(*) AS n_rows, count(*) AS n_sum_to_one, (SELECT count(DISTINCT {KDD_TYPE_SQL}) FROM flows) AS n_classes
FROM flows""")
def sc1_rows(spark, sf_dir):
    """What the data fix of a scoring run: every flow scored once, probabilities that sum to one,
    as many classes as labels."""
    model, _, _ = fitted_forest(spark, sf_dir, "binary")
    s = M.score(model, raw_frame(spark, sf_dir), keep=["flow_id"])
    total = sum((F.col(f"prob_{x}") for x in M.labels_of(model)), F.lit(0.0))
    return s.agg(F.count("flow_id").alias("n_rows"),
                 F.sum((F.abs(total - 1) < 1e-9).cast("bigint")).alias("n_sum_to_one"),
                 F.lit(model.stages[-1].numClasses).cast("bigint").alias("n_classes"))


@query("SP3_cross_validation")
def sp3_cv(spark, sf_dir):
    res = M.cross_val_scores(raw_frame(spark, sf_dir), FEATURES, lambda: M.random_forest("binary"), LABEL,
                             "flow_id", C.CV_FOLDS, categorical=CATEGORICAL)
    rows = [(i, float(s)) for i, s in enumerate(res["scores"])]
    return spark.createDataFrame(rows, "fold int, accuracy double").withColumn(
        "mean", F.lit(res["mean"])).withColumn("pm2std", F.lit(res["pm2std"]))


@query("IO8_model_persistence")
def io8(spark, sf_dir):
    """Save the fitted pipeline to the shared folder, load it back, score the test split."""
    model, _, test = fitted_forest(spark, sf_dir, "binary")
    path = M.save_model(model, scratch_path(spark, "rf-model"))
    return M.score(M.load_model(path), test, keep=["flow_id", LABEL])


@query("IO8_reload_mismatches", "SELECT 0 AS mismatches, count(*) AS n_rows FROM flows")
def io8_mismatches(spark, sf_dir):
    """Rows that a reloaded pipeline scores otherwise than the fitted one."""
    model, _, _ = fitted_forest(spark, sf_dir, "binary")
    again = M.load_model(M.save_model(model, scratch_path(spark, "rf-model")))
    s = M.chain_probabilities({"a": model, "b": again}, raw_frame(spark, sf_dir))
    return s.agg(F.sum((F.col("p_a") != F.col("p_b")).cast("int")).cast("int").alias("mismatches"),
                 F.count("*").alias("n_rows"))


ENGINEERED = ["duration", "src_bytes", "dst_bytes", "conn_count", "serror_rate", "srv_serror_rate", "same_srv_rate", "diff_srv_rate"]
KEPT = ["flow_id", "ts", "src_ip", "dst_ip", LABEL]


def whole_pipeline(train):
    """Features (FE6-FE13), preprocessing (PP1-PP7), label index and forest as one saved object."""
    stages = [FeatureStage(exclude=KEPT, stat_columns=ENGINEERED, entropy_strings=["service"], entropy_bytes=["src_bytes"]),
              PreprocessStage(passthrough=KEPT),
              StringIndexer(inputCol=LABEL, outputCol="label", stringOrderType="alphabetAsc"),
              AssembleStage(passthrough=[*KEPT, "label"]),
              M.random_forest("binary").setNumTrees(20)]
    model = M.fit_stages(stages, train)
    model.stages[2].setHandleInvalid("keep")
    return model


@query("IO8_whole_pipeline", "SELECT count(*) AS n_rows, 0 AS reload_mismatches, 0 AS stream_mismatches FROM flows")
def io8_whole(spark, sf_dir):
    """One pipeline of features, preprocessing and model: raw flows scored as fitted, after a reload,
    and by the reloaded pipeline on the flow stream."""
    train, _ = split(spark, sf_dir)
    model = whole_pipeline(train)
    again = M.load_model(M.save_model(model, scratch_path(spark, "whole-model")))

    def scored(m, rows, out):
        return m.transform(rows).select("flow_id", vector_to_array("probability").alias(out))

    raw = raw_frame(spark, sf_dir)
    out, ck = scratch_path(spark, "io8w-out"), scratch_path(spark, "io8w-ck")
    ST.run_available_now(scored(again, raw_frame(spark, sf_dir, tables.event_stream(spark, sf_dir)), "s"), ck, out)
    both = (scored(model, raw, "a").join(scored(again, raw, "b"), "flow_id", "full")
            .join(spark.read.parquet(out), "flow_id", "full"))
    differs = lambda c: F.sum((~F.col("a").eqNullSafe(F.col(c))).cast("int")).cast("int")
    return both.agg(F.count("*").alias("n_rows"), differs("b").alias("reload_mismatches"), differs("s").alias("stream_mismatches"))


AD_FEATURES = ["duration", "src_bytes", "dst_bytes", "conn_count", "srv_count", "serror_rate", "same_srv_rate"]


@query("AD1_isolation_forest")
def ad1(spark, sf_dir):
    """Fit 100 trees of 256 sampled normal rows, score every flow, flag the 10 % most isolated."""
    from flowlens.operators import anomaly as AD

    f = model_frame(spark, sf_dir)
    forest = AD.fit_isolation_forest(f.where(F.col(LABEL) == "Normal"), AD_FEATURES, "flow_id")
    scored = stored(AD.isolation_scores(f, forest, keep=["flow_id", LABEL]), "isolation-scores")
    # Offset fitted on the training (normal) rows, applied to every row.
    _, offset = AD.decision_rule(scored.where(F.col(LABEL) == "Normal"), "anomaly_score", C.CONTAMINATION)
    out, _ = AD.decision_rule(scored, "anomaly_score", C.CONTAMINATION, offset=offset)
    return out


@query("AD2_one_class")
def ad2(spark, sf_dir):
    """Random-Fourier-feature one-class model fitted on normal rows, every flow scored."""
    from flowlens.operators import anomaly as AD

    f = model_frame(spark, sf_dir)
    model = AD.fit_one_class(f.where(F.col(LABEL) == "Normal"), AD_FEATURES, "flow_id")
    return AD.one_class_scores(f, model, keep=["flow_id", LABEL])


@query("AD2_flagged_share", f"""
SELECT count(*) AS train_rows, true AS near_nu FROM flows WHERE {KDD_TYPE_SQL} = 'Normal'""")
def ad2_share(spark, sf_dir):
    """The share of the training rows that the one-class model flags is nu, to a tenth of a per cent."""
    from flowlens.operators import anomaly as AD

    normal = model_frame(spark, sf_dir).where(F.col(LABEL) == "Normal")
    scores = AD.one_class_scores(normal, AD.fit_one_class(normal, AD_FEATURES, "flow_id"), keep=["flow_id"])
    flagged = F.avg((F.col("prediction") == -1).cast("double"))
    return scores.agg(F.count("flow_id").alias("train_rows"), (F.abs(flagged - C.CONTAMINATION) <= 0.001 + 1 / F.count("flow_id")).alias("near_nu"))
