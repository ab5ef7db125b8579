"""Model invariants and streaming guarantees."""

import time

from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators import anomaly as AD
from flowlens.operators import ensemble as EN
from flowlens.operators import models as M
from flowlens.operators import split as SP
from flowlens.plans import q_models as QM
from flowlens.session import scratch_path
from flowlens.sources import tables
from flowlens.streaming import stream as ST

from paths import SF_MID, SF_SMALL


def test_forest_learns_separable_labels_and_probabilities_sum_to_one(spark):
    train, test = QM.split(spark, SF_MID)
    model = M.fit_pipeline(train, QM.FEATURES, M.random_forest("binary"), QM.LABEL, categorical=QM.CATEGORICAL)
    scored = M.score(model, test, keep=["flow_id", QM.LABEL])
    labels = M.labels_of(model)
    acc = scored.agg(F.avg((F.col(QM.LABEL) == F.col("predicted_class")).cast("double"))).first()[0]
    assert acc >= 0.9
    total = sum((F.col(f"prob_{x}") for x in labels), F.lit(0.0))
    worst = scored.agg(F.max(F.abs(total - 1.0))).first()[0]
    assert worst < 1e-9
    again = M.score(M.fit_pipeline(train, QM.FEATURES, M.random_forest("binary"), QM.LABEL,
                                   categorical=QM.CATEGORICAL), test, keep=["flow_id"])
    diff = scored.select("flow_id", "prediction").join(again.select("flow_id", F.col("prediction").alias("p2")), "flow_id")
    assert diff.where(F.col("prediction") != F.col("p2")).count() == 0      # same seed, same result


def test_ovr_probabilities_are_normalised(spark):
    train, test = QM.split(spark, SF_SMALL)
    model = M.fit_pipeline(train, QM.FEATURES, M.boosted_ovr(rounds=3, depth=2), QM.LABEL, categorical=QM.CATEGORICAL)
    scored = M.score(model, test, keep=["flow_id"])
    labels = M.labels_of(model)
    total = sum((F.col(f"prob_{x}") for x in labels), F.lit(0.0))
    assert scored.agg(F.max(F.abs(total - 1.0))).first()[0] < 1e-9


def test_stratified_split_is_exact_and_deterministic(spark):
    df = tables.scores(spark, SF_SMALL).select("flow_id", "y")
    train, test = SP.stratified_split(df, "y", "flow_id", 0.2)
    counts = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    tcounts = {r.y: r["count"] for r in test.groupBy("y").count().collect()}
    for y, n in counts.items():
        assert tcounts[y] == int(n * 0.2 + 0.5)
    assert train.count() + test.count() == df.count()
    _, test2 = SP.stratified_split(df, "y", "flow_id", 0.2)
    assert test.exceptAll(test2).count() == 0


def test_isolation_forest_flags_contamination_share_of_training_rows(spark):
    f = QM.model_frame(spark, SF_MID)
    normal = f.where(F.col(QM.LABEL) == "Normal")
    forest = AD.fit_isolation_forest(normal, QM.AD_FEATURES, "flow_id", n_trees=50)
    assert len(forest["trees"]) == 50
    scored = AD.isolation_scores(normal, forest, keep=["flow_id"])
    out, _ = AD.decision_rule(scored, "anomaly_score", C.CONTAMINATION)
    share = out.agg(F.avg((F.col("prediction") == -1).cast("double"))).first()[0]
    assert abs(share - C.CONTAMINATION) < 0.02
    bounds = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0.0 < bounds[0] <= bounds[1] < 1.0


def test_voting_rules(spark):
    df = spark.createDataFrame([([0.6, 0.4], [0.3, 0.7], [0.45, 0.55], 0, 1, 1)],
                               "a array<double>, b array<double>, c array<double>, pa int, pb int, pc int")
    assert EN.soft_vote(df, ["a", "b", "c"]).first()["soft_vote"] == 1
    assert EN.hard_vote(df, ["pa", "pb", "pc"], 2).first()["hard_vote"] == 1
    tie = spark.createDataFrame([(0, 1)], "p1 int, p2 int")
    assert EN.hard_vote(tie, ["p1", "p2"], 2).first()["hard_vote"] == 0        # tie -> lowest class
    w = EN.weighted_vote(df, ["a", "b", "c"], [0.8, 0.1, 0.1], classes=["Normal", "Attack"]).first()
    assert w["weighted_vote"] == "Normal"


def test_stream_restart_from_checkpoint_neither_loses_nor_duplicates(spark):
    src = scratch_path(spark, "restart-src")
    flows = tables.flows(spark, SF_SMALL).select("flow_id", "ts")
    flows.repartition(4).write.parquet(src)
    schema = flows.schema
    out, ck = scratch_path(spark, "restart-out"), scratch_path(spark, "restart-ck")
    q = ST.run_available_now(ST.read_stream(spark, src, schema, max_files=1), ck, out)
    rates = ST.progress_rates(q)
    assert rates["batch_id"] is not None and rates["input_rows"] is not None
    first = spark.read.parquet(out).count()
    ST.run_available_now(ST.read_stream(spark, src, schema, max_files=1), ck, out)   # restart: nothing new
    assert spark.read.parquet(out).count() == first == 1000


def test_stream_drops_rows_later_than_the_watermark(spark):
    base = "2024-01-01 00:00:00"
    on_time = spark.createDataFrame([(1, base), (2, "2024-01-01 03:00:00")], "flow_id long, ts string")
    more = spark.createDataFrame([(4, "2024-01-01 03:10:00")], "flow_id long, ts string")
    late = spark.createDataFrame([(3, "2024-01-01 00:30:00")], "flow_id long, ts string")
    src = scratch_path(spark, "late-src")
    for part in [on_time, more, late]:
        part.withColumn("ts", F.to_timestamp("ts")).withColumn("is_attack", F.lit(False)) \
            .coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)     # distinct modification times: the file source reads oldest first
    schema = spark.read.parquet(src).schema
    out, ck = scratch_path(spark, "late-out"), scratch_path(spark, "late-ck")
    # Batch 0 moves the watermark to 02:50; late rows are filtered against the previous
    # batch's watermark, so the 00:30 row in batch 2 is dropped.
    stream = ST.read_stream(spark, src, schema, max_files=1)
    ST.run_available_now(ST.hourly_live(stream), ck, mode="update", batch_fn=ST.batch_writer(out))
    got = {str(r.hour)[:19]: r.total for r in ST.latest_updates(spark, out, "hour").collect()}
    assert got.get("2024-01-01 00:00:00") == 1         # the late 00:30 row was dropped
    assert got.get("2024-01-01 03:00:00") == 2


def test_stream_model_scoring_equals_batch(spark):
    from flowlens.plans import registry

    registry.load_all()
    stream_out = registry.QUERIES["ST1_stream_model_scoring"](spark, SF_SMALL)
    model, _, _ = QM.fitted_forest(spark, SF_SMALL, "binary")
    batch = M.score(model, QM.raw_frame(spark, SF_SMALL), keep=["flow_id"])
    joined = stream_out.select("flow_id", F.col("prediction").alias("s")).join(
        batch.select("flow_id", F.col("prediction").alias("b")), "flow_id")
    assert joined.count() == 1000
    assert joined.where(F.col("s") != F.col("b")).count() == 0


def test_classes_are_those_of_the_training_rows(spark):
    model, train, _ = QM.fitted_forest(spark, SF_SMALL, "binary")
    assert model.stages[-1].numClasses == train.select(QM.LABEL).distinct().count()
    unseen = QM.raw_frame(spark, SF_SMALL).withColumn(QM.LABEL, F.lit("never seen"))
    assert M.score(model, unseen, keep=["flow_id"]).where(F.col("predicted_class").isNull()).count() == 0


def test_exact_split_is_stored_once(spark):
    train, test = QM.split(spark, SF_SMALL)
    assert "events" not in train._jdf.queryExecution().optimizedPlan().toString()
    assert train.count() + test.count() == 1000 and train.join(test, "flow_id").count() == 0


def test_stacking_keeps_a_class_of_one_row(spark):
    """The class is unknown to the models of all folds but one; the index is that of all rows."""
    from pyspark.ml.classification import LogisticRegression

    from flowlens.operators import models as M

    rows = [(i, "abc"[i % 3], float(i % 3) + (i % 7) / 100, float(i % 5)) for i in range(60)] + [(60, "aa", 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, y string, u double, v double")
    base = {"rf": lambda: M.random_forest("binary").setNumTrees(3),
            "lr": lambda: LogisticRegression(labelCol="label", featuresCol="features", maxIter=20)}
    out = M.stacking(df, df, ["u", "v"], "y", "id", base, 3).collect()
    assert len(out) == 61 and {len(r["probability"]) for r in out} == {4}
    assert sum(r["prediction"] == r["label"] for r in out) >= 55


def test_out_of_bag_votes_are_those_of_unseen_trees(spark):
    from pyspark.sql import functions as F

    from flowlens.operators import models as M

    rows = [(i, "pos" if i % 2 else "neg", float(i % 2) * 2 + (i % 11) / 10, float(i % 13)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y string, u double, v double")
    counts = df.select("id", *[M.bootstrap_count(t, "id").alias(f"n{t}") for t in range(6)]).collect()
    drawn = {r["id"]: [r[f"n{t}"] for t in range(6)] for r in counts}
    assert 0.75 < sum(map(sum, drawn.values())) / (6 * 150) < 1.25
    out = {r["id"]: r for r in M.out_of_bag(df, ["u", "v"], "y", "id", trees=6).collect()}
    assert len(out) == 150 and all(r["oob_trees"] == drawn[i].count(0) for i, r in out.items())
    assert all((r["oob_class"] is None) == (r["oob_trees"] == 0) for r in out.values())
    # One tree by hand: the rows that only it did not draw carry its own class.
    t = 2
    tree = M.random_forest("binary", weight="w", seed=M.C.SEED + t).setNumTrees(1).setBootstrap(False)
    own = df.withColumn("w", M.bootstrap_count(t, "id")).where(F.col("w") > 0)
    model = M.fit_pipeline(own, ["u", "v"], tree, "y", labels=["neg", "pos"])
    alone = [i for i in drawn if [k for k in range(6) if drawn[i][k] == 0] == [t]]
    got = {r["id"]: ["neg", "pos"][int(r["prediction"])] for r in model.transform(df).where(F.col("id").isin(alone)).collect()}
    assert alone and all(out[i]["oob_class"] == got[i] for i in alone)
    assert sum(r["oob_class"] == r["y"] for r in out.values()) >= 120
