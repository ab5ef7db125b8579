"""What queries read and how they spread it, on inputs small enough for a test."""

import numpy as np
from paths import SF_SMALL
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from flowlens.functions.exprs import round_binary, round_half_up
from flowlens.operators import anomaly as AD
from flowlens.operators import features as FE
from flowlens.operators import models as M
from flowlens.plans import q_features as QF
from flowlens.plans import q_models as QM


def counted(df, rows):
    """``df`` whose rows add to the accumulator ``rows`` whenever they are read."""
    def run(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


def test_one_class_reads_its_rows_a_few_times(spark):
    """The steps read the stored slices, not the input: a scan for the moments, the slices, the margins."""
    rows = spark.sparkContext.accumulator(0)
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    model = AD.fit_one_class(counted(df, rows), ["a", "b"], "k", n_components=20, steps=10, batch_rows=200)
    assert rows.value <= 3 * 4000
    x = np.array([(r.a, r.b) for r in df.orderBy("k").collect()])
    z = np.cos(x @ np.array(model["W"]).T + model["b"]) * np.sqrt(2 / 20)
    got = AD.one_class_scores(df, model, keep=["k"]).orderBy("k").collect()
    assert [r.k for r in got] == list(range(4000))
    assert np.allclose([r.decision for r in got], z @ model["w"] - model["rho"], atol=1e-9)
    assert all(r.prediction == (-1 if r.decision < 0 else 1) for r in got)
    assert np.mean([r.prediction == -1 for r in got]) <= 0.1


def classed(spark, n=400):
    rows = [(i, "abc"[i % 3], float(i % 3) + (i % 7) / 10, float(i % 5), 1.0 + i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "k long, c string, a double, b double, w double")


def test_scans_are_spread_by_their_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "FIT_ROWS", 100)
    classed(spark).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    out = M.spread(scan)
    parts = out.rdd.glom().map(lambda rows: [r.k for r in rows]).collect()
    assert len(parts) >= 4 and max(map(len, parts)) < 200 and sorted(sum(parts, [])) == list(range(400))
    assert out.columns == scan.columns
    monkeypatch.setattr(M, "FIT_ROWS", 1000)
    assert M.spread(scan) is scan  # one task is enough


def test_the_model_frame_has_tasks_for_its_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "FIT_ROWS", 100)
    raw = QM.raw_frame(spark, SF_SMALL)
    assert raw.count() == 1000 and raw.rdd.getNumPartitions() >= 10


def test_stacking_takes_fitted_bases_and_deals_every_fit_its_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "FIT_ROWS", 100)
    df = classed(spark).coalesce(1)
    train, test = df.where("k % 5 > 0"), df.where("k % 5 = 0")
    base = {"lr": lambda: LogisticRegression(labelCol="label", featuresCol="features", maxIter=5)}
    fits, seen, tables = [], [], {}
    fit, lr_fit, store = M.fit_pipeline, LogisticRegression._fit, M.stored
    monkeypatch.setattr(M, "fit_pipeline", lambda *a, **k: fits.append(1) or fit(*a, **k))
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or lr_fit(self, rows))
    monkeypatch.setattr(M, "stored", lambda rows, name: tables.setdefault(name, store(rows, name)))
    full = {"lr": fit(train, ["a", "b"], base["lr"](), "c")}
    got = M.stacking(train, test, ["a", "b"], "c", "k", base, 2, full=full)
    assert len(fits) == 2 and min(seen) >= 2 and seen[-1] >= 4  # folds of 160 rows, the meta learner's 320
    assert len(tables["folds"].inputFiles()) >= 4
    own = M.stacking(train, test, ["a", "b"], "c", "k", base, 2)
    assert len(fits) == 5  # two folds and the refit
    prediction = lambda s: [(r.k, r.prediction) for r in s.orderBy("k").collect()]
    assert prediction(got) == prediction(own) and len(prediction(got)) == 80


def test_models_are_evaluated_together_as_one_by_one(spark):
    scored = {}
    for m, shift in (("x", 0), ("y", 1)):
        s = classed(spark).withColumn("prediction", ((F.col("k") * (7 + shift) + shift) % 3).cast("int"))
        scored[m] = s.select("c", "prediction", *[(((F.col("k") * (5 + i) + shift) % 11) / 10).alias(f"prob_{x}") for i, x in enumerate("abc")])
    both = M.evaluate_models(scored, "c", ["a", "b", "c"]).orderBy("model").collect()
    for row, (m, s) in zip(both, sorted(scored.items()), strict=True):
        alone = M.evaluate_scored(s, "c", m, ["a", "b", "c"]).first().asDict()
        assert row["model"] == m and all(abs(row[c] - alone[c]) < 1e-12 for c in ("accuracy", "precision", "recall", "f1", "auc"))


def test_feature_frames_have_tasks_for_their_rows_and_ranks_join_narrow_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "FIT_ROWS", 100)
    frame = QF.fe_frame(spark, SF_SMALL)
    assert frame.count() == 1000 and frame.rdd.getNumPartitions() >= 10
    joined, ranks = [], FE.percentile_ranks
    monkeypatch.setattr(FE, "percentile_ranks", lambda df, *a, **k: joined.append(df.columns) or ranks(df, *a, **k))
    out = FE.create_advanced_features(frame, exclude=["flow_id", "unified_label"], key="flow_id", **QF.COLUMNS)
    assert joined == [frame.columns]
    assert out.columns[:len(frame.columns)] == frame.columns and out.columns[-len(QF.STAT):] == [f"{c}_percentile" for c in QF.STAT]


def test_rounding_is_plain_arithmetic_with_the_values_of_round(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.3, -0.0, 4503599627370495.5, 9007199254740993.0, 1e300, 5e-324,
              None, float("inf"), float("nan"), *[i / 8 for i in range(-40, 40)]]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select(F.round("x").cast("string").alias("a"), round_half_up(F.col("x")).cast("string").alias("b")).collect():
        assert r.a == r.b
    plan = df.select(round_binary(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan
