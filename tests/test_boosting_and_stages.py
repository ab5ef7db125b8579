"""Multinomial boosting against a plain recount, and pipelines with stages of our own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import boosting as B
from flowlens.operators.stages import AssembleStage, FeatureStage, PreprocessStage
from flowlens.session import ensure_python_package, scratch_path


def table(spark, n=400, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 0] > 0.5) * (classes - 2)
    pdf = pd.DataFrame({"id": range(n), "x": x.tolist(), "label": y.astype(float), "w": rng.uniform(0.5, 2, n)})
    ensure_python_package(spark)
    return x, y, pdf, spark.createDataFrame(pdf).withColumn("features", array_to_vector("x"))


def recount(bins, y, w, prior, rounds, depth, rate, min_rows):
    """The same trees by loops over rows."""
    k = prior.size
    margin = np.tile(prior, (len(y), 1))
    for _ in range(rounds):
        p = B.softmax(margin)
        g = np.rint(((np.arange(k) == y[:, None]) - p) * w[:, None] * B.UNIT) / B.UNIT
        h = np.rint(p * (1 - p) * w[:, None] * B.UNIT) / B.UNIT
        change = np.zeros_like(margin)
        for c in range(k):
            def grow(rows, left):
                G, H = g[rows, c].sum(), h[rows, c].sum()
                best = (1e-9, None)
                if left:
                    for f in range(bins.shape[1]):
                        for b in range(B.BINS):
                            a, z = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                            if len(a) < min_rows or len(z) < min_rows:
                                continue
                            s = lambda r: g[r, c].sum() ** 2 / (h[r, c].sum() + B.RIDGE)
                            gain = s(a) + s(z) - G ** 2 / (H + B.RIDGE)
                            if gain > best[0] + 1e-12:
                                best = (gain, (a, z))
                if best[1] is None:
                    change[rows, c] = rate * (k - 1) / k * G / (H + B.RIDGE)
                else:
                    for part in best[1]:
                        grow(part, left - 1)
            grow(np.arange(len(y)), depth)
        margin += change
    return B.softmax(margin)


def test_boosting_equals_a_recount_by_loops(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 2)       # margins are stored in between
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    x, y, pdf, df = table(spark)
    model = B.BoostedTrees(weight="w", rounds=5, depth=2, rate=0.3, min_rows=5).fit(df.repartition(5))
    got = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}
    s = model._fitted()
    bins = B.binned(x, [np.array(e) for e in s["edges"]])
    want = recount(bins, y, pdf.w.to_numpy(), np.array(s["prior"]), 5, 2, 0.3, 5)
    assert np.abs(np.array([got[i] for i in range(len(y))]) - want).max() < 1e-9
    other = B.BoostedTrees(weight="w", rounds=5, depth=2, rate=0.3, min_rows=5).fit(df.repartition(2))
    assert other._fitted()["leaf"] == s["leaf"]  # whatever the partitions


def test_boosting_learns_and_reports_importances(spark):
    _, y, _, df = table(spark)
    model = B.BoostedTrees(rounds=15, depth=3).fit(df)
    hit = model.transform(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert hit > 0.95
    imp = model.featureImportances.toArray()
    assert abs(imp.sum() - 1) < 1e-9 and imp[:2].sum() > 0.9 and model.numClasses == 3


@pytest.mark.parametrize("case", ["one class", "nulls", "constant"])
def test_boosting_edge_cases(spark, case):
    _, _, _, df = table(spark, 60)
    if case == "one class":
        df = df.withColumn("label", F.lit(0.0))
    elif case == "nulls":
        df = df.withColumn("label", F.when(F.col("id") % 3 > 0, F.col("label")))
        df = df.withColumn("features", array_to_vector(F.array(F.when(F.col("id") == 1, float("nan")).otherwise(F.col("x")[0]), F.col("x")[1])))
    else:
        df = df.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    df = df.withColumn("probability_of", F.lit(1)).withColumn("bins", F.lit("x"))
    out = B.BoostedTrees(rounds=2, depth=2).fit(df).transform(df)
    worst = out.agg(F.max(F.abs(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b) - 1))).first()[0]
    assert worst < 1e-9 and out.count() == 60


def test_boosting_passes_read_blocks_and_the_smaller_child(spark, monkeypatch):
    records, summed = [], []
    keep, sums = B.stored, B.level_sums

    def counting(df, name):
        out = keep(df, name)
        records.append(out.count())
        return out

    def watched(rows, recent, growing, level, counted, *rest):
        out = sums(rows, recent, growing, level, counted, *rest)
        summed.append((level, out[2, :, :, 0].sum()))
        return out

    monkeypatch.setattr(B, "stored", counting)
    monkeypatch.setattr(B, "level_sums", watched)
    _, _, _, df = table(spark)
    B.BoostedTrees(rounds=3, depth=3).fit(df.coalesce(2))
    assert max(records) <= 2                                             # not a record a row
    assert all(n <= 400 * 3 / (2 if level else 1) for level, n in summed)  # at most half the rows of each class


def test_boosting_without_rows_is_an_error(spark):
    _, _, _, df = table(spark, 10)
    with pytest.raises(ValueError):
        B.BoostedTrees().fit(df.where("id < 0"))


def test_pipeline_with_own_stages_survives_a_reload(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(200), "duration": rng.exponential(size=200), "src_bytes": rng.integers(0, 999, 200).astype(float),
                        "proto": rng.choice(["tcp", "udp"], 200), "tag": [f"t{i}" for i in range(200)]})
    pdf.loc[::7, "duration"] = np.nan
    pdf["label"] = (pdf.src_bytes > 400).astype(float)
    df = spark.createDataFrame(pdf)
    ensure_python_package(spark)
    keep = ["id", "label"]
    stages = [FeatureStage(exclude=keep, stat_columns=["src_bytes"]), PreprocessStage(passthrough=keep), AssembleStage(passthrough=keep),
              B.BoostedTrees(rounds=3, depth=2)]
    model = Pipeline(stages=stages).fit(df)
    assert "tag" not in model.stages[1].feature_order and "bytes_per_seconds" in model.stages[1].feature_order
    path = scratch_path(spark, "own-stages")
    model.write().save(path)
    again = PipelineModel.load(path)
    cols = ["id", vector_to_array("probability").alias("p"), "prediction"]
    a, b = (m.transform(df).select(*cols).toPandas().sort_values("id").reset_index(drop=True) for m in (model, again))
    assert a.id.equals(b.id) and all(x == y for x, y in zip(a.p.map(list), b.p.map(list)))
    assert (a.prediction == pdf.label).mean() > 0.95
    unseen = df.withColumn("proto", F.lit("icmp")).withColumn("src_bytes", F.lit(None).cast("double"))
    assert again.transform(unseen).count() == 200


def test_rows_of_a_fit_are_dealt_by_their_number(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from flowlens.operators import models as M

    monkeypatch.setattr(M, "FIT_ROWS", 100)
    _, _, pdf, _ = table(spark)
    df = spark.createDataFrame(pdf.drop(columns="x").assign(a=pdf.x.str[0], b=pdf.x.str[1], c=pdf.label.astype(int).astype(str)))
    df = df.drop("label").coalesce(1)  # a scan of one file
    parts = M.dealt(df, ["id", "w"]).rdd.glom().map(lambda rows: [r.id for r in rows]).collect()
    assert len(parts) >= 4 and max(map(len, parts)) < 200 and sorted(sum(parts, [])) == list(range(400))
    assert parts == M.dealt(df, ["id", "w"]).rdd.glom().map(lambda rows: [r.id for r in rows]).collect()
    seen, fit = [], RandomForestClassifier._fit

    def watched(self, rows):
        seen.append((rows.rdd.getNumPartitions(), sorted(rows.columns)))
        return fit(self, rows)

    monkeypatch.setattr(RandomForestClassifier, "_fit", watched)
    forest = M.fit_pipeline(df, ["a", "b"], M.random_forest("binary", weight="w").setNumTrees(5), "c")
    assert seen == [(len(parts), ["features", "label", "w"])]
    assert M.score(forest, df, keep=["id"]).count() == 400 and forest.stages[-1].numClasses == 3
    boosted = M.fit_pipeline(df, ["a", "b"], M.boosted_ovr(rounds=1, depth=2), "c")
    assert M.score(boosted, df, keep=["id"]).count() == 400


def test_one_vs_rest_is_the_model_of_spark_ml_in_shared_passes(spark, monkeypatch):
    """The margins of Spark's OneVsRest over GBTClassifier, rare values and categories included; every
    pass serves all classes."""
    import numpy as np
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.functions import vector_to_array

    from flowlens.operators import boosting as B
    from flowlens.operators import models as M

    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 12, 600), rng.integers(0, 9, 600) / 8, rng.choice(list("uvwxyz"), 600, p=[.5, .2, .15, .1, .04, .01])
    label = np.where(np.isin(c, ["v", "x"]) ^ (rng.random(600) < .1), np.where(a > 6, "p", "q"), np.where(b + rng.random(600) > .9, "r", "s"))
    df = spark.createDataFrame([(i, float(x), float(y), str(z), str(t)) for i, (x, y, z, t) in enumerate(zip(a, b, c, label))],
                               "id long, a double, b double, c string, t string")
    passes, sums = [], B.level_sums
    monkeypatch.setattr(B, "level_sums", lambda *x: passes.append(1) or sums(*x))
    ours = M.fit_pipeline(df, ["a", "b"], M.boosted_ovr(rounds=5, depth=3), "t", categorical=["c"])
    assert 5 <= len(passes) <= 5 * 3  # four classes
    gbt = GBTClassifier(featuresCol="features", maxIter=5, maxDepth=3, stepSize=0.1)
    theirs = M.fit_pipeline(df, ["a", "b"], OneVsRest(classifier=gbt, labelCol="label", featuresCol="features"), "t", categorical=["c"])
    x, y = (np.array([r.m for r in m.transform(df).orderBy("id").select(vector_to_array("rawPrediction").alias("m")).collect()])
            for m in (ours, theirs))
    assert x.shape == (600, 4) and np.abs(x - y).max() < 1e-4
    assert M.score(ours, df, keep=["id"]).count() == 600
