"""The forest over blocks: Spark ML's trees where nothing is drawn, the same trees whatever the tasks."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array

from flowlens.operators import forest as FO
from flowlens.operators import models as M
from flowlens.session import ensure_python_package, scratch_path


def table(spark, n=900, few="uvw", many="abcdefgh"):
    """Labels of two numbers and two categories, with noise; weights by class."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 20, n), rng.integers(0, 15, n) / 4
    c, d = rng.choice(list(few), n), rng.choice(list(many), n)
    y = np.where((a > 11) ^ (c == few[1]), np.where(np.isin(d, list(many[1::3])), "p", "q"), np.where(b + rng.random(n) > 2, "r", "q"))
    y = np.where(rng.random(n) < 0.1, rng.choice(list("pqr"), n), y)
    ensure_python_package(spark)
    rows = [(i, float(w), float(x), str(u), str(v), str(t), {"p": 3.0, "q": 1.0, "r": 1.5}[str(t)]) for i, (w, x, u, v, t) in enumerate(zip(a, b, c, d, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, d string, y string, w double")


def fitted(df, many, monkeypatch, **params):
    monkeypatch.setattr(M, "MANY_ROWS", 0 if many else 10 ** 9)
    estimator = M.random_forest("binary", weight="w").setNumTrees(6)
    estimator._set(**params)
    return M.fit_pipeline(df, ["a", "b"], estimator, "y", categorical=["c", "d"])


def probabilities(model, df):
    return np.array([r.p for r in model.transform(df).orderBy("id").select(vector_to_array("probability").alias("p")).collect()])


@pytest.mark.parametrize("min_rows", [1, 9])
def test_a_tree_over_blocks_is_the_tree_of_spark_ml(spark, monkeypatch, min_rows):
    """Numbers with few values, a category of all subsets, one ordered by its impurity; class weights, importances."""
    df = table(spark)
    whole = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 6, "minInstancesPerNode": min_rows}
    theirs, ours = (fitted(df, many, monkeypatch, **whole) for many in (False, True))
    assert np.abs(probabilities(ours, df) - probabilities(theirs, df)).max() < 1e-9
    x, y = ours.stages[-1], theirs.stages[-1]
    assert x.totalNumNodes == y.totalNumNodes and x.numClasses == y.numClasses == 3
    assert np.abs(x.featureImportances.toArray() - y.featureImportances.toArray()).max() < 1e-9


def test_trees_are_the_same_whatever_the_tasks(spark, monkeypatch):
    """Nodes with many rows are split by sums over all tasks, the others by one task each."""
    df = table(spark)
    calls = []
    for name in ("split_heavy", "grow_light"):
        monkeypatch.setattr(FO, name, lambda *a, f=getattr(FO, name), n=name: calls.append(n) or f(*a))
    want = probabilities(fitted(df, True, monkeypatch), df)
    assert calls == ["grow_light"]
    for local, group, chunk in ((60, 10 ** 9, 3), (0, 900 * 2, 512)):
        monkeypatch.setattr(FO, "LOCAL_ROWS", local)
        monkeypatch.setattr(FO, "GROUP_ROWS", group)
        monkeypatch.setattr(FO, "CHUNK", chunk)
        assert np.array_equal(probabilities(fitted(df, True, monkeypatch), df), want)
    assert calls.count("split_heavy") > 12


def test_many_rows_are_fitted_in_blocks_and_not_row_by_row(spark, monkeypatch):
    """Nothing is kept by row and tree: the stored records of a fit are blocks, and Spark's own fit is not called."""
    df, records, store = table(spark), {}, FO.stored
    monkeypatch.setattr(FO, "stored", lambda rows, name: records.setdefault(name, store(rows, name)))
    counts = {}
    monkeypatch.setattr(FO, "dropped", lambda t: counts.update({n: r.count() for n, r in records.items() if r is t}))
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("fitted row by row"))
    model = fitted(df.coalesce(1), True, monkeypatch)
    assert counts == {"forest-rows": 900, "forest-blocks": 1}
    path = scratch_path(spark, "forest-test")
    model.write().save(path)
    assert np.array_equal(probabilities(PipelineModel.load(path), df), probabilities(model, df))
    hits = M.score(model, df, keep=["y"]).where("predicted_class = y").count()
    assert hits > 0.8 * 900 and len(model.stages[-1].trees) == 6


def test_weights_within_a_class_go_to_spark_ml(spark, monkeypatch):
    df = table(spark).withColumn("w", M.F.rand(3) + 0.1)
    fits, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    assert fitted(df, True, monkeypatch).stages[-1].getNumTrees == 6 and fits == [1]


def test_bin_edges_follow_all_rows_by_weight(spark, monkeypatch):
    """Shares of the weight end at the edges, also where tasks sum up their rows."""
    monkeypatch.setattr(FO, "SKETCH_ROWS", 500)
    monkeypatch.setattr(FO, "POINTS", 200)
    n = 4000
    rows = spark.range(n).selectExpr("array(double(id), if(id % 7 = 0, double('NaN'), double(id % 3))) x", "int(id >= 3000) y").repartition(3)
    spec = FO.Spec(2, np.array([1.0, 3.0]), {}, 5, 1, 0.0, 2, 1, None)
    first, second = FO.Forest()._edges(rows, spec)
    share = np.interp(first, [0, 3000, 4000], [0, 0.5, 1])
    assert len(first) == FO.BINS - 1 and np.abs(share - np.arange(1, FO.BINS) / FO.BINS).max() < 0.01
    assert list(second) == [0.5, 1.5]


def test_out_of_bag_trees_of_many_rows_grow_and_vote_together(spark, monkeypatch):
    """No pipeline a tree; each row gets the class for which the trees that did not draw it vote."""
    df, n = table(spark).withColumn("y", M.F.when(M.F.col("id") != 17, M.F.col("y"))), 5
    monkeypatch.setattr(M, "MANY_ROWS", 0)
    monkeypatch.setattr(M, "fit_pipeline", lambda *a, **k: pytest.fail("a fit of one tree"))
    grown, trees_of = [], FO.Forest.trees_of
    monkeypatch.setattr(FO.Forest, "trees_of", lambda self, *a: grown.append((self, trees_of(self, *a))) or grown[-1][1])
    out = {r.id: r for r in M.out_of_bag(df, ["a", "b"], "y", "id", trees=n, categorical=["c", "d"]).collect()}
    (forest, found), = grown
    unseen = {r.id: [c == 0 for c in r[1:]] for r in df.select("id", *[M.bootstrap_count(t, "id").alias(f"n{t}") for t in range(n)]).collect()}
    assert len(out) == 900 and all(r.oob_trees == sum(unseen[i]) and (r.oob_class is None) == (r.oob_trees == 0) for i, r in out.items())
    stages = M.Pipeline(stages=M.row_stages(["a", "b"], "y", categorical=["c", "d"], labels=list("pqr"))).fit(df.where("id != 17"))
    stages.stages[0].setHandleInvalid("keep")
    rows = stages.transform(df).select("id", "features")
    each = [{r.id: r.p for r in t.transform(rows).select("id", vector_to_array("probability").alias("p")).collect()}
            for t in forest._model(spark, *found).trees]
    for i, r in out.items():
        votes = sum((np.array(each[t][i]) for t in range(n) if unseen[i][t]), np.zeros(3))
        assert r.oob_class is None or votes["pqr".index(r.oob_class)] > votes.max() - 1e-9
    assert sum(r.oob_class == r.y for r in (out[i] for i in out) if r.y) > 0.6 * 900


def test_candidates_are_scored_once_and_evaluated_together(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    df, calls, score = table(spark, 300), [], M.score
    monkeypatch.setattr(M, "evaluate_scored", lambda *a: pytest.fail("a model evaluated by itself"))
    monkeypatch.setattr(M, "score", lambda *a, **k: calls.append(1) or score(*a, **k))
    lr = {f"lr{i}": LogisticRegression(labelCol="label", featuresCol="features", maxIter=5, regParam=i / 10) for i in range(2)}
    found, best, models = M.train_and_compare(df, df, ["a", "b"], "y", lr, keep=["id"])
    got = {r.model: r.accuracy for r in found.collect()}
    assert len(calls) == 2 and set(got) == set(models) == {"lr0", "lr1"} and got[best] == max(got.values())
    for name, m in models.items():
        hits = score(m, df, keep=["y"]).where("predicted_class = y").count()
        assert abs(got[name] - hits / 300) < 1e-9
