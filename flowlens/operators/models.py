"""Model training, scoring and model-level ensembles on Spark ML (ML1-ML7, EN3, EN5, SC1, SP3, IO8).

Features are assembled once with ``VectorAssembler``; every estimator is a Spark ML
stage, so fitting and scoring run on the executors and a fitted pipeline scores
batches and streams alike (every stage is row-local at transform time).
"""

from __future__ import annotations

import logging
import math
import time
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.functions.exprs import quote, safe_div
from flowlens.operators import evaluate as EV
from flowlens.operators.boosting import ONE_VS_REST, BoostedTrees
from flowlens.operators.common import dropped, stored
from flowlens.operators.forest import Forest, unseen_votes
from flowlens.operators.split import assign_folds

log = logging.getLogger(__name__)

# Independent fits run one after another by default: a fit over large data already uses the
# whole cluster, and on one machine concurrent fits only contend for the same cores
# (measured: stacking 87 s sequential vs 112 s with 4 concurrent fits at sf0.01, local[8]).
# Raise it when many small fits meet a large, idle cluster.
FIT_PARALLELISM = 1

TASK_ROWS = 5_000   # rows worth a task of their own in a fit
FIT_ROWS = 100_000  # rows that one task of a fit gets at most, about
MANY_ROWS = 200_000  # from so many on a forest is grown over blocks (see ``forest``)

MAX_CLASSES = 10_000  # a label with more values than this is no class label: an error


def parallel_fits(fn, items: list, parallelism: int | None = None) -> list:
    """Run independent fits, optionally concurrently (as CrossValidator(parallelism=...) does):
    each thread submits its own Spark jobs and the scheduler interleaves them."""
    from concurrent.futures import ThreadPoolExecutor

    parallelism = FIT_PARALLELISM if parallelism is None else parallelism
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """ML3: balanced weights n / (k * n_c) from the class counts (a class-sized table)."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    counts = {r[0]: r[1] for r in rows}
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, cnt in counts.items() for x in (F.lit(c), F.lit(n / (k * cnt)))])
    return df.withColumn(out, F.element_at(m, F.col(label)))


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def random_forest(preset: str = "advanced", label: str = "label", weight: str | None = None,
                  seed: int = C.SEED) -> Forest:
    """ML1: forest presets (trees, depth, min leaf) of the different training scripts."""
    trees, depth, leaf = C.RF_PRESETS[preset]
    # cacheNodeIds / maxMemoryInMB are execution knobs (fewer passes over the data per tree
    # level); they do not change the trees.  Node-id caches are checkpointed to the shared folder.
    rf = Forest(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=min(depth, 30),
                minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed,
                cacheNodeIds=True, maxMemoryInMB=512, checkpointInterval=10)
    if weight:
        rf.setWeightCol(weight)
    return rf


def boosted_ovr(label: str = "label", rounds: int = C.GBT_PRESET[0], depth: int = C.GBT_PRESET[1],
                lr: float = C.GBT_PRESET[2]) -> BoostedTrees:
    """ML2: multiclass gradient boosting as one-vs-rest over binary boosted trees (the model of Spark's
    ``OneVsRest`` over ``GBTClassifier``), all classes in the same passes over the rows."""
    return BoostedTrees(label, rounds=rounds, depth=depth, rate=lr, loss=ONE_VS_REST)


def ovr_probabilities(df: DataFrame, raw_col: str = "rawPrediction", out: str = "probability") -> DataFrame:
    """ML2: per-class GBT margins -> sigmoid(2 m) -> normalised to sum 1."""
    arr = vector_to_array(F.col(raw_col))
    sig = F.transform(arr, lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(sig, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(out, array_to_vector(F.transform(sig, lambda x: x / total)))


def logistic_meta(label: str = "label", weight: str | None = "weight", features: str = "meta") -> LogisticRegression:
    """ML7: logistic-regression meta learner, 1000 iterations, balanced weights."""
    lr = LogisticRegression(labelCol=label, featuresCol=features, maxIter=1000, family="multinomial")
    if weight:
        lr.setWeightCol(weight)
    return lr


FILLED = "__filled"  # suffix of the assembled copies of the features


def fill_stage(features: list[str]) -> SQLTransformer:
    """Missing features (NULL, NaN) become 0 inside the pipeline, so raw batch rows and raw
    stream rows are scored alike by a saved model."""
    filled = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), 0D), 0D) AS `{c}{FILLED}`" for c in features)
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def class_labels(df: DataFrame, label_col: str) -> list[str]:
    """The classes of a table, in the order of their index."""
    rows = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label_col} has more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in rows)


def row_stages(features: list[str], label_col: str, indexed: str = "label", categorical: list[str] = (),
               labels: list[str] | None = None) -> list:
    """The stages ahead of an estimator: label index, zero fill, categorical indexes, assembler."""
    if labels is None:
        index = StringIndexer(inputCol=label_col, outputCol=indexed, stringOrderType="alphabetAsc", handleInvalid="error")
    else:
        index = StringIndexerModel.from_labels(labels, label_col, indexed, "error")
    stages = [index, fill_stage(features)]
    cat_out = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        cat_out.append(f"{c}_idx")
    stages.append(assembler([f"{c}{FILLED}" for c in features] + cat_out))
    return stages


def fit_pipeline(train: DataFrame, features: list[str], estimator, label_col: str, indexed: str = "label",
                 categorical: list[str] = (), labels: list[str] | None = None) -> PipelineModel:
    """Label index (alphabetical, so the order is stable), zero fill, categorical indexes,
    assembler and estimator; rows without a label are left out.

    The classes are those of the training rows, or ``labels`` where several models must agree
    on them (folds: a class may have no row outside its fold); at scoring time a label that
    training never saw gets an index of its own and changes nothing else.
    """
    stages = row_stages(features, label_col, indexed, categorical, labels)
    stages.append(estimator)
    model = fit_stages(stages, train.where(F.col(label_col).isNotNull()))
    model.stages[0].setHandleInvalid("keep")
    return model


def task_count(spark: SparkSession, n: int) -> int:
    """Tasks for ``n`` rows: enough for all cores, at most some ``FIT_ROWS`` rows each."""
    return max(1, min(spark.sparkContext.defaultParallelism, n // TASK_ROWS), -(-n // FIT_ROWS))


def numbered(df: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """The rows of a scan in ``parts`` partitions by their place in it, and the column of that place."""
    at = "_".join(["at", *df.columns])  # a name that no column has
    return df.withColumn(at, F.monotonically_increasing_id()).repartition(parts, at), at


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer tasks than its rows are worth (splits go by bytes and row groups), its rows
    dealt to as many; other scans as they are."""
    parts = task_count(df.sparkSession, df.count())
    if df.rdd.getNumPartitions() >= parts:
        return df
    rows, at = numbered(df, parts)
    return rows.drop(at)


def dealt(df: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """``columns`` of the rows in partitions of at most some ``FIT_ROWS`` rows, enough of them for all cores.

    A fit keeps its rows (and their counts for every tree) by partition, and those of a scan follow
    its bytes: a compact table of many rows has few.  Place and order follow the scan's, so they are
    the same when a task runs again.
    """
    rows, at = numbered(df.select(*columns), task_count(df.sparkSession, df.count() if n is None else n))
    return rows.sortWithinPartitions(at).drop(at)


def fit_stages(stages: list, train: DataFrame) -> PipelineModel:
    """A pipeline fitted stage by stage, as ``Pipeline`` does; its last stage gets its rows ``dealt``."""
    before = Pipeline(stages=stages[:-1]).fit(train)
    last = stages[-1]
    used = [last.getLabelCol(), last.getFeaturesCol()]
    if last.hasParam("weightCol") and last.isSet("weightCol"):
        used.append(last.getWeightCol())
    n = train.count()
    rows = dealt(before.transform(train), used, n)
    if not getattr(last, "scans_rows", False):
        fitted = last.fit_many(rows) if isinstance(last, Forest) and n >= MANY_ROWS else None
        return PipelineModel([*before.stages, fitted or last.fit(rows)])
    rows = stored(rows, "fit-rows")
    fitted = last.fit(rows)
    dropped(rows)
    return PipelineModel([*before.stages, fitted])


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def feature_importances(model: PipelineModel, top: int | None = None) -> list[tuple[str, float]]:
    """ML5: (feature, importance) sorted descending, optionally the top k (driver side, #features rows)."""
    names = [c.removesuffix(FILLED) for c in model.stages[-2].getInputCols()]
    imp = model.stages[-1].featureImportances.toArray()
    pairs = sorted(zip(names, [float(v) for v in imp]), key=lambda t: (-t[1], t[0]))
    return pairs[:top] if top else pairs


def score(model: PipelineModel, df: DataFrame, keep: list[str] = (), prob_col: str = "probability") -> DataFrame:
    """SC1: prediction index, class name, confidence = max probability, one prob_<class> per class."""
    labels = labels_of(model)
    out = model.transform(df)
    if prob_col not in out.columns and "rawPrediction" in out.columns:
        out = ovr_probabilities(out, "rawPrediction", prob_col)
    arr = vector_to_array(F.col(prob_col))
    names = F.array(*[F.lit(x) for x in labels])
    cols = [F.col(quote(k)) for k in keep]
    cols += [F.col("prediction").cast("int").alias("prediction"),
             F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_class"),
             F.array_max(arr).alias("confidence")]
    cols += [arr[i].alias(f"prob_{lab}") for i, lab in enumerate(labels)]
    return out.select(*cols)


# Columns that fitting and scoring make; a source's own columns of these names go.
RESERVED = ("label", "weight", "features", "rawPrediction", "probability", "prediction")


def inputs_of(model: PipelineModel) -> tuple[list[str], list[str]]:
    """(numeric features, categorical columns) that a fitted pipeline reads."""
    assembled = model.stages[-2].getInputCols()
    categorical = [s.getInputCol() for s in model.stages[2:-2]]
    return [c.removesuffix(FILLED) for c in assembled if c.endswith(FILLED)], categorical


def aligned(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with every column the pipeline reads: numeric features as doubles (text that is
    no number counts as missing), columns the source lacks as missing.  Row-local, so the
    same call serves batches and streams."""
    features, categorical = inputs_of(model)
    have = set(df.columns)
    cols = [F.col(quote(c)) for c in df.columns if c not in features and c not in RESERVED]
    cols += [(F.col(quote(c)).try_cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in features]
    cols += [F.lit("").alias(c) for c in categorical if c not in have]
    return df.select(*cols)


def chain_probabilities(models: dict[str, PipelineModel], df: DataFrame, out: str = "p_{}") -> DataFrame:
    """``df`` with one probability array per model, all in one pass: each model's working
    columns are dropped before the next transforms the same rows."""
    for name, model in models.items():
        keep = df.columns
        scored = model.transform(df)
        if "probability" not in scored.columns:
            scored = ovr_probabilities(scored)
        df = scored.select(*[F.col(quote(c)) for c in keep], vector_to_array("probability").alias(out.format(name)))
    return df


# Cumulative probabilities of a Poisson(1) count; beyond the last the count is one more.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def bootstrap_count(tree: int, key: str, seed: int = C.SEED) -> F.Column:
    """How often a tree's bootstrap sample draws a row: Poisson(1) by the hash of tree and key, the
    limit of drawing n of n rows, known to every task without a shuffle."""
    u, count = _tree_draw(tree, key, seed), F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        count = F.when(u < POISSON[k], k).otherwise(count)
    return count


def _tree_draw(tree: int, key: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tree), F.col(key)), F.lit(1 << 30)) / float(1 << 30)


def votes_of_blocks(df: DataFrame, n: int, features: list[str], label_col: str, drawn: str, forest: Forest,
                    categorical: list[str], labels: list[str]) -> DataFrame | None:
    """``out_of_bag`` of many rows: all trees grown together over blocks that hold the counts ``drawn`` of each row,
    and one pass for all votes (None: see ``Forest``)."""
    train = df.where(F.col(label_col).isNotNull())
    before = Pipeline(stages=row_stages(features, label_col, categorical=categorical, labels=labels)).fit(train)
    found = forest.trees_of(dealt(before.transform(train), ["label", "features", drawn], n), drawn)
    if found is None:
        return None
    before.stages[0].setHandleInvalid("keep")
    vote = unseen_votes(*found)(vector_to_array("features"), F.col(drawn))
    out = before.transform(df).withColumn("oob_trees", F.size(F.filter(drawn, lambda c: c == 0)))
    out = out.withColumn("oob_class", F.get(F.array(*[F.lit(x) for x in labels]), vote))
    return out.select(*[F.col(quote(c)) for c in df.columns if c != drawn], "oob_trees", "oob_class")


def out_of_bag(df: DataFrame, features: list[str], label_col: str, key: str, trees: int = 30, categorical: list[str] = (),
               preset: str = "binary", seed: int = C.SEED, parallelism: int = 4) -> DataFrame:
    """ML4: rows with the class that the trees which did not draw them vote for, and the number of
    those trees (``oob_trees``; without any, ``oob_class`` is NULL).

    Every tree is grown on its own bootstrap sample (``bootstrap_count`` as row weights) with
    random feature subsets, as in a forest; a row's votes are the mean class
    probabilities of the trees whose count for it is 0, some 37 per cent of them.
    """
    labels = class_labels(df, label_col)
    drawn = "_".join(["drawn", *df.columns])  # a name that no column has
    n = df.where(F.col(label_col).isNotNull()).count()
    if n >= MANY_ROWS:
        counts = df.withColumn(drawn, F.array(*[bootstrap_count(t, key, seed).cast("tinyint") for t in range(trees)]))
        voted = votes_of_blocks(counts, n, features, label_col, drawn, random_forest(preset, seed=seed).setNumTrees(trees), categorical, labels)
        if voted is not None:
            return voted

    def one(t: int) -> PipelineModel:
        tree = random_forest(preset, weight=drawn, seed=seed + t).setNumTrees(1).setBootstrap(False)
        mine = df.withColumn(drawn, bootstrap_count(t, key, seed)).where(F.col(drawn) > 0)
        return fit_pipeline(mine.where(F.col(label_col).isNotNull()), features, tree, label_col, categorical=categorical, labels=labels)

    models = dict(enumerate(parallel_fits(one, list(range(trees)), parallelism)))
    out = chain_probabilities(models, df)
    unseen = {t: _tree_draw(t, key, seed) < POISSON[0] for t in models}
    votes = [F.struct(sum((F.when(unseen[t], F.col(f"p_{t}")[i]).otherwise(0.0) for t in models), F.lit(0.0)).alias("p"),
                      F.lit(-i).alias("first"), F.lit(x).alias("c")) for i, x in enumerate(labels)]
    n = sum((unseen[t].cast("int") for t in models), F.lit(0))
    return (out.withColumn("oob_trees", n).withColumn("oob_class", F.when(F.col("oob_trees") > 0, F.array_max(F.array(*votes))["c"]))
            .drop(*[f"p_{t}" for t in models]))


def evaluate_scored(scored: DataFrame, truth: str, model_name: str, labels: list[str]) -> DataFrame:
    """EN5 / ML6: accuracy, weighted F1 and one-vs-rest AUC (weighted) of one scored frame."""
    idx = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(truth)) - 1
    s = scored.withColumn("__y", idx.cast("int"))
    from flowlens.operators.common import combine_rows

    m = EV.metric_row(s, "__y", "prediction")
    auc = EV.ovr_auc(s, "__y", {i: f"prob_{lab}" for i, lab in enumerate(labels)}, "weighted")
    return combine_rows(m, auc).select(F.lit(model_name).alias("model"), "accuracy", "precision", "recall", "f1",
                                       "auc")


def evaluate_models(scored: dict[str, DataFrame], truth: str, labels: list[str]) -> DataFrame:
    """``evaluate_scored`` of several models at once: one count and one running sum for all of them."""
    idx = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(truth)) - 1
    rows = reduce(lambda a, b: a.unionByName(b), [
        s.select(F.lit(name).alias("model"), idx.cast("int").alias("y"), F.col("prediction").alias("p"),
                 F.array(*[F.col(quote(f"prob_{x}")) for x in labels]).alias("s")) for name, s in scored.items()])
    long = rows.select("model", "y", F.posexplode("s").alias("cls", "score"))
    per = EV.auc(long, F.col("y") == F.col("cls"), "score", ["model", "cls"])
    support = rows.groupBy("model", F.col("y").alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    per = per.join(support, ["model", "cls"], "left").fillna(0, ["auc", "support"])
    auc = per.groupBy("model").agg(safe_div(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("auc"))
    return EV.metric_rows(rows).join(auc, "model", "left").select("model", "accuracy", "precision", "recall", "f1", "auc")


def train_and_compare(train: DataFrame, test: DataFrame, features: list[str], label_col: str,
                      candidates: dict, categorical: list[str] = (), keep: list[str] = ()) -> tuple[DataFrame, str, dict]:
    """ML6: fit every candidate, evaluate it on the test rows, pick the best by accuracy.

    Each candidate scores the test rows once, stored for the evaluation of all of them together.
    Fit times go to the log: they are no part of a repeatable result.
    """
    scored, models = {}, {}
    for name, est in candidates.items():
        t0 = time.time()
        model = fit_pipeline(train, features, est, label_col, categorical=categorical)
        log.info("fitted %s in %.1f s", name, time.time() - t0)
        models[name] = model
        scored[name] = stored(score(model, test, keep=[label_col, *keep]), "scored")
    table = stored(evaluate_models(scored, label_col, labels_of(model)), "comparison")
    dropped(*scored.values())
    best = table.orderBy(F.col("accuracy").desc(), F.col("model")).first()["model"]
    return table, best, models


def cross_val_scores(df: DataFrame, features: list[str], estimator_fn, label_col: str, key: str,
                     k: int = C.CV_FOLDS, categorical: list[str] = ()) -> dict:
    """SP3: k stratified folds, accuracy per fold, mean and 2 x population std."""
    folds = stored(assign_folds(df, label_col, key, k), "folds")

    def one(f: int) -> float:
        model = fit_pipeline(folds.where(F.col("fold") != f), features, estimator_fn(), label_col,
                             categorical=categorical)
        out = model.transform(folds.where(F.col("fold") == f))
        return out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]

    scores = parallel_fits(one, list(range(k)))
    mean = sum(scores) / k
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / k)
    return {"scores": scores, "mean": mean, "pm2std": 2 * std}


def stacking(train: DataFrame, test: DataFrame, features: list[str], label_col: str, key: str,
             base: dict, k: int = C.CV_FOLDS, categorical: list[str] = (), full: dict | None = None) -> DataFrame:
    """EN3: out-of-fold base probabilities (k folds) -> logistic meta learner; bases refit on all rows.

    Returns the test rows scored by the stack (prediction, probability, label index).  The
    label index is that of all training rows: a class whose rows lie in one fold has a
    place in every fold's probabilities.  The fold table and the out-of-fold table are
    written once to the shared folder, for every fit that reads them, in files for all cores.
    ``full`` are the bases fitted on all rows of ``train`` where the caller has them already.
    """
    parts = task_count(train.sparkSession, train.count())
    folds = stored(assign_folds(train, label_col, key, k).repartition(parts, key), "folds")
    train = folds.drop("fold")  # the full refits read the same stored rows
    labels = class_labels(train, label_col)
    # Every (fold, base model) fit and every full refit is independent (see ``parallel_fits``).
    tasks = [(f, name) for f in range(k) for name in base] + [(None, name) for name in base if full is None]

    def fit_one(task):
        f, name = task
        data = train if f is None else folds.where(F.col("fold") != f)
        return task, fit_pipeline(data, features, base[name](), label_col, categorical=categorical, labels=labels)

    fitted = dict(parallel_fits(fit_one, tasks))
    oof = None
    for f in range(k):
        scored_part = folds.where(F.col("fold") == f)
        for name in base:
            s = fitted[(f, name)].transform(scored_part).withColumn(f"meta_{name}", F.col("probability"))
            scored_part = s.select(*scored_part.columns, f"meta_{name}")
        oof = scored_part if oof is None else oof.unionByName(scored_part)
    oof = stored(oof, "out-of-fold")
    full = full or {name: fitted[(None, name)] for name in base}
    meta_cols = [f"meta_{n}" for n in base]
    # As many classes as the bases have: unknown labels get their index on the test rows only.
    indexed = lambda unknown: StringIndexerModel.from_labels(labels, label_col, "label", unknown)
    meta_train = indexed("error").transform(oof.where(F.col(label_col).isNotNull()))
    meta_train = class_weights(meta_train, "label")
    meta = fit_stages([VectorAssembler(inputCols=meta_cols, outputCol="meta"), logistic_meta()], meta_train)
    scored_test = test
    for name, m in full.items():
        s = m.transform(scored_test).withColumn(f"meta_{name}", F.col("probability"))
        scored_test = s.select(*scored_test.columns, f"meta_{name}")
    scored_test = indexed("keep").transform(scored_test)
    return meta.transform(scored_test)


def save_model(model: PipelineModel, path: str) -> str:
    """IO8: persist a fitted pipeline (distributed write to the shared folder)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
