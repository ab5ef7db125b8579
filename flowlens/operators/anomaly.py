"""Anomaly decisions (AD3) and the distributed isolation forest / one-class model (AD1, AD2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators.common import dropped, stored
from flowlens.operators.selection import quantile_table


def decision_rule(df: DataFrame, anomaly_score: str, contamination: float = C.CONTAMINATION,
                  offset: float | None = None) -> tuple[DataFrame, float]:
    """AD3: normality = -anomaly score; offset = its ``contamination`` quantile (exact);
    decision = normality - offset; prediction -1 (anomaly) when decision < 0 else 1.

    The offset is fitted on ``df`` unless given (fit on training rows, apply elsewhere).
    """
    normality = (-F.col(anomaly_score).cast("double"))
    if offset is None:
        q = quantile_table(df.select(normality.alias("__s")), ["__s"], [contamination])
        offset = q["__s"][round(contamination, 12)]
    out = (df.withColumn("decision", normality - F.lit(offset))
           .withColumn("prediction", F.when(F.col("decision") < 0, F.lit(-1)).otherwise(F.lit(1))))
    return out, offset


def anomaly_counts(df: DataFrame, model_col: str = "model", pred_col: str = "prediction") -> DataFrame:
    """AD3: anomalies per model."""
    return df.groupBy(model_col).agg(F.sum((F.col(pred_col) == -1).cast("int")).cast("bigint").alias("anomaly_count"))


# ---------------------------------------------------------------------------------------------
# AD1: isolation forest (Liu, Ting & Zhou, 2008) as a Spark job
# ---------------------------------------------------------------------------------------------

def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    import math

    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow_tree(pdf, features: list[str], psi: int, seed: int):
    """Grow one isolation tree on <= psi rows; node arrays in breadth-first layout."""
    import math

    import numpy as np
    import pandas as pd

    tree_id = int(pdf["tree"].iloc[0])
    x = pdf[features].to_numpy(dtype="float64")
    rng = np.random.default_rng(seed * 100_003 + tree_id)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    feat, thr, left, right, size = [], [], [], [], []
    queue = [(np.arange(len(x)), 0)]
    # Breadth-first: nodes get ids in the order they leave the queue.
    while queue:
        idx, depth = queue.pop(0)
        node = len(feat)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        feat[node], thr[node] = f, t
        queue.append((idx[go_left], depth + 1))
        queue.append((idx[~go_left], depth + 1))
    # The i-th split node's children were queued i-th, so they hold ids 2i+1 and 2i+2.
    nxt = 1
    for node in range(len(feat)):
        if feat[node] >= 0:
            left[node], right[node] = nxt, nxt + 1
            nxt += 2
    return pd.DataFrame({"tree": [tree_id], "feat": [feat], "thr": [thr], "left": [left], "right": [right],
                         "size": [size]})


def fit_isolation_forest(df: DataFrame, features: list[str], key: str, n_trees: int = 100, psi: int = 256,
                         seed: int = C.SEED) -> dict:
    """AD1 fit: sample psi rows per tree by hash, grow the trees in parallel (one group per tree).

    Only about ``n_trees * psi`` rows ever reach Python.  ``key`` must be unique: hashes of a row
    decide whether it joins a tree and which one, at a rate that leaves each tree about
    twice psi rows (one hash a row once the table is larger than all samples together), and
    every tree keeps its psi smallest hashes, so the forest is the same on every layout.
    """
    from flowlens.session import ensure_python_package

    ensure_python_package(df.sparkSession)
    n = df.count()
    psi = int(min(psi, n))
    base = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    rate = min(1.0, 2.0 * psi / max(n, 1) + 64.0 / max(n, 1))  # of a row for each tree
    u = lambda j: F.pmod(F.xxhash64(F.lit(seed), j, F.col(key).cast("string")), F.lit(1 << 40)) / float(1 << 40)
    if rate < 1.0:
        # A row draws ``draws`` times; a draw below its share is a tree, at even odds.
        draws = max(1, -(-int(n_trees * rate * 1000) // 1000))
        share = n_trees * rate / draws
        hits = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda j: F.floor(u(j) / F.lit(share) * n_trees).cast("int"))
        trees = F.array_distinct(F.filter(hits, lambda t: t < n_trees))
    else:
        trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    cand = base.select("*", F.explode(trees).alias("tree"))
    cand = cand.withColumn("__h", F.xxhash64(F.lit(seed), F.lit("order"), F.col("tree"), F.col(key).cast("string")))
    from pyspark.sql import Window

    w = Window.partitionBy("tree").orderBy("__h", key)
    sample = cand.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= psi).drop("__r", "__h")
    schema = "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<int>"
    grown = sample.groupBy("tree").applyInPandas(lambda pdf: _grow_tree(pdf, features, psi, seed), schema)
    rows = grown.collect()   # n_trees small arrays (<= 2 * psi nodes each)
    return {"features": features, "psi": psi, "trees": [r.asDict() for r in rows]}


def isolation_scores(df: DataFrame, model: dict, keep: list[str], out: str = "anomaly_score") -> DataFrame:
    """AD1 score: 2 ** (-E[h(x)] / c(psi)) per row, computed batch-wise with numpy in mapInPandas."""
    import numpy as np

    from flowlens.session import ensure_python_package

    spark = df.sparkSession
    ensure_python_package(spark)
    b = spark.sparkContext.broadcast(model)
    features = model["features"]

    def score(it):
        mdl = b.value
        c_psi = _c(mdl["psi"])
        # Per node: path-length correction c(size) for the points a leaf still holds.
        trees = [(np.array(t["feat"]), np.array(t["thr"]), np.array(t["left"]), np.array(t["right"]),
                  np.array([_c(s) for s in t["size"]])) for t in mdl["trees"]]
        for pdf in it:
            x = pdf[features].to_numpy(dtype="float64")
            total = np.zeros(len(x))
            for feat, thr, left, right, leaf_c in trees:
                node = np.zeros(len(x), dtype=np.int64)
                depth = np.zeros(len(x))
                while True:
                    f = feat[node]
                    active = f >= 0
                    if not active.any():
                        break
                    xi = x[np.arange(len(x)), np.where(active, f, 0)]
                    go_left = xi < thr[node]
                    nxt = np.where(go_left, left[node], right[node])
                    node = np.where(active, nxt, node)
                    depth = depth + active
                total += depth + leaf_c[node]
            mean = total / max(len(trees), 1)
            pdf = pdf[keep].copy()
            pdf[out] = np.power(2.0, -mean / c_psi) if c_psi > 0 else 0.5
            yield pdf

    fields = [f for f in df.schema.fields if f.name in keep]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    clean = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f_{i}")
                               for i, c in enumerate(features)])
    # Feature columns travel under private names so they never clash with kept columns.
    renamed = {f"__f_{i}": c for i, c in enumerate(features)}

    def score_renamed(it):
        def fix(it2):
            for pdf in it2:
                yield pdf.rename(columns=renamed)
        yield from score(fix(it))

    return clean.mapInPandas(score_renamed, schema)


# ---------------------------------------------------------------------------------------------
# AD2: one-class model on random Fourier features (Rahimi & Recht, 2007)
# ---------------------------------------------------------------------------------------------

BATCH_ROWS = 8_192  # rows of a subgradient step, about: chosen by hash, others for every step


def _embedded(x: list, model: dict):
    """The components sqrt(2/D) cos(W x + b) of rows given as one array per feature, one array after another.

    Sums go feature by feature, so a row's components do not depend on the rows beside it.
    """
    import numpy as np

    scale = (2.0 / len(model["W"])) ** 0.5
    for weights, b in zip(model["W"], model["b"]):
        line = np.full(len(x[0]), b)
        for v, w in zip(x, weights):
            line += v * w
        yield np.cos(line) * scale


def fit_one_class(df: DataFrame, features: list[str], key: str, nu: float = C.CONTAMINATION, n_components: int = 100,
                  steps: int = 30, lr: float = 0.5, batch_rows: int = BATCH_ROWS, seed: int = C.SEED) -> dict:
    """AD2 fit: RBF kernel approximated by random Fourier features, gamma = 1 / (d * Var(X)).

    Var(X) comes from one aggregate over all rows.  Objective
    1/2 |w|^2 + 1/(nu n) sum max(0, rho - w.z) - rho, by mini-batch subgradients: each step
    takes the rows whose hash falls into its slice (about ``batch_rows``), embeds them where
    they lie and adds up the embedding of the violators, so a task hands over ``n_components``
    sums.  The slices of all steps are picked out in one scan and stored, some
    ``steps * batch_rows`` rows.  rho is finally the exact nu-quantile of w.z over all training
    rows, whose w.z is stored for it.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from flowlens.session import ensure_python_package

    spark, d = df.sparkSession, len(features)
    ensure_python_package(spark)
    x = df.select(F.col(key).alias("__key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    # Var(X) over all values = E[x^2] - E[x]^2 across every feature.
    st = x.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)],
               *[F.avg(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for i in range(d)], F.count(F.lit(1)).alias("n")).first()
    if not st["n"]:
        raise ValueError("no training rows")
    mean_all = sum(st[f"m{i}"] for i in range(d)) / d
    sq_all = sum(st[f"q{i}"] for i in range(d)) / d
    gamma = 1.0 / (d * max(sq_all - mean_all ** 2, 1e-12))
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2 * gamma), size=(n_components, d))
    bias = rng.uniform(0, 2 * np.pi, size=n_components)
    model = {"features": features, "W": W.tolist(), "b": bias.tolist(), "gamma": gamma, "nu": nu}
    slices = max(1, st["n"] // batch_rows)
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col("__key").cast("string")), F.lit(slices))
    picked = stored(x.select(slot.alias("slot"), *[f"x{i}" for i in range(d)]).where(F.col("slot") <= steps), "one-class-slices")

    def sums(step: int, w, rho: float) -> "np.ndarray":
        """(rows, violators, sum of the violators' embedding) of the step's slice."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_components + 2)
            for b in batches:
                rows = np.stack([np.asarray(c) for c in b.columns], axis=1)
                z = np.cos(rows @ W.T + bias) * np.sqrt(2.0 / n_components)
                viol = z @ w < rho if step else np.ones(len(z), bool)
                total += np.r_[len(z), viol.sum(), z[viol].sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["i", "x"])

        own = picked.where(F.col("slot") == step % slices).drop("slot")
        found = own.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(n_components + 2)
        out[[r["i"] for r in found]] = [r["x"] for r in found]
        return out

    first = sums(0, None, 0.0)
    w, rho = first[2:] / max(first[0], 1.0), 0.0
    for it in range(steps):
        got = sums(it + 1, w, rho)
        n = max(got[0], 1.0)
        step = lr / (1 + it)
        w = w - step * (w - got[2:] / (nu * n))
        rho = rho - step * (got[1] / (nu * n) - 1.0)
    model.update({"w": w.tolist(), "rho": 0.0})
    margins = stored(one_class_scores(df, model, keep=[]).select("decision"), "one-class-margins")
    model["rho"] = quantile_table(margins, ["decision"], [nu])["decision"][round(nu, 12)]
    dropped(picked, margins)
    return model


def one_class_scores(df: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """AD2 score: decision = w.z(x) - rho, prediction -1 when decision < 0.

    Rows are embedded in Arrow batches, one component after another; a row's decision is the
    same in every batch, run and pass.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from flowlens.session import ensure_python_package

    ensure_python_package(df.sparkSession)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in b.columns[n:]]
            margin = np.zeros(b.num_rows)
            for z, w in zip(_embedded(x, model), model["w"]):
                margin += z * w
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(margin - model["rho"])], [*keep, "decision"])

    # Feature columns travel under private names so they never clash with kept columns.
    clean = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f_{i}") for i, c in enumerate(model["features"])])
    schema = T.StructType([*clean.schema.fields[:n], T.StructField("decision", T.DoubleType())])
    return clean.mapInArrow(run, schema).withColumn("prediction", F.when(F.col("decision") < 0, -1).otherwise(1))
