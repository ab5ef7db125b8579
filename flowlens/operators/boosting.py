"""ML2: gradient boosting of all classes together: one softmax over them, or one against the rest.

Rows are binned once (at most ``BINS`` bins a feature, edges from a quantile sketch of all
rows) and stored with the margins of their classes, ``BLOCK_ROWS`` to a record, so that a
pass takes whole arrays out of the table and not rows.  A round grows one tree per class, all
of them level by level together: a pass over the stored blocks gives every task's sums of
gradients by (class, node, feature, bin), Spark adds them up, and the driver picks the
splits from that table.  Its size is classes x nodes x features x bins whatever the rows,
and is checked.  Of two children only the one with fewer rows is summed: the other is their
parent less that one, exactly, for the sums are whole numbers (gradients in units of 2**-20);
so reruns and lost executors give the same trees, too.

A pass applies the trees since the margins were last stored, every ``KEEP`` rounds; the
table before is deleted then.

Splits: best gain of Newton steps among those with ``min_rows`` rows on either side, ties to
the first feature and bin; bins up to the split go left.  Leaf: (K - 1) / K x sum of
gradients / sum of p (1 - p), times the rate.  Rows without a class or with a weight of 0 or
less teach nothing; one class gives probability 1.  Features are numbers; an indexed
category counts by its index.

One against the rest (``ONE_VS_REST``) gives every class the binary model that Spark ML's
``GBTClassifier`` fits: labels of -1 and 1, the loss 2 log(1 + exp(-2 y F)), a first tree on the
labels and then trees on the residuals times the rate, splits by variance, leaves that are
means, and indexed categories split as sets (in order of their means).  The classes share
their passes, so a round costs as many passes as its trees have levels, whatever their number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import config as C
from flowlens.operators.common import dropped, stored

BINS = 32
UNIT = float(1 << 20)       # gradients are summed in parts of this
KEEP = 2                    # rounds between stored margins
BLOCK_ROWS = 10_000         # rows of a stored record at most (a larger Arrow batch stays whole)
TASK_ROWS = 50_000          # rows worth a task of their own
MAX_CELLS = 20_000_000      # of a level's table of sums: more is an error
RIDGE = 1e-3                # added to the second derivatives
SOFTMAX, ONE_VS_REST = "softmax", "one_vs_rest"
ROW = float(1 << 38)        # a row beside its gradient, below 4 UNIT: exact for BLOCK_ROWS rows
FINE = 1024                 # steps in which a feature with at most BINS values shows them all
ROWS = "bins binary, label binary, weight binary, margin binary"  # arrays of a block, row after row innermost


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it (NaN: all)."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)


def _as_cut(right: np.ndarray) -> int:
    """The cut of a set of bins that go right: above BINS, where no cut of an ordered feature lies."""
    return BINS + int((1 << right.astype(np.int64)).sum())


def _members(cut: int) -> np.ndarray:
    return (cut - BINS >> np.arange(BINS) & 1).astype(np.uint8)


def routed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The place within level ``levels`` where each row of (features, rows) bins ends in one tree.

    Places come from the bottom up: at every node a choice between the places in its two halves,
    by bits of small integers.
    """
    kind = np.uint8 if levels <= 8 else np.uint32
    none = np.zeros(bins.shape[1], kind)

    def below(node: int, left: int) -> np.ndarray:
        if not left:
            return none
        low, at = below(2 * node + 1, left - 1), int(cut[node])
        if at == BINS:
            return low
        own = bins[feature[node]]
        right = (own > at if at < BINS else _members(at).take(own)).astype(kind, copy=False)
        if left == 1:
            return right
        high = below(2 * node + 2, left - 1) | kind(1 << (left - 1))
        return low ^ ((low ^ high) & np.negative(right))

    return below(0, levels)


def margins(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, classes: int) -> np.ndarray:
    """(classes, rows): sums of the leaves of trees (rounds x classes, nodes) by class."""
    out = np.zeros((classes, bins.shape[1]))
    if not feature.size:
        return out
    levels = leaf.shape[1].bit_length() - 1
    for t in range(feature.shape[0]):
        out[t % classes] += leaf[t].take(routed(bins, feature[t], cut[t], levels))
    return out


def softmax(m: np.ndarray, axis: int = 1) -> np.ndarray:
    e = np.exp(m - m.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


class _Block:
    """A stored record: (features, rows) bins, (classes, rows) margins, a label and a weight a row."""

    def __init__(self, b: pa.RecordBatch, at: int, features: int, classes: int):
        array = lambda c, kind: np.frombuffer(b.column(c)[at].as_buffer(), kind)
        self.label, self.weight = array("label", np.int32), array("weight", np.float64)
        self.bins = array("bins", np.uint8).reshape(features, -1)
        self.margin = array("margin", np.float64).reshape(classes, -1)


def level_sums(rows: DataFrame, recent: tuple, growing: tuple, level: int, counted: np.ndarray, features: int,
               classes: int, loss: str = SOFTMAX, first: bool = False) -> np.ndarray:
    """(gradients, second derivatives, rows) by (class, node of the level, feature, bin) of the
    ``counted`` (class, node) pairs; 0 for the others."""
    shape = (*counted.shape, features, BINS)
    cells = int(np.prod(shape))
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} sums a level (classes x nodes x features x bins) exceed {MAX_CELLS}")
    # Counted nodes of a class have the places 0, 1, ... in its sums, the others none (-1).
    place = np.where(counted, np.cumsum(counted, 1) - 1, -1)
    width = counted.sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((3, features, w * BINS)) for w in width]
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i, features, classes)
                m = b.margin + margins(b.bins, *recent, classes)
                p = softmax(m, 0) if loss == SOFTMAX else m
                # Rows and gradients fit one sum where all weigh 1 (one against the rest: second derivatives are the rows).
                counts = b.label.size <= BLOCK_ROWS and (b.weight == 1).all()
                for k in np.flatnonzero(width):
                    at = place[k].take(routed(b.bins, growing[0][k], growing[1][k], level))
                    own = None if at.min() >= 0 else np.flatnonzero(at >= 0)
                    mine = (lambda x: x) if own is None else (lambda x: x.take(own))  # noqa: B023
                    q, w, at = mine(p[k]), mine(b.weight) * UNIT, mine(at) * BINS
                    if loss == SOFTMAX:
                        g = np.rint(((mine(b.label) == k) - q) * w)
                        h = np.rint(q * (1 - q) * w)
                    else:
                        y = np.where(mine(b.label) == k, 1.0, -1.0)
                        g, h = np.rint((y if first else 4 * y / (1 + np.exp(2 * y * q))) * w), np.rint(w)
                    packed = g + ROW
                    for f in range(features):
                        cell = at + mine(b.bins[f])
                        if counts:  # rows and gradients in one sum
                            both = np.bincount(cell, packed, width[k] * BINS)
                            n = np.rint(both / ROW)
                            h_sum = n * UNIT if loss == ONE_VS_REST else np.bincount(cell, h, width[k] * BINS)
                            sums[k][:, f] += both - n * ROW, h_sum, n
                            continue
                        sums[k][0, f] += np.bincount(cell, g, width[k] * BINS)
                        sums[k][1, f] += np.bincount(cell, h, width[k] * BINS)
                        sums[k][2, f] += np.bincount(cell, minlength=width[k] * BINS)
        out = np.zeros((3, *shape), np.int64)
        for k, s in enumerate(sums):
            out[:, k, counted[k]] = s.reshape(3, features, -1, BINS).transpose(0, 2, 1, 3)
        flat = out.reshape(3, -1)
        cell = np.flatnonzero(flat[2])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cell, *flat[:, cell])], ["cell", "g", "h", "n"])

    total = rows.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((3, cells))
    out[:, total["cell"].to_numpy()] = [total[c].to_numpy() for c in "ghn"]
    out[:2] /= UNIT
    return out.reshape(3, *shape)


def by_means(sums: np.ndarray, sets: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The sums with the bins of the features ``sets`` in order of their means (those without rows last), and these orders."""
    out, orders = sums.copy(), {}
    for f in sets:
        g, h, n = sums[:, :, :, f]
        orders[f] = np.argsort(np.where(n > 0, g / np.maximum(h, 1e-300), np.inf), -1, kind="stable")
        out[:, :, :, f] = np.take_along_axis(sums[:, :, :, f], orders[f][None], -1)
    return out, orders


def best_splits(sums: np.ndarray, min_rows: int, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, last bin of the left side) for every (class, node)."""
    below = np.cumsum(sums, -1)
    g, h, n = below
    total = below[..., -1:]
    rest = total - below
    score = lambda s: s[0] ** 2 / (s[1] + ridge)
    gain = score(below) + score(rest) - score(total)
    gain = np.where((n >= min_rows) & (rest[2] >= min_rows), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    at = flat.argmax(-1)
    return np.take_along_axis(flat, at[..., None], -1)[..., 0], at // BINS, at % BINS


def grown(rows: DataFrame, recent: tuple, features: int, classes: int, depth: int, rate: float,
          min_rows: int, loss: str = SOFTMAX, first: bool = False,
          sets: list[int] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree per class as (classes, nodes) arrays of features, cuts and leaves, and the gains by feature.

    A node that is not split sends its rows to the left, so every tree has all leaves.
    """
    feature = np.zeros((classes, (1 << depth) - 1), np.int64)
    cut = np.full(feature.shape, BINS, np.int64)
    leaf = np.zeros((classes, 1 << depth))
    gains = np.zeros(features)
    active = np.ones((classes, 1), bool)
    ridge = RIDGE if loss == SOFTMAX else 1e-300
    scale = rate * (classes - 1) / classes if loss == SOFTMAX else 1.0 if first else rate
    step = lambda s: scale * s[0] / (s[1] + ridge)
    counted, parents = active, None
    for level in range(depth):
        sums = level_sums(rows, recent, (feature, cut), level, counted, features, classes, loss, first)
        if parents is not None:
            other = active & ~counted
            k, node = np.nonzero(other)
            sums[:, k, node] = parents[:, k, node >> 1] - sums[:, k, node ^ 1]
        ordered, orders = by_means(sums, sets)
        gain, f, b = best_splits(ordered, min_rows, ridge)
        split = active & (gain > 1e-9)
        start = (1 << level) - 1
        feature[:, start:start + split.shape[1]] = np.where(split, f, 0)
        cut[:, start:start + split.shape[1]] = np.where(split, b, BINS)
        for k, node in zip(*np.nonzero(split & np.isin(f, list(sets)))):
            cut[k, start + node] = _as_cut(orders[f[k, node]][k, node, b[k, node] + 1:])
        np.add.at(gains, f[split], gain[split])
        below = np.cumsum(ordered, -1)
        k, node = np.nonzero(active)
        whole = step(below[:, k, node, 0, -1])
        chosen = below[:, k, node, f[k, node], b[k, node]]
        rest = below[:, k, node, 0, -1] - chosen
        here, width = split[k, node], depth - level
        left = node << width
        leaf[k, left] = np.where(here, step(chosen), whole)
        leaf[k[here], left[here] + (1 << (width - 1))] = step(rest)[here]
        active, parents = np.repeat(split, 2, 1), sums
        if not active.any():
            break
        counted = np.zeros_like(active)  # the child with fewer rows
        counted[k[here], 2 * node[here] + (rest[2] < chosen[2])[here]] = True
    return feature, cut, leaf, gains


def _joined(trees: list[tuple], depth: int) -> tuple:
    """Rounds of trees as one (rounds x classes, nodes) array each of features, cuts and leaves."""
    if not trees:
        return np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1 << depth))
    return tuple(np.concatenate([t[i] for t in trees]) for i in range(3))


class _State(Params):
    state = Param(Params._dummy(), "state", "edges, priors and trees as JSON", typeConverter=TypeConverters.toString)


class BoostedTreesModel(Model, HasFeaturesCol, _State, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds ``probability`` (one against the rest: the classes' margins as ``rawPrediction``)
    and ``prediction`` (ties to the first class)."""

    def _fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @property
    def numClasses(self) -> int:  # noqa: N802 - the name Spark ML models use
        return len(self._fitted()["prior"])

    @property
    def featureImportances(self):  # noqa: N802
        gains = np.array(self._fitted()["gains"])
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self._fitted()
        edges = [np.array(e) for e in s["edges"]]
        prior = np.array(s["prior"])
        last, out = (softmax, "probability") if s.get("loss", SOFTMAX) == SOFTMAX else (np.asarray, "rawPrediction")
        trees = (np.array(s["feature"], np.int64), np.array(s["cut"], np.int64), np.array(s["leaf"]))

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins = np.ascontiguousarray(binned(np.stack(x.to_numpy()), edges).T)
            return pd.Series(list(last(prior + margins(bins, *trees, prior.size).T)))

        p = "_".join(["scores", *df.columns])  # a name that no column has
        return (df.withColumn(p, scores(vector_to_array(self.getFeaturesCol())))
                .withColumn(out, array_to_vector(p))
                .withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double")).drop(p))


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """ML2: boosted trees of all classes on a vector of features and a label index from 0."""

    scans_rows = True  # several times before it has blocks of them

    rounds = Param(Params._dummy(), "rounds", "trees per class", typeConverter=TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", typeConverter=TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", typeConverter=TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows of a child", typeConverter=TypeConverters.toInt)
    loss = Param(Params._dummy(), "loss", f"{SOFTMAX} or {ONE_VS_REST}", typeConverter=TypeConverters.toString)

    def __init__(self, label: str = "label", weight: str | None = None, rounds: int = C.GBT_PRESET[0],
                 depth: int = C.GBT_PRESET[1], rate: float = C.GBT_PRESET[2], min_rows: int = 1,
                 loss: str = SOFTMAX):
        super().__init__()
        self._set(labelCol=label, featuresCol="features", rounds=rounds, depth=depth, rate=rate, minRows=min_rows, loss=loss)
        if weight:
            self._set(weightCol=weight)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        x = vector_to_array(self.getFeaturesCol())
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = df.select(x.alias("x"), F.col(self.getLabelCol()).cast("int").alias("label"), weight.alias("weight"))
        rows = rows.where(F.col("label").isNotNull() & (F.col("weight") > 0))
        head = rows.select(F.size("x").alias("n")).first()
        if head is None:
            raise ValueError("no row with a class and a weight")
        # One scan for a sketch of every feature, two for the classes and their weights.
        loss = self.getOrDefault(self.loss)
        ranks = [i / FINE for i in range(1, FINE)]
        sketch = rows.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"x{i}") for i in range(head["n"])])
        found = sketch.agg(*[F.percentile_approx(c, ranks, 10_000).alias(c) for c in sketch.columns]).first()
        sets = self._sets(df) if loss == ONE_VS_REST else {}
        edges = [self._edges(e or [], loss, sets.get(i)) for i, e in enumerate(found)]
        classes = rows.agg(F.max("label")).first()[0] + 1
        if classes * len(edges) * BINS > MAX_CELLS:
            raise ValueError(f"{classes} classes are too many")
        share = rows.groupBy("label").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
        weights = {r["label"]: r["w"] for r in share}
        prior = np.zeros(classes) if loss == ONE_VS_REST else np.log(np.maximum([weights.get(k, 0.0) for k in range(classes)], 1e-9) / sum(weights.values()))
        # One task for a small table; on large ones as many as the cluster runs twice over, so
        # that the sums of a level do not grow with the number of files.
        tasks = max(1, min(sum(r["n"] for r in share) // TASK_ROWS, 2 * df.sparkSession.sparkContext.defaultParallelism))
        feature, cut, leaf, gains = self._trees(rows, [np.array(e) for e in edges], prior, tasks, sorted(sets))
        state = {"loss": loss, "edges": edges, "prior": prior.tolist(), "gains": gains.tolist(), "feature": feature.tolist(),
                 "cut": cut.tolist(), "leaf": leaf.tolist()}
        return BoostedTreesModel()._set(featuresCol=self.getFeaturesCol(), state=json.dumps(state))

    def _sets(self, df: DataFrame) -> dict[int, int]:
        """{feature: number of categories} of the indexed categories, which the vector's metadata list."""
        attrs = df.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        sizes = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in attrs.get("nominal", [])}
        if max(sizes.values(), default=0) > BINS:
            raise ValueError(f"a category with more than {BINS} values (of Spark ML's trees, too): {sizes}")
        return sizes

    @staticmethod
    def _edges(found: list[float], loss: str, categories: int | None) -> list[float]:
        """Upper ends of the bins: of each category, of each value where few are found, of equal shares else."""
        if categories is not None:
            return [float(i) for i in range(categories - 1)]
        values = sorted(set(found))
        if loss == ONE_VS_REST and len(values) <= BINS:
            return values[:BINS - 1]
        return sorted(set(found[FINE // BINS - 1::FINE // BINS]))

    def _trees(self, rows: DataFrame, edges: list[np.ndarray], prior: np.ndarray, tasks: int, sets: list[int]) -> tuple:
        depth, features, classes = self.getOrDefault(self.depth), len(edges), prior.size
        loss = self.getOrDefault(self.loss)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def block() -> pa.RecordBatch:
                bins, label, weight = (np.concatenate(x) for x in zip(*held))
                margin = np.repeat(prior[:, None], len(label), 1)
                arrays = (np.ascontiguousarray(bins.T), label, weight, margin)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["bins", "label", "weight", "margin"])

            for b in batches:
                if held and sum(len(h[1]) for h in held) + b.num_rows > BLOCK_ROWS:
                    yield block()
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, features)
                    held.append((binned(x, edges), b.column("label").to_numpy(), b.column("weight").to_numpy()))
            if held:
                yield block()

        def moved(recent: tuple):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for i in range(b.num_rows):
                        r = _Block(b, i, features, classes)
                        margin = r.margin + margins(r.bins, *recent, classes)
                        yield b.slice(i, 1).set_column(3, "margin", pa.array([margin.tobytes()], pa.binary()))
            return run

        # Blocks are dealt to the tasks in turn, whatever the files that the rows came from.
        table = stored(rows.mapInArrow(start, ROWS).repartition(tasks), "boosting-rows")
        trees, recent, gains = [], [], np.zeros(features)
        for done in range(self.getOrDefault(self.rounds) if classes > 1 else 0):
            if len(recent) == KEEP:
                before, table = table, stored(table.mapInArrow(moved(_joined(recent, depth)), ROWS), "boosting-rows")
                dropped(before)
                recent = []
            tree = grown(table.coalesce(tasks), _joined(recent, depth), features, classes, depth,
                         self.getOrDefault(self.rate), self.getOrDefault(self.minRows), loss, not done, sets)
            if loss == SOFTMAX and not (tree[0].any() or (tree[1] < BINS).any()):
                break  # nothing left to split
            trees.append(tree[:3])
            recent.append(tree[:3])
            gains += tree[3]
        dropped(table)
        return *_joined(trees, depth), gains
