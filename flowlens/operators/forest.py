"""ML1 at size: the forest of Spark ML's ``RandomForestClassifier``, grown over blocks of binned rows.

Spark's own fit keeps every row with its counts for all trees (some 1.5 KB) and looks at every row for every
tree and level.  Here rows are binned once and stored in blocks, a byte a feature; how often a tree draws a row
is told by the numbers of tree and block (or by a column of counts), so nothing is kept by row and tree.

Trees grow in groups.  A pass over the blocks sums the classes by (tree, node, feature, bin) for the nodes that hold
more than ``LOCAL_ROWS`` drawn rows; the sums of a node meet in one group, which picks its split.  The rows of a node
with fewer go to one task, which grows the subtree to its end.  Rows of finished nodes go nowhere.

The rules are Spark's: gini gain of weighted classes, at most ``BINS`` bins, a random subset of the features at
every node, ordered categories by their impurity (all subsets of a few), children of ``minInstancesPerNode``
drawn rows at least, sibling leaves of one class merged.  Bin edges come from a sketch of all rows.  Sums are whole
numbers and draws and subsets follow from numbers, so the trees are the same whatever the tasks.  The result is
Spark's model, from a file in its own format.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.boosting import BINS, binned
from flowlens.operators.common import dropped, stored
from flowlens.session import scratch_path

BLOCK_ROWS = 32_767           # rows of a stored record at most (a larger Arrow batch stays whole)
SKETCH_ROWS = 100_000         # rows that a task sums up at once for the bin edges
POINTS = 4_096                # values that stand for the rows of a class there
LOCAL_ROWS = 1_000_000          # drawn rows of a node that one task grows to its end
GROUP_ROWS = 150_000_000      # rows times trees that grow together: bounds what is shuffled at once
CHUNK = 512                   # nodes whose sums a task holds at once
MAX_CLASSES = 256             # more, or weights that differ within a class: Spark's own fit
FEW_CATEGORIES = 5            # all subsets of so many are tried
LEAST_GAIN = 1e-12

BLOCK = "block long, rows long, bins binary, label binary, draws binary"
SUMS = "tree int, heap long, sums binary"
SPLITS = "tree int, heap long, feature int, mask long, gain double, total binary, left binary"
PARTS = "tree int, heap long, bins binary, label binary, drawn binary"
SHARES = "y int, feature int, points binary, weights binary"
NODES = "tree int, heap long, feature int, mask long, gain double, total binary"


def poisson_table(mean: float) -> np.ndarray:
    """The count that each of 2**16 equal chances stands for."""
    upto, term, out = 0.0, math.exp(-mean), []
    for k in range(256):
        upto += term
        out.append(upto)
        term *= mean / (k + 1)
    return np.searchsorted(np.array(out), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits of each number (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spec:
    """What all trees of a fit share."""

    def __init__(self, features: int, weights: np.ndarray, sets: dict[int, int], depth: int, min_rows: int, least_gain: float,
                 subset: int, seed: int, chances: np.ndarray | None):
        self.features, self.weights, self.sets, self.depth = features, weights, sets, depth
        self.min_rows, self.least_gain, self.subset, self.seed, self.chances = min_rows, least_gain, subset, seed, chances
        self.classes = len(weights)

    def drawn(self, tree: int, block: int, rows: int, draws: np.ndarray | None) -> np.ndarray:
        """How often a tree draws each row of a block."""
        if draws is not None:
            return draws[tree]
        if self.chances is None:
            return np.ones(rows, np.uint8)
        rng = np.random.Generator(np.random.PCG64([self.seed & (2 ** 63 - 1), tree, block]))
        return self.chances.take(rng.integers(0, 1 << 16, rows, np.uint16))

    def subsets(self, tree: int, heap: np.ndarray) -> np.ndarray:
        """(nodes, subset): the features that each node may split by, ascending."""
        start = mixed(np.array([self.seed & (2 ** 63 - 1), tree], np.uint64))
        node = mixed(heap.astype(np.uint64) ^ start[0] ^ (start[1] << np.uint64(1)))
        order = mixed(node[:, None] ^ mixed(np.arange(1, self.features + 1, dtype=np.uint64)))
        return np.sort(np.argpartition(order, self.subset - 1, 1)[:, :self.subset], 1)

    def open(self, heap: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Nodes that may be split: not at the last level, of two classes or more."""
        return (heap < 1 << self.depth) & (((total * self.weights) > 0).sum(-1) > 1)


def class_sums(bins: np.ndarray, row: np.ndarray, place: np.ndarray, label: np.ndarray, count: np.ndarray, subset: np.ndarray,
               classes: int) -> np.ndarray:
    """(nodes, subset, classes, bins): drawn rows at ``place`` by the features of their node's subset."""
    nodes, width, rows = len(subset), subset.shape[1], bins.shape[1]
    flat, out = bins.reshape(-1), np.empty((nodes, width, classes, BINS))
    at = (place * classes + label) * BINS
    for s in range(width):
        value = flat.take((subset[:, s] * rows).take(place) + row)
        out[:, s] = np.bincount(at + value, count, nodes * classes * BINS).reshape(nodes, classes, BINS)
    return out


def best_splits(sums: np.ndarray, subset: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """(gain, feature, bits of the bins that go left, drawn rows by class, those of the left child) of each node."""
    total = sums[:, 0].sum(-1)
    left = np.cumsum(sums, -1)
    masks = np.broadcast_to((np.int64(2) << np.arange(BINS)) - 1, (*subset.shape, BINS)).copy()
    for f, arity in spec.sets.items():
        node, slot = np.nonzero(subset == f)
        if not len(node):
            continue
        own = sums[node, slot]
        if arity <= FEW_CATEGORIES:  # each set without the last category, the others empty
            choice = np.arange(BINS) * (np.arange(BINS) < 1 << max(arity - 1, 0))
            left[node, slot] = own @ (choice >> np.arange(BINS)[:, None] & 1).astype(float)
            masks[node, slot] = choice
        else:
            share = own * spec.weights[:, None]
            size = share.sum(1)
            p = share / np.maximum(size, 1e-300)[:, None]
            centroid = p[:, 1] if spec.classes == 2 else 1 - (p * p).sum(1)
            order = np.argsort(np.where(size > 0, centroid, np.inf), -1, kind="stable")
            left[node, slot] = np.cumsum(np.take_along_axis(own, order[:, None], -1), -1)
            masks[node, slot] = np.cumsum(np.int64(1) << order, -1)
    below = left.sum(2)
    enough = (below >= spec.min_rows) & (total.sum(-1)[:, None, None] - below >= spec.min_rows)
    whole = total * spec.weights
    weight = np.maximum(whole.sum(-1), 1e-300)
    own = left * spec.weights[:, None]
    rest = whole[:, None, :, None] - own
    score = (own * own).sum(2) / np.maximum(own.sum(2), 1e-300) + (rest * rest).sum(2) / np.maximum(rest.sum(2), 1e-300)
    gain = (score - ((whole * whole).sum(-1) / weight)[:, None, None]) / weight[:, None, None]
    flat = np.where(enough, gain, -np.inf).reshape(len(sums), -1)
    at = flat.argmax(1)
    i, slot, b = np.arange(len(sums)), at // BINS, at % BINS
    return flat[i, at], subset[i, slot], masks[i, slot, b], total, left[i, slot, :, b]


class Nodes:
    """Nodes of one tree: numbers in the heap (root 1, children 2 h and 2 h + 1), features (-1: leaf), bits of the
    bins that go left, gains and drawn rows by class."""

    def __init__(self, heap, feature, mask, gain, total):
        order = np.argsort(heap)
        self.heap, self.feature, self.mask, self.gain, self.total = (np.asarray(x)[order] for x in (heap, feature, mask, gain, total))

    @classmethod
    def joined(cls, parts: list[tuple]) -> Nodes:
        return cls(*(np.concatenate(x) for x in zip(*parts)))

    def children(self) -> np.ndarray:
        """(nodes, 2): the places of both children, a leaf's own place for leaves."""
        out = np.repeat(np.arange(len(self.heap))[:, None], 2, 1)
        inner = self.feature >= 0
        out[inner] = np.searchsorted(self.heap, self.heap[inner][:, None] * 2 + np.arange(2))
        return out

    def merged(self, weights: np.ndarray) -> Nodes:
        """Without the pairs of leaves that predict one class, from the bottom up (as Spark's trees)."""
        guess, child, keep = (self.total * weights).argmax(1), self.children(), np.ones(len(self.heap), bool)
        level = np.frexp(self.heap.astype(float))[1]
        for d in range(level.max(initial=0), 0, -1):
            at = np.flatnonzero((level == d) & (self.feature >= 0))
            a, b = child[at, 0], child[at, 1]
            same = (self.feature[a] < 0) & (self.feature[b] < 0) & (guess[a] == guess[b])
            self.feature[at[same]], self.gain[at[same]] = -1, 0.0
            keep[a[same]] = keep[b[same]] = False
        return Nodes(self.heap[keep], self.feature[keep], self.mask[keep], self.gain[keep], self.total[keep])

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(features, next places by place and bin) that take a row one level down."""
        right = 1 - (self.mask[:, None] >> np.arange(BINS) & 1)
        return np.maximum(self.feature, 0), np.take_along_axis(self.children(), right, 1).astype(np.int32).reshape(-1)


def placed(bins: np.ndarray, row: np.ndarray, feature: np.ndarray, step: np.ndarray, levels: int) -> np.ndarray:
    """The places that rows reach after ``levels`` steps from the root."""
    flat, rows = bins.reshape(-1), bins.shape[1]
    start = feature * rows
    at = np.zeros(len(row), np.int64)
    for _ in range(levels):
        at = step.take(at * BINS + flat.take(start.take(at) + row))
    return at


def subtree(tree: int, root: int, bins: np.ndarray, label: np.ndarray, count: np.ndarray, spec: Spec) -> Nodes:
    """The tree below one node from its drawn rows: (features, rows) bins, labels and counts."""
    rows = bins.shape[1]
    flat, row, label, count = bins.reshape(-1), np.arange(rows), label.astype(np.int64), count.astype(float)
    place, heap = np.zeros(rows, np.int64), np.array([root])
    total = np.bincount(label, count, spec.classes)[None]
    if not spec.open(heap, total)[0]:
        return Nodes(heap, np.array([-1]), np.zeros(1, np.int64), np.zeros(1), total)
    parts = []
    while len(heap):
        found = []
        if len(heap) > CHUNK:  # rows of a chunk lie together
            order = np.argsort(place.astype(np.uint16) if len(heap) <= 1 << 16 else place, kind="stable")
            row, place, label, count = row[order], place[order], label[order], count[order]
        for start in range(0, len(heap), CHUNK):
            a, z = (np.searchsorted(place, (start, start + CHUNK)) if len(heap) > CHUNK else (0, len(place)))
            subset = spec.subsets(tree, heap[start:start + CHUNK])
            sums = class_sums(bins, row[a:z], place[a:z] - start, label[a:z], count[a:z], subset, spec.classes)
            found.append(best_splits(sums, subset, spec))
        gain, feature, mask, total, left = (np.concatenate(x) for x in zip(*found))
        split = gain > spec.least_gain
        parts.append((heap, np.where(split, feature, -1), mask, np.where(split, gain, 0.0), total))
        child = np.stack([heap * 2, heap * 2 + 1], 1)
        below = np.stack([left, total - left], 1)
        still = split[:, None] & spec.open(child, below)
        ends = split[:, None] & ~still
        n = int(ends.sum())
        parts.append((child[ends], np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), below[ends]))
        to = np.where(still, np.cumsum(still).reshape(still.shape) - 1, -1)
        value = flat.take((np.maximum(feature, 0) * rows).take(place) + row)
        place = to.reshape(-1).take(place * 2 + 1 - (mask.take(place) >> value & 1))
        stay = np.flatnonzero(place >= 0)
        row, place, label, count = row[stay], place[stay], label[stay], count[stay]
        heap = child[still]
    return Nodes.joined(parts)


class _Block:
    """A stored record: (features, rows) bins, a label a row, (trees, rows) counts where they are given."""

    def __init__(self, b: pa.RecordBatch, at: int, features: int):
        array = lambda c: np.frombuffer(b.column(c)[at].as_buffer(), np.uint8)
        self.number, self.rows, self.label = b.column("block")[at].as_py(), b.column("rows")[at].as_py(), array("label")
        self.bins = array("bins").reshape(features, -1)
        draws = array("draws")
        self.draws = draws.reshape(-1, self.rows) if len(draws) else None

    def reached(self, tree: int, way: tuple, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, the numbers of their nodes, counts) of the drawn rows that reach a wanted node."""
        feature, step, wanted, levels = way
        count = spec.drawn(tree, self.number, self.rows, self.draws)
        row = np.flatnonzero(count)
        place = wanted.take(placed(self.bins, row, feature, step, levels))
        stay = np.flatnonzero(place >= 0)
        row = row[stay]
        return row, place[stay], count[row]


def _ways(trees: dict[int, Nodes], wanted: dict[int, np.ndarray]) -> dict[int, tuple]:
    """For each tree: (features, steps, number of the wanted node at each place, levels down to them)."""
    out = {}
    for t, heaps in wanted.items():
        nodes = trees[t]
        number = np.full(len(nodes.heap), -1)
        number[np.searchsorted(nodes.heap, heaps)] = np.arange(len(heaps))
        out[t] = (*nodes.table(), number, int(heaps.max()).bit_length() - 1)
    return out


def _pass(blocks: DataFrame, ways: dict[int, tuple], spec: Spec, each, schema: str) -> DataFrame:
    """``each(tree, block, rows, places, counts)`` of every block and tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, spec.features)
                for t, way in ways.items():
                    yield from each(t, block, *block.reached(t, way, spec))
    return blocks.mapInArrow(run, schema)


def split_heavy(blocks: DataFrame, trees: dict[int, Nodes], wanted: dict[int, np.ndarray], spec: Spec, tasks: int) -> dict[int, tuple]:
    """The splits of the wanted nodes from sums over all blocks: {tree: (heap, gain, feature, mask, total, left)}."""
    ways = _ways(trees, wanted)
    subsets = {t: spec.subsets(t, heaps) for t, heaps in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, spec.features)
                for t, way in ways.items():
                    row, place, count = block.reached(t, way, spec)
                    own = class_sums(block.bins, row, place, block.label.take(row), count.astype(float), subsets[t], spec.classes)
                    if t in sums:
                        sums[t] += own
                    else:
                        sums[t] = own
        for t, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(own), pa.int32()), pa.array(wanted[t], pa.int64()),
                                              pa.array([x.tobytes() for x in own], pa.binary())], ["tree", "heap", "sums"])

    def pick(key: tuple, table: pa.Table) -> pa.Table:
        t, heap = (k.as_py() for k in key)
        shape = (1, spec.subset, spec.classes, BINS)
        sums = sum(np.frombuffer(x.as_buffer()) for x in table["sums"]).reshape(shape)
        gain, feature, mask, total, left = best_splits(sums, spec.subsets(t, np.array([heap])), spec)
        return pa.table([[t], [heap], pa.array(feature, pa.int32()), mask, gain, [total.tobytes()], [left.tobytes()]],
                        schema=_arrow(SPLITS))

    found = blocks.mapInArrow(run, SUMS).repartition(tasks, "tree", "heap").groupBy("tree", "heap").applyInArrow(pick, SPLITS).toArrow()
    out, of = {}, found["tree"].to_numpy()
    classes = lambda c, at: np.stack([np.frombuffer(x) for x in c.take(at).to_pylist()])
    for t in wanted:
        at = np.flatnonzero(of == t)
        heap, gain, feature, mask = (found[c].to_numpy()[at] for c in ("heap", "gain", "feature", "mask"))
        out[t] = heap, gain, feature, mask, classes(found["total"], at), classes(found["left"], at)
    return out


def grow_light(blocks: DataFrame, trees: dict[int, Nodes], wanted: dict[int, np.ndarray], spec: Spec, tasks: int) -> dict[int, list[tuple]]:
    """The subtrees of the wanted nodes, each grown by one task from its own rows: {tree: [arrays of nodes]}."""
    def parts(t: int, block: _Block, row: np.ndarray, place: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(place.astype(np.uint16) if len(wanted[t]) <= 1 << 16 else place, kind="stable")
        row, count = row[order], count[order]
        ends = np.cumsum(np.bincount(place, minlength=len(wanted[t])))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        bins, label = block.bins[:, row], block.label[row]
        cuts = [(0 if i == 0 else ends[i - 1], ends[i]) for i in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t] * len(some), pa.int32()), pa.array(wanted[t][some], pa.int64()),
             *(pa.array([x[..., a:z].tobytes() for a, z in cuts], pa.binary()) for x in (bins, label, count))],
            ["tree", "heap", "bins", "label", "drawn"])

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        t, heap = (k.as_py() for k in key)
        arrays = lambda c: [np.frombuffer(x.as_buffer(), np.uint8) for x in table[c]]
        bins = np.concatenate([x.reshape(spec.features, -1) for x in arrays("bins")], 1)
        n = subtree(t, heap, bins, np.concatenate(arrays("label")), np.concatenate(arrays("drawn")), spec).merged(spec.weights)
        return pa.table([[t] * len(n.heap), n.heap, pa.array(n.feature, pa.int32()), n.mask, n.gain, [x.tobytes() for x in n.total]],
                        schema=_arrow(NODES))

    moved = _pass(blocks, _ways(trees, wanted), spec, parts, PARTS)
    found = moved.repartition(tasks, "tree", "heap").groupBy("tree", "heap").applyInArrow(grow, NODES).toArrow()
    out, of = {}, found["tree"].to_numpy()
    total = np.frombuffer(b"".join(found["total"].to_pylist())).reshape(-1, spec.classes)
    for t in wanted:
        at = np.flatnonzero(of == t)
        out[t] = [(*(found[c].to_numpy()[at] for c in ("heap", "feature", "mask", "gain")), total[at])]
    return out


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _leaves(heap, total) -> tuple:
    n = len(heap)
    return np.asarray(heap, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.asarray(total).reshape(n, -1)


def grown(blocks: DataFrame, rows: int, trees: list[int], spec: Spec) -> dict[int, Nodes]:
    """The trees of these numbers over stored blocks of ``rows`` rows."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    blocks, tasks = blocks.coalesce(2 * cores), 4 * cores
    done: dict[int, Nodes] = {}
    width = max(1, GROUP_ROWS // max(rows, 1))
    for start in range(0, len(trees), width):
        group = trees[start:start + width]
        parts = {t: [_leaves([1], np.zeros((1, spec.classes)))] for t in group}  # nodes so far, open ones as leaves
        root = np.ones(1, np.int64)
        heavy = {t: root for t in group} if rows > LOCAL_ROWS else {}
        light = {} if heavy else {t: [root] for t in group}
        while heavy:
            found = split_heavy(blocks, {t: Nodes.joined(parts[t]) for t in heavy}, heavy, spec, tasks)
            heavy = {}
            for t, (heap, gain, feature, mask, total, left) in found.items():
                split = (gain > spec.least_gain) & spec.open(heap, total)
                child = np.stack([heap * 2, heap * 2 + 1], 1)[split].reshape(-1)
                below = np.stack([left, total - left], 1)[split].reshape(-1, spec.classes)
                nodes = Nodes.joined(parts[t])
                at = np.searchsorted(nodes.heap, heap)
                nodes.feature[at], nodes.mask[at], nodes.gain[at], nodes.total[at] = np.where(split, feature, -1), mask, np.where(split, gain, 0.0), total
                parts[t] = [(nodes.heap, nodes.feature, nodes.mask, nodes.gain, nodes.total), _leaves(child, below)]
                go, big = spec.open(child, below), below.sum(1) > LOCAL_ROWS
                if (go & big).any():
                    heavy[t] = child[go & big]
                if (go & ~big).any():
                    light.setdefault(t, []).append(child[go & ~big])
        if light:
            wanted = {t: np.sort(np.concatenate(heaps)) for t, heaps in light.items()}
            nodes = {t: Nodes.joined(parts[t]) for t in wanted}
            for t, below in grow_light(blocks, nodes, wanted, spec, tasks).items():
                n = nodes[t]
                rest = ~np.isin(n.heap, np.concatenate([b[0] for b in below]))  # a drawn node's subtree holds its root
                parts[t] = [(n.heap[rest], n.feature[rest], n.mask[rest], n.gain[rest], n.total[rest]), *below]
        for t in group:
            done[t] = Nodes.joined(parts[t]).merged(spec.weights)
        if start + width < len(trees):
            blocks.sparkSession._jvm.System.gc()  # lets Spark delete the shuffle files of this group
    return done


def shares(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The values of several (values, weights) in order, with the sums of their weights."""
    if not parts:
        return np.zeros(0), np.zeros(0)
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(place, np.concatenate([w for _, w in parts]), len(values))


def fewer(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of more than ``POINTS`` values in order that end equal shares, each with the weight up to it."""
    if len(values) <= POINTS:
        return values, weight.astype(float)
    upto = np.cumsum(weight)
    at = np.unique(np.searchsorted(upto, upto[-1] * (np.arange(1, POINTS + 1) / POINTS)).clip(max=len(values) - 1))
    return values[at], np.diff(upto[at], prepend=0).astype(float)


def value_shares(rows: DataFrame, features: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """{(class, feature): (values, rows)} of all rows' numbers (no NaN): exact up to ``POINTS`` values, else shares of
    1 / ``POINTS`` of each task's ``SKETCH_ROWS`` rows and of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def summary() -> pa.RecordBatch:
            x, y = (np.concatenate(part) for part in zip(*held))
            held.clear()
            out = []
            for k in np.unique(y):
                for f, column in enumerate(x[y == k].T):
                    values, weight = fewer(*np.unique(column[~np.isnan(column)], return_counts=True))
                    out.append((int(k), f, values.tobytes(), weight.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _arrow(SHARES).types)], _arrow(SHARES).names)

        for b in batches:
            if b.num_rows:
                held.append((b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, features), b.column("y").to_numpy()))
            if sum(len(h[1]) for h in held) >= SKETCH_ROWS:
                yield summary()
        if held:
            yield summary()

    def merge(table: pa.Table) -> pa.Table:
        arrays = [[np.frombuffer(x.as_buffer()) for x in table[c]] for c in ("points", "weights")]
        values, weight = fewer(*shares(list(zip(*arrays))))
        return pa.table([table["y"][:1], table["feature"][:1], [values.tobytes()], [weight.tobytes()]], schema=_arrow(SHARES))

    found = rows.select("x", "y").mapInArrow(run, SHARES).groupBy("y", "feature").applyInArrow(merge, SHARES).collect()
    return {(r["y"], r["feature"]): (np.frombuffer(r["points"]), np.frombuffer(r["weights"])) for r in found}


class Forest(RandomForestClassifier):
    """``RandomForestClassifier``; ``fit_many`` gives the same kind of model from many rows."""

    def _spec(self, df: DataFrame, rows: DataFrame) -> tuple[Spec, int] | None:
        """The spec of a fit and its rows; None where Spark's own fit has to do it."""
        share = rows.groupBy("y").agg(F.min("w").alias("a"), F.max("w").alias("z"), F.count(F.lit(1)).alias("n")).collect()
        attr = df.schema[self.getLabelCol()].metadata.get("ml_attr", {})
        classes = max(len(attr.get("vals", [])) or attr.get("num_vals", 0), 1 + max((r["y"] for r in share), default=-1))
        even = all(r["a"] is not None and r["a"] == r["z"] >= 0 for r in share)
        if not share or not even or classes > MAX_CLASSES or self.getMaxBins() != BINS or self.getImpurity() != "gini":
            return None
        weights = np.ones(classes)
        for r in share:
            weights[r["y"]] = r["a"]
        attrs = df.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        sets = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in attrs.get("nominal", [])}
        if max(sets.values(), default=0) > BINS:
            raise ValueError(f"a category with more than {BINS} values (of Spark ML's trees, too): {sets}")
        features = rows.select(F.size("x")).first()[0]
        kind = self.getFeatureSubsetStrategy()
        subset = {"sqrt": math.ceil(math.sqrt(features)), "auto": math.ceil(math.sqrt(features)) if self.getNumTrees() > 1 else features,
                  "all": features, "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3)}.get(kind)
        if subset is None or self.getOrDefault(self.minWeightFractionPerNode) > 0 or (not self.getBootstrap() and self.getSubsamplingRate() < 1):
            return None
        chances = poisson_table(self.getSubsamplingRate()) if self.getBootstrap() else None
        spec = Spec(features, weights, sets, self.getMaxDepth(), self.getMinInstancesPerNode(), max(LEAST_GAIN, self.getMinInfoGain()),
                    subset, self.getSeed(), chances)
        return spec, sum(r["n"] for r in share)

    def _edges(self, rows: DataFrame, spec: Spec) -> list[np.ndarray]:
        """Upper ends of the bins: between the values where few are found, of equal shares of the weight else
        (which is the same in all rows of a class); of each category."""
        found: dict[int, list] = {}
        for (y, f), points in value_shares(rows, spec.features).items():
            found.setdefault(f, []).append((points[0], points[1] * spec.weights[y]))
        out = []
        for i in range(spec.features):
            if i in spec.sets:
                out.append(np.arange(spec.sets[i] - 1.0))
                continue
            values, weight = shares(found.get(i, []))
            if len(values) <= BINS:
                out.append((values[:-1] + values[1:]) / 2)
                continue
            upto = np.cumsum(weight)
            out.append(np.unique(values[np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)]))
        return out

    def _blocks(self, rows: DataFrame, edges: list[np.ndarray], features: int, draws: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held, made, first = [], 0, TaskContext.get().partitionId() << 32

            def block() -> pa.RecordBatch:
                nonlocal made
                bins, label, count = (np.concatenate(x) for x in zip(*held))
                held.clear()
                made += 1
                return pa.RecordBatch.from_arrays(
                    [pa.array([first + made], pa.int64()), pa.array([len(label)], pa.int64()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (np.ascontiguousarray(bins.T), label, np.ascontiguousarray(count.T)))],
                    ["block", "rows", "bins", "label", "draws"])

            for b in batches:
                if held and sum(len(h[1]) for h in held) + b.num_rows > BLOCK_ROWS:
                    yield block()
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, features)
                    count = b.column("draws").flatten().to_numpy(zero_copy_only=False) if draws else np.zeros(0)
                    held.append((binned(x, edges), b.column("y").to_numpy().astype(np.uint8), count.astype(np.uint8).reshape(b.num_rows, -1)))
            if held:
                yield block()

        parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
        return stored(rows.mapInArrow(run, BLOCK).repartition(parts), "forest-blocks")

    def trees_of(self, df: DataFrame, draws: str | None = None) -> tuple[Spec, list[np.ndarray], dict[int, Nodes]] | None:
        """(spec, bin edges, trees); the rows are stored with plain arrays and scanned four times until they
        lie in blocks.

        ``draws`` is a column with an array of every tree's counts; without it they are drawn.  None:
        rows that only Spark's own fit takes.
        """
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) and not draws else F.lit(1.0)
        rows = stored(df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"),
                                weight.alias("w"), *([F.col(draws).alias("draws")] if draws else [])), "forest-rows")
        found = self._spec(df, rows)
        if found is None:
            dropped(rows)
            return None
        spec, n = found
        edges = self._edges(rows, spec)
        blocks = self._blocks(rows, edges, spec.features, draws is not None)
        dropped(rows)
        trees = grown(blocks, n, list(range(self.getNumTrees())), spec)
        dropped(blocks)
        return spec, edges, trees

    def fit_many(self, df: DataFrame) -> RandomForestClassificationModel | None:
        """The fitted model, or None where Spark's own fit has to do it."""
        found = self.trees_of(df)
        return None if found is None else self._model(df.sparkSession, *found)

    def _model(self, spark, spec: Spec, edges: list[np.ndarray], trees: dict[int, Nodes]) -> RandomForestClassificationModel:
        path = scratch_path(spark, "forest")
        about = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {}}
        params = {"maxDepth": spec.depth, "maxBins": BINS, "impurity": "gini", "seed": self.getSeed()}
        head = {**about, "class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "uid": self.uid,
                "paramMap": {**params, "numTrees": len(trees)}, "numFeatures": spec.features, "numClasses": spec.classes, "numTrees": len(trees)}
        each = {**about, "class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "paramMap": params}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        names = [(t, json.dumps({**each, "uid": f"{self.uid}_{t}"}), 1.0) for t in trees]
        spark.createDataFrame(names, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(pa.concat_tables([node_table(t, n, spec, edges) for t, n in trees.items()])).coalesce(1).write.parquet(f"{path}/data")
        return self._copyValues(RandomForestClassificationModel.load(path))


def node_table(tree: int, nodes: Nodes, spec: Spec, edges: list[np.ndarray]) -> pa.Table:
    """The nodes of one tree as Spark ML stores them."""
    n, inner, child = len(nodes.heap), nodes.feature >= 0, nodes.children()
    stats = nodes.total * spec.weights
    size = np.maximum(stats.sum(1), 1e-300)
    impurity = 1 - ((stats / size[:, None]) ** 2).sum(1)
    values, categories = [], np.full(n, -1)
    for i, f in enumerate(nodes.feature):
        if f < 0:
            values.append([])
        elif f in spec.sets:
            categories[i] = spec.sets[f]
            values.append([float(b) for b in range(spec.sets[f]) if nodes.mask[i] >> b & 1])
        else:
            values.append([float(edges[f][int(nodes.mask[i]).bit_length() - 1])])
    ints = lambda x: pa.array(x, pa.int32())
    split = pa.StructArray.from_arrays([ints(nodes.feature), pa.array(values, pa.list_(pa.float64())), ints(categories)],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays(
        [ints(np.arange(n)), pa.array(stats.argmax(1).astype(float)), pa.array(np.maximum(impurity, 0.0)),
         pa.array(list(stats), pa.list_(pa.float64())), pa.array(nodes.total.sum(1).astype(np.int64)),
         pa.array(np.where(inner, nodes.gain, -1.0)), ints(np.where(inner, child[:, 0], -1)), ints(np.where(inner, child[:, 1], -1)), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table([ints([tree] * n), data], ["treeID", "nodeData"])


def unseen_votes(spec: Spec, edges: list[np.ndarray], trees: dict[int, Nodes]):
    """A column function of (array of features, array of draws): the class that the trees which did not draw
    the row vote for (sums of their class shares, ties to the first class); NULL without such trees."""
    ways = []
    for t, n in sorted(trees.items()):
        stats = n.total * spec.weights
        ways.append((t, *n.table(), stats / np.maximum(stats.sum(1, keepdims=True), 1e-300), int(n.heap.max()).bit_length() - 1))

    @F.pandas_udf("int")
    def vote(x: pd.Series, draws: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="Int32")
        bins = np.ascontiguousarray(binned(np.stack(x.to_numpy()), edges).T)
        drawn = np.ascontiguousarray(np.stack(draws.to_numpy()).T)
        votes = np.zeros((len(x), spec.classes))
        for t, feature, step, share, levels in ways:
            row = np.flatnonzero(drawn[t] == 0)
            votes[row] += share[placed(bins, row, feature, step, levels)]
        return pd.Series(np.where(votes.sum(1) > 0, votes.argmax(1), -1)).astype("Int32").replace(-1, pd.NA)

    return vote
