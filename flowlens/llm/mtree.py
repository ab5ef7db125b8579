"""Exact top-k search with M-trees, best first.

Metric.  Searching the largest inner products is a nearest-neighbour search: with M the
largest norm of all vectors, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) satisfy
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so order by score is order by Euclidean distance.

Index.  Pivots (a bounded number of distinct vectors, least hash first) are the tree's top
level: every vector goes to its nearest pivot.  A pivot's vectors are dealt by hash to as
many page groups as their number asks for, so a pivot with a third of all rows becomes
many groups of about ``GROUP_ROWS``.  Each group becomes a subtree: routing objects chosen
among its vectors, paged leaves of up to ``PAGE_ROWS`` entries, and for every node and entry
the covering radius and the distance to its parent.  The index is written to the shared
folder, one row a subtree.

Search.  Queries come in blocks of ``QUERY_BLOCK`` (a bounded broadcast).  In a task a query
keeps a heap of nodes by least possible distance over all subtrees of the task.  A popped
node whose bound exceeds the k-th best distance ends the query's search.  Entries whose
stored parent distance already excludes them (|d(q, parent) - d(x, parent)| too large) are
never computed.  Each block searches twice: first the subtrees of each query's nearest
pivot, which bounds its k-th distance; then all others with that bound.  Bounds have a
relative slack far above rounding, and scores are exact integers, so results are exact.

Results.  Components become floor(1024 x); vectors that are null or hold a null or
non-finite component take no part, nor do rows without an id.  Shorter vectors count as
padded with zeros.  A query's own row is every row of its id; of repeated query ids one
vector (the least) asks.  Ties go to the smaller vec_id; repeated candidates are rows of
their own.  Scores saturate at 64-bit integers.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import batch_rows, shared_path, written

SCALE = 1024
MAX_PIVOTS = 256
GROUP_ROWS = 4096
PAGE_ROWS = 256
QUERY_BLOCK = 8192
TREES_AT_ONCE = 16  # subtrees a task holds
SLACK = 1e-7
TREE = "pivot int, chunk int, tree binary"


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): integer components of the vectors that take part."""
    x = F.col("embedding")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return (embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & usable)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v")))


def matrix(rows: pa.Array, dim: int) -> np.ndarray:
    """A list column as a padded matrix of doubles (exact for the components met here)."""
    offsets, flat = np.asarray(rows.offsets), np.asarray(rows.flatten(), np.float64)
    sizes = np.diff(offsets)
    if sizes.size and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((sizes.size, dim))
    at = np.repeat(np.arange(sizes.size), sizes)
    out[at, np.arange(flat.size) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes all norms equal."""
    return np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of x and those of y."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0.0))


def exact_scores(v: np.ndarray, q: np.ndarray, peak: float) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles by Python integers.
    ``peak``: the largest absolute component of ``v``."""
    if peak * float(np.abs(q).max(initial=0)) * max(1, q.size) < 2.0 ** 52:
        return (v @ q).astype(np.int64)
    ints = [int(x) for x in q]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([max(low, min(high, sum(int(a) * b for a, b in zip(row, ints)))) for row in v], np.int64)


class Subtree:
    """An M-tree over the vectors of one page group.

    Nodes are stored as arrays: ``routing[n]`` the routing object, ``radius[n]`` its covering
    radius, ``to_parent[n]`` the distance to the parent's routing object, ``children[n]`` the
    child nodes or, for leaves, the slice of entries; ``entry_to_parent`` the entries'
    distances to their leaf's routing object.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        points = lifted(vectors, top)
        self.order: list[np.ndarray] = []
        self.routing: list[np.ndarray] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[tuple] = []
        self.entry_to_parent: list[np.ndarray] = []
        self._filled = 0
        self._build(points, np.arange(ids.size), None)
        order = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
        self.ids, self.vectors = ids[order], vectors[order]
        self.entries = np.concatenate(self.entry_to_parent) if self.order else np.empty(0)
        self.order, self.entry_to_parent = [], []

    def _build(self, points: np.ndarray, rows: np.ndarray, parent: np.ndarray | None) -> int:
        """Adds the node of ``rows`` and everything below it; returns its number."""
        mine = points[rows]
        centre = mine[int(np.argmin(((mine - mine.mean(axis=0)) ** 2).sum(axis=1)))]  # the medoid-like object
        d = distances(mine, centre[None])[:, 0]
        node = len(self.radius)
        self.routing.append(centre)
        self.radius.append(float(d.max()))
        self.to_parent.append(0.0 if parent is None else float(distances(centre[None], parent[None])[0, 0]))
        self.children.append(())
        if rows.size <= PAGE_ROWS:
            self.children[node] = ("leaf", self._filled, self._filled + rows.size)
            self.order.append(rows)
            self.entry_to_parent.append(d)
            self._filled += rows.size
            return node
        # Spread routing objects: farthest from those chosen so far; rows go to the nearest.
        fan = min(8, -(-rows.size // PAGE_ROWS) + 1)
        nearest = d
        share, owner = distances(mine, centre[None])[:, 0], np.zeros(rows.size, np.int64)
        for k in range(1, fan):
            pick = mine[int(np.argmax(nearest))]
            new = distances(mine, pick[None])[:, 0]
            owner[new < share] = k
            share = nearest = np.minimum(share, new)
        groups = [rows[owner == k] for k in range(fan) if (owner == k).any()]
        if max(g.size for g in groups) > 0.9 * rows.size:  # equal or far too close: halve
            groups = [rows[: rows.size // 2], rows[rows.size // 2:]]
        self.children[node] = ("inner", [self._build(points, g, centre) for g in groups])
        return node

    def seal(self) -> bytes:
        self.routing = np.stack(self.routing)
        self.radius, self.to_parent = np.array(self.radius), np.array(self.to_parent)
        if np.abs(self.vectors).max(initial=0) < 2 ** 31:
            self.vectors = self.vectors.astype(np.int32)
        return pickle.dumps(self, protocol=5)

    @staticmethod
    def load(data: bytes) -> Subtree:
        tree = pickle.loads(data)
        tree.vectors = tree.vectors.astype(np.float64)
        tree.peak = float(np.abs(tree.vectors).max(initial=0))
        return tree


def search(trees: list[Subtree], query_id: int, q: np.ndarray, top: float, k: int, bound: float) -> list[tuple[int, int]]:
    """The query's k best (score, vec_id) in ``trees`` among those no farther than ``bound``."""
    q_norm = float(q @ q)
    point = np.append(q, 0.0)
    scale = 1.0 + np.sqrt(q_norm + top)
    slack = SLACK * scale
    best: list[tuple[int, int]] = []  # heap of (score, -vec_id), worst first
    limit = bound + slack
    heap: list[tuple[float, int, int, float]] = []
    roots = distances(point[None], np.stack([t.routing[0] for t in trees]))[0] if trees else []
    for t, d in enumerate(roots):
        heap.append((max(0.0, d - trees[t].radius[0]), t, 0, float(d)))
    heapq.heapify(heap)
    while heap:
        least, t, node, d = heapq.heappop(heap)
        if least > limit:
            break
        tree = trees[t]
        what = tree.children[node]
        if what[0] == "inner":
            kids = np.array(what[1])
            # Triangle inequality on stored distances first; only what is left is computed.
            kids = kids[np.abs(d - tree.to_parent[kids]) - tree.radius[kids] <= limit]
            if kids.size:
                far = distances(point[None], tree.routing[kids])[0]
                for x, n in zip(far, kids):
                    low = max(0.0, float(x) - tree.radius[n])
                    if low <= limit:
                        heapq.heappush(heap, (low, t, int(n), float(x)))
            continue
        _, a, b = what
        at = a + np.flatnonzero(np.abs(d - tree.entries[a:b]) <= limit)
        at = at[tree.ids[at] != query_id]
        if not at.size:
            continue
        scores = exact_scores(tree.vectors[at], q, tree.peak)
        if len(best) == k:  # only what could enter the list is looked at one by one
            could = scores >= best[0][0]
            scores, at = scores[could], at[could]
        for score, vec in zip(scores.tolist(), tree.ids[at].tolist()):
            if len(best) < k:
                heapq.heappush(best, (score, -vec))
            elif (score, -vec) > best[0]:
                heapq.heapreplace(best, (score, -vec))
        if len(best) == k:
            limit = min(limit, float(np.sqrt(max(0.0, q_norm + top - 2.0 * best[0][0]))) + slack)
    return [(s, -v) for s, v in best]


def build_index(vectors: DataFrame, folder: str) -> tuple[DataFrame, np.ndarray, float, int]:
    """(subtree rows, lifted pivots, largest squared norm, dimension) of ``vectors``."""
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    total = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("dim")).first()
    n, top, dim = total["n"], float(total["top"] or 0.0), int(total["dim"] or 0)
    count = max(1, min(MAX_PIVOTS, -(-n // GROUP_ROWS)))
    chosen = (vectors.select(F.xxhash64("v").alias("h"), "v").groupBy("h").agg(F.min("v").alias("v"))
              .orderBy("h").limit(count).collect())
    pivots = np.zeros((max(1, len(chosen)), dim))
    for row, r in zip(pivots, chosen):
        row[:len(r["v"])] = r["v"]
    pivots = lifted(pivots, top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = distances(lifted(matrix(b.column("v"), dim), top), pivots).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["vec_id", "v", "pivot"])

    placed = written(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, pivot int"), "placed")
    # At most MAX_PIVOTS rows of two numbers.
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("chunks"))
    grouped = (placed.join(F.broadcast(sizes), "pivot")
               .withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int")))

    def subtree(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("vec_id")
        column = rows.column("v").combine_chunks()
        tree = Subtree(np.asarray(rows.column("vec_id")), matrix(column, dim), top)
        return pa.table({"pivot": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()),
                         "tree": pa.array([tree.seal()], pa.binary())})

    trees = grouped.select("pivot", "chunk", "vec_id", "v").groupBy("pivot", "chunk").applyInArrow(subtree, TREE)
    trees.write.parquet(f"{folder}/trees")
    return spark.read.schema(TREE).parquet(f"{folder}/trees"), pivots, top, dim


def _searched(trees: DataFrame, block: list, home: np.ndarray, bounds: dict[int, float], top: float, dim: int, k: int,
              at_home: bool) -> DataFrame:
    """Candidates (query_id, vec_id, score) of a block of queries from their home subtrees, or
    from all others."""
    q = np.zeros((len(block), dim))
    for row, r in zip(q, block):
        row[:len(r["v"])] = r["v"]
    ids = np.array([r["vec_id"] for r in block], np.int64)
    limits = np.array([bounds.get(int(i), np.inf) for i in ids])
    shared = trees.sparkSession.sparkContext.broadcast((ids, q, home, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, home, limits = shared.value
        limits = limits.copy()
        for b in batches:
            pivots = b.column("pivot").to_pylist()
            loaded = [Subtree.load(t) for t in b.column("tree").to_pylist()]
            found: list[tuple[int, int, int]] = []
            for n in range(ids.size):
                mine = [t for p, t in zip(pivots, loaded) if (p == home[n]) == at_home]
                best = search(mine, int(ids[n]), q[n], top, k, limits[n])
                found += [(int(ids[n]), vec, score) for score, vec in best]
                if len(best) == k:
                    square = float(q[n] @ q[n]) + top - 2.0 * min(s for s, _ in best)
                    limits[n] = min(limits[n], np.sqrt(max(0.0, square)))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return trees.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(embeddings: DataFrame, asks: str = "vec_id % 100 = 0", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every row that ``asks``."""
    spark = embeddings.sparkSession
    vectors = quantised(embeddings)
    trees, pivots, top, dim = build_index(vectors, shared_path(spark, "mtree"))
    queries = written(vectors.filter(asks).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    found: DataFrame | None = None
    for number in range(blocks):
        # About QUERY_BLOCK rows: a bounded share of the queries, whatever their number.
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        if not block:
            continue
        q = np.zeros((len(block), dim))
        for row, r in zip(q, block):
            row[:len(r["v"])] = r["v"]
        home = distances(np.concatenate([q, np.zeros((len(block), 1))], axis=1), pivots).argmin(axis=1)
        with batch_rows(spark, TREES_AT_ONCE):
            first = _best(written(_searched(trees, block, home, {}, top, dim, k, True), "home"), k)
            first = written(first.drop("rank"), "home-best")
            full = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") == k)
            norms = {r["vec_id"]: float(sum(x * x for x in r["v"])) for r in block}
            bounds = {r["query_id"]: float(np.sqrt(max(0.0, norms[r["query_id"]] + top - 2.0 * r["s"])))
                      for r in full.collect()}
            rest = written(_searched(trees, block, home, bounds, top, dim, k, False), "others")
        both = _best(first.unionByName(rest), k)
        found = both if found is None else found.unionByName(both)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 10
"""
