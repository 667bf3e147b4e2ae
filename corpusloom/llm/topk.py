"""Exact top-k by integer inner product: a ball tree for each shard, branch and bound with a shared k-th score.

Vectors are quantised to floor(256 * x). ``build_trees`` cuts each partition in shards of ``CHUNK`` vectors, builds a ball tree for each (a
centre and a radius at every node, by splits at the median along the widest direction) and stores trees and vectors, one row a
shard. A search takes the nodes of a tree from the highest upper bound ``q . centre + |q| * radius`` of the inner product
down, for all queries of a block at once, scores leaves exactly, and drops a query from a node that can't reach its k-th score.
The k-th score is shared: a first pass lets every tree score one leaf for each query (the one of highest bound) and the k
best of all shards give a floor from which the second pass starts everywhere; within a task each tree starts from what the
trees before it found.

Queries are taken in blocks of ``QUERY_BLOCK`` rows, so the broadcast is bounded; the stored trees are read for each block. A
block's tasks return at most k + 1 rows for each query, which are ranked by a group-limited window.

Defined results: ties go to the smaller vec_id. Vectors that are null, hold a null or a component that is not finite, and rows
with a null id take no part; empty vectors do, and score 0. Every query row is a query, so a repeated row repeats its result, and its
candidates are all other rows, those of its own id and vector too. Vectors of another length than the query's are no
candidates of it. Scores are exact for components of any size; a result that doesn't fit in 64 bits stops the query with an error.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import stored

LEAF = 128
CHUNK = 8_192
QUERY_BLOCK = 4_096
#: Products beyond this are put on it; one that gets into a result stops the query.
LARGEST = 2**63 - 1
MISSING = -(2**63)
FOUND = "number long, vec_id long, score long"
RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the integer vectors of the rows that take part."""
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(raw, lambda x: F.lit(256.0) * x)
    fits = F.forall(scaled, lambda x: F.abs(x) < float(2**63))
    v = F.when(fits, F.transform(scaled, lambda x: F.floor(x))).otherwise(F.raise_error(F.lit("a quantised component exceeds 64 bits")).cast("array<bigint>"))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


class BallTree:
    """Nodes as arrays: centre, radius, and either two children or a range of points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        centres, radii, children = [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            low, high, parent, side = stack.pop()
            at = self.order[low:high]
            own = points[at]
            centre = own.mean(0)
            node = len(centres)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if high - low <= leaf or radii[-1] == 0:
                children[node][0] = -2 - len(self.leaves)
                self.leaves.append((low, high))
                continue
            far = own[np.argmax(((own - own[np.argmax(((own - centre) ** 2).sum(1))]) ** 2).sum(1))]
            direction = far - centre
            middle = (high - low) // 2
            self.order[low:high] = at[np.argpartition(own @ direction, middle)]
            stack += [(low, low + middle, node, 0), (low + middle, high, node, 1)]
        self.centres, self.radii, self.children = np.array(centres), np.array(radii), children

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no point of the node has a larger inner product; a little is added for rounding."""
        lengths = np.linalg.norm(queries, axis=1)[:, None]
        return queries @ self.centres.T + lengths * self.radii + 1 + 1e-9 * lengths * (np.linalg.norm(self.centres, axis=1) + self.radii)


class Best:
    """The k best (score, id) of each query so far, and the score below which nothing counts."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.scores = np.full((n, k), MISSING)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def limit(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1].astype(np.float64))

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (len(at), m) of points ``ids`` (m)."""
        if scores.shape[1] > 2 * self.k:
            # what can't be among the k best of these points goes before the sort; ties at the last score stay
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            some = (scores >= np.maximum(least, self.scores[at, -1])[:, None]).any(0)
            scores, ids = scores[:, some], ids[some]
        both = np.concatenate([self.scores[at], scores], axis=1)
        names = np.concatenate([self.ids[at], np.broadcast_to(ids, scores.shape)], axis=1)
        # among equal scores the smaller id; the complement orders 64-bit integers downwards without overflow
        order = np.lexsort((names, ~both), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(both, order, 1)
        self.ids[at] = np.take_along_axis(names, order, 1)


def search(tree: BallTree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, best: Best, leaves: int | None = None) -> None:
    """Best-first branch and bound for all queries together; ``leaves`` stops each query after so many leaves."""
    bounds = tree.bounds(queries.astype(np.float64))
    waiting: list[tuple[float, int, int, np.ndarray]] = [(0.0, 0, 0, np.arange(len(queries)))]
    read = np.zeros(len(queries), np.int64)
    pushed = 0
    while waiting:
        _, _, node, at = heapq.heappop(waiting)
        at = at[bounds[at, node] >= best.limit()[at]]
        if leaves is not None:
            at = at[read[at] < leaves]
        if not len(at):
            continue
        left, right = tree.children[node]
        if left <= -2:
            low, high = tree.leaves[-2 - left]
            own = tree.order[low:high]
            best.add(at, products(queries[at], points[own]), ids[own])
            read[at] += 1
            continue
        nearer = bounds[at, left] >= bounds[at, right]
        # the highest bound of a group of queries orders it; a query's better child comes first
        for child, group in ((left, at[nearer]), (right, at[~nearer]), (left, at[~nearer]), (right, at[nearer])):
            if len(group):
                pushed += 1
                heapq.heappush(waiting, (-float(bounds[group, child].max()), pushed, child, group))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of 64-bit integers, exactly: in floating point while every sum stays below 2^53, else in integers, at last of any size, within ``LARGEST``."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = int(max(a.max(), -int(a.min()))) * int(max(b.max(), -int(b.min()))) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest <= LARGEST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


def build_trees(vectors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``shard (binary)``: trees with their vectors, by length, each of at most ``chunk`` vectors; stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in batches:
            for n, part in frame.groupby(frame.v.map(len)):
                parts = held.setdefault(n, [])
                parts.append((part.vec_id.to_numpy(np.int64), np.array(part.v.tolist(), np.int64).reshape(len(part), n)))
                while sum(len(i) for i, _ in parts) >= chunk:
                    ids, points = np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts])
                    yield shard(ids[:chunk], points[:chunk])
                    parts[:] = [(ids[chunk:], points[chunk:])]
        for parts in held.values():
            if sum(len(i) for i, _ in parts):
                yield shard(np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts]))

    def shard(ids: np.ndarray, points: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pickle.dumps((BallTree(points.astype(np.float64)), points, ids))]})

    return stored(vectors.mapInPandas(run, "shard binary"), "trees")


def _pass(trees: DataFrame, queries: pd.DataFrame, k: int, floor: np.ndarray, leaves: int | None) -> DataFrame:
    """The ``k`` best rows of each task for each query number."""
    by_length = {n: (g.number.to_numpy(np.int64), np.array(g.v.tolist(), np.int64).reshape(len(g), n), floor[g.index.to_numpy()]) for n, g in queries.groupby(queries.v.map(len))}
    carried = trees.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length = carried.value
        best = {n: Best(len(numbers), k, low) for n, (numbers, _, low) in by_length.items()}
        for frame in batches:
            for blob in frame.shard:
                tree, points, ids = pickle.loads(blob)
                if points.shape[1] in by_length:
                    search(tree, points, ids, by_length[points.shape[1]][1], best[points.shape[1]], leaves)
        for n, found in best.items():
            full = found.ids < np.iinfo(np.int64).max
            at = np.nonzero(full)[0]
            yield pd.DataFrame({"number": by_length[n][0][at], "vec_id": found.ids[full], "score": found.scores[full]})

    return trees.mapInPandas(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest inner products of each query with ``vectors`` but its own row; both are outputs of ``quantised``, the queries rows of ``vectors``."""
    spark = vectors.sparkSession
    trees = build_trees(vectors)
    parts = max(1, -(-queries.count() // block))
    blocks = stored(queries.withColumn("__part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts))), "queries")
    out = None
    for part in range(parts):
        own = blocks.where(F.col("__part") == part).select("vec_id", "v").toPandas()
        if own.empty:
            continue
        own["number"] = np.arange(len(own))
        # a row finds itself among its k + 1 best, unless others are better; one row of its id and its own product is taken out
        first = ranked(_pass(trees, own, k + 1, np.full(len(own), -np.inf), 1), k + 1)
        kth = dict(first.where(F.col("rank") == k + 1).select("number", "score").collect())
        floor = np.array([kth.get(i, -np.inf) for i in own.number], np.float64)
        found = ranked(_pass(trees, own, k + 1, floor, None), k + 1)
        itself = [int(products(v, v)[0, 0]) for v in (np.array([x], np.int64).reshape(1, len(x)) for x in own.v)]
        names = spark.createDataFrame(list(zip(own.number.tolist(), own.vec_id.tolist(), itself, strict=True)), "number long, query_id long, itself long")
        named = found.join(F.broadcast(names), "number")
        is_own = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("itself")), F.col("rank"))
        own_rank = F.min(is_own).over(Window.partitionBy("number"))
        placed = named.withColumn("own", F.coalesce(own_rank, F.lit(k + 2))).where(F.col("rank") != F.col("own"))
        placed = placed.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("own"), 1).otherwise(0)).where(F.col("rank") <= k)
        score = F.when(F.abs("score") < LARGEST, F.col("score")).otherwise(F.raise_error(F.lit("an inner product exceeds 64 bits")).cast("long"))
        placed = placed.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
        out = placed if out is None else out.unionByName(placed)
    return spark.createDataFrame([], RESULT) if out is None else out


ORACLE = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
