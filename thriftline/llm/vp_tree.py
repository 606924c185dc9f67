"""Nearest neighbours by inner product with one vantage-point tree per shard.

Inner products are turned into distances by one more component,
sqrt(M^2 - |x|^2) with M the largest norm of the shard: the nearest point to
(q, 0) is then the one with the largest inner product. A subtree is skipped
when the triangle inequality puts all its points further than `factor` times
the distance of the k-th best found so far. Factor one gives exact results; a
smaller one skips more.

Trees are built once and written to the shared folder, as are blocks of
queries; both meet there, so neither is shuffled or copied for the other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.llm.common import LARGE, MEETING, meet, stash

SHARD_VECTORS, BLOCK_QUERIES = 8192, 1024
LEAF = 64
FACTOR = 0.2
K = 20


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: int = 0
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)
    inner: Node | None = None
    outer: Node | None = None


class VpTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray):
        """ids settle ties; keys (two columns) tell the vectors apart."""
        self.ids, self.keys = ids, keys
        norms = (vectors**2).sum(1)
        self.top = float(norms.max())
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.root = self._build(np.arange(len(ids)))

    @property
    def vectors(self) -> np.ndarray:
        return self.points[:, :-1]

    def _build(self, rows: np.ndarray) -> Node:
        if len(rows) <= LEAF:
            return Node(rows=rows)
        seen = self.points[rows]
        from_first = ((seen - seen[0]) ** 2).sum(1)
        point = int(rows[from_first.argmax()])  # a point at the edge spreads distances best
        d = np.sqrt(((seen - self.points[point]) ** 2).sum(1))
        order = d.argsort(kind="stable")
        half = len(rows) // 2
        a, b = order[:half], order[half:]
        return Node(point=point, near=(float(d[a].min()), float(d[a].max())), far=(float(d[b].min()), float(d[b].max())), inner=self._build(rows[a]), outer=self._build(rows[b]))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the k best: rows of vectors (-1: none) and scores, best first, ties by id."""
        found = _Best(self, queries, k, factor)
        found.descend(self.root, np.arange(len(queries)))
        found.sweep(self.root, np.arange(len(queries)))
        return found.rows, found.scores


class _Best:
    def __init__(self, tree: VpTree, queries: np.ndarray, k: int, factor: float):
        self.tree, self.factor = tree, factor
        self.queries, self.lifted = queries, np.hstack([queries, np.zeros((len(queries), 1))])
        self.base = (queries**2).sum(1) + tree.top
        self.rows = np.full((len(queries), k), -1)
        self.scores = np.full((len(queries), k), -np.inf)
        self.first_leaf: list[Node | None] = [None] * len(queries)

    def gap(self, node: Node, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each query to the points of either subtree, by the triangle inequality."""
        d = np.sqrt(((self.lifted[q] - self.tree.points[node.point]) ** 2).sum(1))
        return tuple(np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in (node.near, node.far))

    def descend(self, node: Node, q: np.ndarray) -> None:
        """Each query's nearest leaf, so that the sweep starts with a good bound."""
        if not len(q):
            return
        if node.rows is not None:
            for i in q:
                self.first_leaf[i] = node
            return self.take(node.rows, q)
        inner, outer = self.gap(node, q)
        self.descend(node.inner, q[inner <= outer])
        self.descend(node.outer, q[inner > outer])

    def sweep(self, node: Node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.rows is not None:
            return self.take(node.rows, np.array([i for i in q if self.first_leaf[i] is not node], dtype=int))
        for gap, child in zip(self.gap(node, q), (node.inner, node.outer)):
            bound = np.sqrt(np.maximum(0, self.base[q] - 2 * self.scores[q, -1]))  # infinite as long as k are not found
            self.sweep(child, q[gap <= self.factor * bound + 1e-9])

    def take(self, rows: np.ndarray, q: np.ndarray) -> None:
        if not len(q):
            return
        scores = self.queries[q] @ self.tree.vectors[rows].T
        better = (scores >= self.scores[q, -1][:, None] - 1e-12).any(1)
        q, scores = q[better], scores[better]
        if not len(q):
            return
        k = self.rows.shape[1]
        all_scores = np.hstack([self.scores[q], scores])
        all_rows = np.hstack([self.rows[q], np.broadcast_to(rows, scores.shape)])
        order = np.lexsort((self.tree.ids[all_rows], -all_scores))[:, :k]
        self.rows[q] = np.take_along_axis(all_rows, order, 1)
        self.scores[q] = np.take_along_axis(all_scores, order, 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, h1, h2): the vectors that take part."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine & F.exists("v", lambda x: x != 0))
    same = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    return rows.select("vec_id", same.alias("v")).select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


KEY = ["h1", "h2"]


def build_index(classes: DataFrame, n_shards: int) -> DataFrame:
    """(index binary): a pickled tree per shard and length of vectors of classes (h1, h2, class_id, v)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = VpTree(rows.class_id.to_numpy(), np.array(rows.v.tolist(), dtype=np.float64), rows[KEY].to_numpy())
        return pd.DataFrame({"index": [pickle.dumps(tree, 5)]})

    return classes.select(*KEY, "class_id", "v").groupBy(F.pmod("h1", F.lit(n_shards)).alias("shard"), F.size("v").alias("n")).applyInPandas(build, "index binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    """(block binary): queries (h1, h2, v) packed, those of a length together."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, same in b.groupby(b.v.map(len)):
                for lo in range(0, len(same), BLOCK_QUERIES):
                    part = same.iloc[lo : lo + BLOCK_QUERIES]
                    yield pd.DataFrame({"block": [pickle.dumps((part[KEY].to_numpy(), np.array(part.v.tolist(), dtype=np.float64)), 5)]})

    return queries.select(*KEY, "v").mapInPandas(pack, "block binary")


def search_index(index: DataFrame, blocks: DataFrame, k: int, factor: float) -> DataFrame:
    """(q1, q2, h1, h2, class_id, score): of each query the k best classes of each shard."""
    names = ["q1", "q2", *KEY, "class_id", "score"]

    def search(tree: VpTree, block: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch | None:
        keys, q = block
        if q.shape[1] != tree.vectors.shape[1]:
            return None
        found, _ = tree.search(q, k, factor)
        i, j = np.nonzero(found >= 0)
        at = found[i, j]
        score = (tree.vectors[at] * q[i]).sum(1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys[i].T, *tree.keys[at].T, tree.ids[at], score)], names=names)

    return meet(index, blocks, lambda: (search, lambda: None), "q1 long, q2 long, h1 long, h2 long, class_id long, score double")


def top(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each value of by, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, query_hash): of each query row the k nearest other rows found.

    Nearness is the largest inner product in double precision, ties go to the
    smaller vec_id. Vectors that are null, zero, or hold a null or non-finite
    component take no part, nor does a null vec_id. Vectors of different
    lengths have no product: each length is a table of its own, and a query
    finds vectors of its length. Equal vectors are searched once,
    as a class, and a class answers with its k + 1 smallest ids, which is
    enough for k of any query. Rows with the same vec_id and equal vectors are
    one row. Those with the same vec_id and different vectors are rows each:
    such a vec_id may be found once for each of its vectors, and asks once for
    each, told apart by query_hash, a hash of the query's vector. Only the row
    itself is no candidate. An empty table gives no rows; other columns are not
    read. is_query is a condition on vec_id.
    """
    rows = stash(usable(vectors, id_col, vec_col), "vectors")
    classes = stash(rows.groupBy(*KEY).agg(F.min("vec_id").alias("class_id"), F.first("v").alias("v")), "vector-classes")
    members = top(rows.select(*KEY, "vec_id").distinct(), KEY, k + 1, F.asc("vec_id")).drop("rank")
    asking = stash(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct(), "query-rows")
    queries = classes.join(asking.select(F.col("q1").alias("h1"), F.col("q2").alias("h2")).distinct(), KEY, "left_semi")
    n_shards = max(1, -(-classes.count() // SHARD_VECTORS))
    index = stash(build_index(classes, n_shards).withColumn("no", F.monotonically_increasing_id()), "vp-trees", options=LARGE)
    found = search_index(index, stash(query_blocks(queries), "query-blocks", options=LARGE), k + 1, factor)
    best = stash(top(found, ["q1", "q2"], k + 1, F.desc("score"), F.asc("class_id"), *map(F.asc, KEY)).drop("rank"), "best-classes", settings=MEETING)
    best = top(best.join(members, KEY), ["q1", "q2"], k + 1, F.desc("score"), F.asc("vec_id"), *map(F.asc, KEY)).drop("rank")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))
    answers = asking.join(best, ["q1", "q2"]).filter(~own)
    answers = top(answers, ["query_id", "q1", "q2"], k, F.desc("score"), F.asc("vec_id"), *map(F.asc, KEY))
    return answers.select("query_id", "rank", "vec_id", "score", F.col("q1").alias("query_hash"))


def query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)
