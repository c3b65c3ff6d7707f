"""Nearest neighbours by largest inner product, with a vantage-point tree per shard (operator 4).

Vectors are lifted by one coordinate to equal length; then the largest inner product is the least
Euclidean distance, so the triangle inequality holds and a subtree whose distances to its vantage point
cannot come near enough is skipped. ``factor`` relaxes the bound: a subtree is skipped when its least
possible distance times the factor exceeds the distance of the query's k-th best; one is exact search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm.common import cut, hash_order

FACTOR = 1.0
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 4096, 256
#: A shard and a block of queries hold at most so many bytes of vectors.
GROUP_BYTES = 32 << 20


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class VantageTree:
    """Vantage-point tree over the rows of a matrix, for searches by inner product."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 42) -> None:
        self.x = x
        norms = np.einsum("ij,ij->i", x, x)
        self.top = float(norms.max())
        self.lift = np.sqrt(np.maximum(self.top - norms, 0.0))
        self.slack = 1e-7 * (1.0 + self.top) ** 0.5
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []        # ("leaf", rows) or (vantage, near child, far child, bounds of both)
        self.leaves: list[int] = []

        def build(rows: np.ndarray) -> int:
            at = len(self.nodes)
            if len(rows) <= leaf:
                self.nodes.append(("leaf", rows))
                self.leaves.append(at)
                return at
            self.nodes.append(())
            v = int(rows[rng.integers(len(rows))])
            apart = np.sqrt(np.maximum(2 * self.top - 2 * (x[rows] @ x[v] + self.lift[rows] * self.lift[v]), 0.0))
            order = np.argsort(apart, kind="stable")
            rows, apart, half = rows[order], apart[order], len(rows) // 2
            bounds = (apart[0], apart[half - 1], apart[half], apart[-1])
            near = build(rows[:half])
            self.nodes[at] = (v, near, build(rows[half:]), bounds)
            return at
        build(np.arange(len(x)))

    def search(self, q: np.ndarray, k: int, factor: float = FACTOR) -> list[np.ndarray]:
        """For each query the rows among which its k best are, ties with the k-th included."""
        norms = np.einsum("ij,ij->i", q, q)
        best = np.full((len(q), k), -np.inf)
        found: list[list[np.ndarray]] = [[] for _ in range(len(q))]

        def scan(rows: np.ndarray, who: np.ndarray) -> None:
            scores = q[who] @ self.x[rows].T
            best[who] = -np.partition(-np.concatenate([best[who], scores], axis=1), k - 1, axis=1)[:, :k]
            low = best[who].min(axis=1) - self.slack
            for i, j in zip(who.tolist(), scores >= low[:, None], strict=True):
                if j.any():
                    found[i].append(rows[j])

        def distance(who: np.ndarray, v: int) -> np.ndarray:
            return np.sqrt(np.maximum(norms[who] + self.top - 2 * (q[who] @ self.x[v]), 0.0))

        seen: dict[int, np.ndarray] = {}
        # first the leaf that each query falls into: it gives a first k-th best
        ahead = [(0, np.arange(len(q)))]
        while ahead:
            at, who = ahead.pop()
            if not len(who):
                continue
            node = self.nodes[at]
            if node[0] == "leaf":
                seen[at] = who
                scan(node[1], who)
                continue
            v, near, far, (_, inner, outer, _) = node
            close = distance(who, v) <= (inner + outer) / 2
            ahead += [(near, who[close]), (far, who[~close])]
        # then every node that may hold better ones
        ahead = [(0, np.arange(len(q)))]
        while ahead:
            at, who = ahead.pop()
            if not len(who):
                continue
            node = self.nodes[at]
            if node[0] == "leaf":
                scan(node[1], np.setdiff1d(who, seen[at], assume_unique=True) if at in seen else who)
                continue
            v, near, far, (a, b, c, d) = node
            apart = distance(who, v)
            reach = np.sqrt(np.maximum(norms[who] + self.top - 2 * best[who].min(axis=1), 0.0)) / factor + self.slack
            reach[np.isinf(best[who]).any(axis=1)] = np.inf
            for child, lo, hi in ((far, c, d), (near, a, b)):
                ahead.append((child, who[np.maximum(lo - apart, apart - hi) <= reach]))
        return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, each summed from the first component to the last, so equal vectors score equally."""
    return np.cumsum(x * q, axis=1)[:, -1]


def search_shard(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, factor: float) -> pd.DataFrame:
    """(query_row, query_id, vec_id, score): each query's k best of the shard. Equal vectors are one point of the tree."""
    none = pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
    if not len(vectors) or not len(queries):
        return none
    x, ids = np.stack(vectors["vector"].to_numpy()).astype(np.float64), vectors["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    points, which = np.unique(x[order] + 0.0, axis=0, return_inverse=True)
    ids, which = ids[order], which.reshape(-1)
    by = np.argsort(which, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(which))])
    q = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    # a query's own row may be among the best: one more point is looked for
    hits = VantageTree(points).search(q, min(k + 1, len(points)), factor)
    out = []
    for row, own, one, rows in zip(queries["row"].tolist(), queries["vec_id"].tolist(), q, hits, strict=True):
        scores = exact_scores(one, points[rows])
        ids_of = [ids[by[first[r]:first[r + 1]][:k + 1]] for r in rows]
        s, i = np.repeat(scores, [len(a) for a in ids_of]), np.concatenate(ids_of) if ids_of else np.zeros(0, ids.dtype)
        s, i = s[i != own], i[i != own]
        top = np.lexsort((i, -s))[:k]
        out.append(pd.DataFrame({"query_row": row, "query_id": own, "vec_id": i[top], "score": s[top]}))
    return pd.concat(out) if out else none


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding",
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds its k nearest, over all rows with another id.

    ``vec_id`` is an integer. Rows with a null id or an unusable vector take no part; vectors of another length
    than the query's are not compared. Repeated rows are candidates each and answered each. Shards are drawn by
    a hash of the row, so copies of a vector spread evenly, and bounded in rows and bytes like the blocks of
    queries; every block meets every shard once and leaves k rows per query there.
    """
    rows = cut(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
               .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
               .select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", "is_query", F.size("vector").alias("dim")), "vectors")
    n, asked, dim = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1)), F.max("dim")).first()
    most = max(1, GROUP_BYTES // (8 * (dim or 1)))
    shards, blocks = max(1, -(-n // min(shard_rows, most))), max(1, -(-asked // min(block_rows, most)))
    left = rows.select("row", "vec_id", "vector", "dim", F.pmod(hash_order(1, "row"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = rows.where("is_query").select("row", "vec_id", "vector", "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                                          F.pmod(hash_order(2, "row"), F.lit(blocks)).cast("int").alias("block"))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: search_shard(a, b, k, factor), "query_row long, query_id long, vec_id long, score double")
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
