"""A stored index for approximate nearest neighbours: vectors by cell, with one byte per number for a first ranking.

    root/cells      (cell)   id, codes (the residual to the cell's centre, a byte a number), miss (how far they are off), vector (as given)
    root/quantizer  one row  centres, the codes' scale and the vectors' type

Centres are fitted by spherical k-means on a bounded sample: the ``sample_rows`` rows that are first by a hash of their id.
Every row is indexed. A query opens its ``probes`` nearest cells only, ranks what is there by codes, reads the vectors of its
``shortlist`` best and of all others that by ``miss`` can still be among its k best, and ranks these exactly. So it loses nothing
of the cells that it opens, and with all cells it is the exact search; ``retrieval.dense_topk`` is another.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quarry.operators import retrieval as R
from quarry.session import cut_lineage
from quarry.sources import tables as T

SAMPLE_ROWS = 65_536
ROUNDS = 12
#: Candidates (query, id) that are sent to every task to fetch their vectors; more are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000
#: Bounds by codes are compared with this much to spare, for the rounding of scores.
SLACK = 1e-8


class Quantizer(NamedTuple):
    centers: np.ndarray
    scale: np.ndarray


class Cells(NamedTuple):
    rows: DataFrame
    quantizer: Quantizer


def fit(vectors: DataFrame, cells: int, id_col: str = "doc_id", vector: str = "vector", sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> Quantizer:
    """Centres of at most ``cells`` cells, from a sample whose size does not grow with the table."""
    sample = vectors.select(F.col(vector).alias("v"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")).orderBy("h").limit(sample_rows).orderBy("h").select("v")
    m = R._unit(R._matrix(sample.toArrow().column("v")))
    rng = np.random.default_rng(seed)
    centers = m[np.sort(rng.choice(len(m), min(cells, len(m)), replace=False))] if len(m) else np.zeros((0, 1))
    for _ in range(ROUNDS if len(m) else 0):
        own = np.argmax(m @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, m)
        met = np.bincount(own, minlength=len(centers)) > 0
        centers = np.where(met[:, None], R._unit(sums), centers)
    rest = m - centers[np.argmax(m @ centers.T, axis=1)] if len(m) else np.zeros((1, 1))
    return Quantizer(centers, np.maximum(np.abs(rest).max(axis=0), 1e-12) / 127)


def write(vectors: DataFrame, root: str, cells: int, id_col: str = "doc_id", vector: str = "vector", sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> None:
    """Fit and store the index of all rows with a vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    q = fit(rows, cells, "id", "vector", sample_rows, seed)
    kind = rows.schema["vector"].dataType.simpleString()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, codes binary, miss double, vector {kind}, cell int"

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                m = R._unit(R._matrix(batch.column("vector")))
                own = np.argmax(m @ q.centers.T, axis=1)
                rest = m - q.centers[own]
                codes = np.clip(np.rint(rest / q.scale), -127, 127).astype(np.int8)
                miss = np.sqrt(((rest - codes * q.scale) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss), batch.column("vector"), pa.array(own.astype(np.int32))],
                                                 names=["id", "codes", "miss", "vector", "cell"])
    T.write_partitions(rows.mapInArrow(assign, schema), f"{root}/cells", ("cell",), staged=False)
    spark.createDataFrame([(q.centers.ravel().tolist(), q.scale.tolist(), kind)], "centers array<double>, scale array<double>, kind string").write.mode("overwrite").parquet(f"{root}/quantizer")


def load(spark: SparkSession, root: str, id_type: str = "bigint") -> Cells:
    one = spark.read.parquet(f"{root}/quantizer").first()
    scale = np.array(one["scale"])
    centers = np.array(one["centers"]).reshape(-1, len(scale)) if len(one["centers"]) else np.zeros((0, len(scale)))
    return Cells(spark.read.schema(f"id {id_type}, codes binary, miss double, vector {one['kind']}, cell int").parquet(f"{root}/cells"), Quantizer(centers, scale))


def probed(index: Cells, queries: DataFrame, probes: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """(_q, cell): the cells whose centres are nearest to each query."""
    q = queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("v"))
    centers = index.quantizer.centers

    def nearest(batches):
        for batch in batches:
            if batch.num_rows and len(centers):
                m = R._unit(R._matrix(batch.column("v")))
                best = np.argsort(-(m @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(m)), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("_q").take(at), pa.array(best.ravel())], names=["_q", "cell"])
    return q.mapInArrow(nearest, f"_q {q.schema['_q'].dataType.simpleString()}, cell int")


def _matrix_of(codes: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(-1, dim)


def shortlists(index: Cells, queries: DataFrame, probes: int, shortlist: int, query_id: str = "query_id", vector: str = "vector",
               broadcast_bytes: int = R.BROADCAST_BYTES, k: int | None = None) -> DataFrame:
    """(_q, id, cell): each query's best by codes among its cells. Reads codes, no vectors, of the probed cells only.

    Query blocks of a checked size are sent to the tasks that scan the cells; each emits ``shortlist`` rows
    per query and, with ``k``, those beyond that can be among the query's k best: a row's score is at most ``miss`` away
    from its score by codes, and k rows are sure to reach the k-th greatest lower bound.
    A larger query table takes several blocks, and a block opens the cells of its own queries.
    """
    spark = index.rows.sparkSession
    centers, scale = index.quantizer
    if not len(centers):
        return index.rows.select(F.lit(None).cast(queries.schema[query_id].dataType).alias("_q"), "id", "cell").limit(0)
    room = max(1, broadcast_bytes // (8 * (centers.shape[1] + probes)))
    table = cut_lineage(queries.select(F.col(query_id).alias(query_id), F.col(vector).alias(vector)), "ann-queries")
    parts = max(1, -(-table.count() // room))
    found = None
    for part in range(parts):
        block = table.where(F.pmod(F.xxhash64(F.col(query_id)), F.lit(parts)) == part) if parts > 1 else table
        near = probed(index, block, probes, query_id, vector).groupBy("_q").agg(F.collect_list("cell").alias("cells"))
        held = block.join(near, F.col(query_id) == F.col("_q")).select("_q", F.col(vector).alias("v"), "cells").toArrow()
        if not held.num_rows:
            continue
        own: dict[int, list[int]] = {}
        for i, cells in enumerate(held.column("cells").to_pylist()):
            for c in cells:
                own.setdefault(c, []).append(i)
        sent = spark.sparkContext.broadcast((held.column("_q").to_numpy(), R._unit(R._matrix(held.column("v"))), {c: np.array(x) for c, x in own.items()}))
        rows = index.rows.where(F.col("cell").isin(sorted(own))).select("id", "codes", ("miss" if k else F.lit(0.0).alias("miss")), "cell")
        one = rows.mapInArrow(_ranker(sent, centers, scale, shortlist, k), f"_q {table.schema[query_id].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, cell int, near double, miss double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return index.rows.select(F.lit(None).cast(table.schema[query_id].dataType).alias("_q"), "id", "cell").limit(0)
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("near"), "id"))
    found, keep = found.withColumn("rank", rank), F.col("rank") <= shortlist
    if k is not None:
        sure = F.row_number().over(W.partitionBy("_q").orderBy(F.desc(F.col("near") - F.col("miss"))))
        kth = F.max(F.when(F.col("sure") == k, F.col("near") - F.col("miss"))).over(W.partitionBy("_q"))
        found = found.withColumn("sure", sure).withColumn("kth", kth)
        keep = keep | F.col("kth").isNull() | (F.col("near") + F.col("miss") + F.lit(SLACK) >= F.col("kth"))
    return found.where(keep).select("_q", "id", "cell")


def _places(qi: np.ndarray) -> np.ndarray:
    """Each element's place, from 0, in its run of equal values."""
    first = np.r_[True, qi[1:] != qi[:-1]]
    return np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))


def _ranker(sent, centers: np.ndarray, scale: np.ndarray, shortlist: int, k: int | None):
    def scan(batches):
        qids, q, own = sent.value
        floor = np.full(len(q), -np.inf if k else np.inf)     # the k-th greatest lower bound of each query so far
        best = [np.zeros(0, int), None, np.zeros(0), np.zeros(0, np.int32), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells, miss = R._id_array(batch.column("id")), batch.column("cell").to_numpy(), batch.column("miss").to_numpy()
            codes = _matrix_of(batch.column("codes"), len(scale))
            for cell in np.unique(cells).tolist():
                at, mine = np.flatnonzero(cells == cell), own.get(cell)
                if mine is None:
                    continue
                near = (codes[at] @ (q[mine] * scale).T) + q[mine] @ centers[cell]
                if len(at) > shortlist:
                    reach = near >= np.partition(near, len(at) - shortlist, axis=0)[len(at) - shortlist]
                    if k:
                        low = near - miss[at][:, None]
                        if len(at) > k:
                            floor[mine] = np.maximum(floor[mine], np.partition(low, len(at) - k, axis=0)[len(at) - k])
                        reach |= near + miss[at][:, None] + SLACK >= floor[mine]
                    r, c = np.nonzero(reach)
                else:
                    r, c = (x.ravel() for x in np.indices(near.shape))
                qi, got, s = np.r_[best[0], mine[c]], ids[at[r]], np.r_[best[2], near[r, c]]
                got = got if best[1] is None else np.concatenate([best[1], got])
                where, off = np.r_[best[3], np.full(len(r), cell, np.int32)], np.r_[best[4], miss[at[r]]]
                if k:
                    order = np.lexsort((off - s, qi))
                    kth = order[_places(qi[order]) == k - 1]
                    floor[qi[kth]] = np.maximum(floor[qi[kth]], (s - off)[kth])
                order = np.lexsort((got, -s, qi))
                order = order[(_places(qi[order]) < shortlist) | ((s + off + SLACK)[order] >= floor[qi[order]])]
                best = [qi[order], got[order], s[order], where[order], off[order]]
        if best[1] is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(qids[best[0]]), pa.array(best[1]), pa.array(best[3], pa.int32()), pa.array(best[2]), pa.array(best[4])], names=["_q", "id", "cell", "near", "miss"])
    return scan


def topk(index: Cells, queries: DataFrame, k: int, probes: int, shortlist: int, id_col: str = "doc_id", query_id: str = "query_id", vector: str = "vector",
         broadcast_bytes: int = R.BROADCAST_BYTES, broadcast_candidates: int = BROADCAST_CANDIDATES) -> DataFrame:
    """(query_id, id, score, rank): the k best by cosine of each query's cells; fewer if these hold fewer."""
    short = cut_lineage(shortlists(index, queries, probes, max(k, shortlist), query_id, vector, broadcast_bytes, k), "shortlist")
    few = short.limit(broadcast_candidates + 1).count() <= broadcast_candidates
    met = index.rows.where(F.col("cell").isin([r["cell"] for r in short.select("cell").distinct().collect()])).select("id", "cell", F.col("vector").alias("_v"))
    pairs = met.join(F.broadcast(short) if few else short, ["id", "cell"]).join(queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("_qv")), "_q")
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), "id"))
    return (pairs.select("_q", "id", R.cosine(F.col("_qv"), F.col("_v")).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
            .select(F.col("_q").alias(query_id), F.col("id").alias(id_col), "score", "rank"))
