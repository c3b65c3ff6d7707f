"""A stored inverted index of chunks, in blocks with score bounds.

    root/postings  (corpus, bucket)  a row per block of a term: ids, tfs, lens, and the bounds of tf and len in it
    root/lengths   (corpus, bucket)  chunks and words, for the statistics of a search

``bucket`` is the path bucket of the chunk table: when files change, only the postings of their buckets are written anew.
Files are sorted by ``tb``, a hash bucket of the term, and by term: a search reads the row groups of its terms' buckets and
skips the others by their statistics. A block holds postings of like impact (tf and length), so that its bound is close to
what it holds, and a search leaves out the blocks that cannot reach a query's k-th score. No search reads a chunk's text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quarry.functions import fixed as X
from quarry.operators import retrieval as R
from quarry.session import cut_lineage
from quarry.sources import tables as T

TERM_BUCKETS = 64
BLOCK = 128
#: Term frequencies from here on are one impact class.
TF_CLASSES = 8
PARTS = ("corpus", "bucket")
#: Lower bounds of scores are gathered in steps of one over this.
STEPS = 32
#: Bounds are compared with this much to spare, so that no sum taken in another order falls below them.
SLACK = 1e-6


class Inverted(NamedTuple):
    postings: DataFrame
    lengths: DataFrame


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def blocks(chunks: DataFrame, id_col: str = "chunk_id", text: str = "content") -> DataFrame:
    """Block rows of chunks (corpus, bucket, id, text), those of a (corpus, bucket) in as few tasks as its size allows.

    One shuffle brings the postings of a (corpus, bucket) together, and one sort puts those of a
    term and impact class next to each other; blocks are cut from the sorted batches, so no task holds all postings of a term as a list.
    """
    p = R.bm25_postings(chunks.withColumn("_k", F.struct("corpus", "bucket", F.col(id_col).alias("id"))), "_k", text)
    p = p.select("_k.*", "term", term_bucket(F.col("term")).alias("tb"), "tf", "len")
    p = p.withColumn("_tf", F.least("tf", F.lit(TF_CLASSES)).cast("int")).withColumn("_len", F.floor(F.log2("len")).cast("int"))
    # one number decides nearly all comparisons of the sort; groups whose numbers clash are still cut apart
    p = p.hint("rebalance", *[F.col(c) for c in PARTS]).withColumn("_g", F.xxhash64(*PARTS, *GROUP)).sortWithinPartitions("_g", F.desc("tf"), "len", "id").drop("_g")
    return p.mapInArrow(_cutter(), "term string, n bigint, words bigint, top_tf bigint, low_tf bigint, top_len int, low_len int, "
                                   f"rows array<struct<id: {p.schema['id'].dataType.simpleString()}, tf: bigint, len: int>>, tb int, corpus string, bucket string")


#: Postings with these in common, inside a (corpus, bucket), share blocks.
GROUP = ("tb", "term", "_tf", "_len")


def _cutter():
    """A function that cuts blocks of at most BLOCK sorted postings of one group. It is made here, so that a worker gets it by value."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a batch ends with may go on in the next one, so its last block waits
        names, rest = (*PARTS, *GROUP), None
        for batch in chain(batches, [None]):
            parts = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None and t.num_rows]
            if not parts:
                continue
            t = pa.concat_tables(parts).combine_chunks()
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in names:
                column = t.column(c)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            at = np.arange(t.num_rows) - np.repeat(first, np.diff(np.append(first, t.num_rows)))
            starts = np.flatnonzero(at % BLOCK == 0)
            if batch is None:
                ends, rest = np.append(starts[1:], t.num_rows), None
            else:
                rest, ends, starts = t.slice(starts[-1]), starts[1:], starts[:-1]
            if not len(starts):
                continue
            done = t.slice(0, ends[-1])
            flat = {c: done.column(c).combine_chunks() for c in ("id", "tf", "len")}
            flat = {c: pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v for c, v in flat.items()}
            tf, length = flat["tf"].to_numpy(), flat["len"].to_numpy()
            rows = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.StructArray.from_arrays(list(flat.values()), names=list(flat)))
            heads = done.take(pa.array(starts)).combine_chunks()
            out = {"term": heads.column("term"), "n": ends - starts, "words": np.add.reduceat(tf, starts),
                   "top_tf": np.maximum.reduceat(tf, starts), "low_tf": np.minimum.reduceat(tf, starts),
                   "top_len": np.maximum.reduceat(length, starts), "low_len": np.minimum.reduceat(length, starts), "rows": rows,
                   "tb": heads.column("tb"), "corpus": heads.column("corpus"), "bucket": heads.column("bucket")}
            yield from pa.table(out).to_batches()

    return cut


def write(chunks: DataFrame, root: str, replaces: DataFrame | None = None, id_col: str = "chunk_id", text: str = "content") -> None:
    """Write the postings of chunks (corpus, bucket, id, text); each (corpus, bucket) met or named in ``replaces`` is written whole."""
    spark, parts = chunks.sparkSession, list(PARTS)
    # a test that ends at the first word tells which partitions will have postings, before those are made
    met = cut_lineage(chunks.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n_chunks"), F.bool_or(F.lower(F.col(text)).rlike(X.TERM_PATTERN)).alias("worded")), "met")
    (blocks(chunks, id_col, text).sortWithinPartitions(*PARTS, "tb", "term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTS).parquet(f"{root}/postings"))
    worded = met.where("worded").select(*PARTS)
    if replaces is not None:
        replaces = cut_lineage(replaces.select(*PARTS).union(met.select(*PARTS)).distinct(), "replaces")
        T.drop_partitions(replaces.join(worded, parts, "left_anti"), f"{root}/postings")      # chunks without a word have lengths only
    words = spark.read.schema("words bigint, corpus string, bucket string").parquet(f"{root}/postings").join(worded, parts, "left_semi").groupBy(*PARTS).agg(F.sum("words").alias("words"))
    lengths = cut_lineage(met.join(words, parts, "left").na.fill(0, ["words"]).select("n_chunks", "words", *PARTS), "lengths")
    T.write_partitions(lengths, f"{root}/lengths", PARTS, staged=False, replaces=replaces)


def drop(spark: SparkSession, root: str, corpora: DataFrame) -> None:
    """Drop the postings and statistics of corpora."""
    for name in ("postings", "lengths"):
        held = getattr(load(spark, root), name).select(*PARTS).distinct().join(corpora.select("corpus").distinct(), "corpus", "left_semi")
        T.drop_partitions(cut_lineage(held, "held"), f"{root}/{name}")


def load(spark: SparkSession, root: str, id_type: str = "string") -> Inverted:
    post = (f"term string, n bigint, words bigint, top_tf bigint, low_tf bigint, top_len int, low_len int, "
            f"rows array<struct<id: {id_type}, tf: bigint, len: int>>, tb int, corpus string, bucket string")
    return Inverted(spark.read.schema(post).parquet(f"{root}/postings"),
                    spark.read.schema("n_chunks bigint, words bigint, corpus string, bucket string").parquet(f"{root}/lengths"))


def _part(tf: Column, length: Column, average: Column) -> Column:
    """A posting's score before its term's weight; grows with tf, falls with length."""
    return tf * F.lit(X.BM25_K1 + 1) / (tf + F.lit(X.BM25_K1) * (F.lit(1 - X.BM25_B) + F.lit(X.BM25_B) * length / average))


def _upper() -> Column:
    return _part(F.col("top_tf"), F.col("low_len"), F.col("avg_len"))


def _lower() -> Column:
    return _part(F.col("low_tf"), F.col("top_len"), F.col("avg_len"))


def _scoped(df: DataFrame, within: str | None) -> DataFrame:
    return df.withColumn("scope", F.col("corpus") if within else F.lit(""))


def asked_terms(index: Inverted, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "semantic", within: str | None = None,
                broadcast_terms: int = R.BROADCAST_TERMS) -> tuple[DataFrame, bool]:
    """((scope, tb, term, _q, idf, avg_len, need), whether these rows are few enough to be broadcast).

    ``need`` is the upper bound that a block of the term must have to matter to the query. A query's k-th score is at least the
    k-th lower bound of any one of its terms; a chunk in a block scores at most the block's bound and the best of all
    other terms. Only the bounds of the asked terms' blocks are read.
    """
    q = cut_lineage(queries.select(R._scope(within), F.col(query_id).alias("_q"), F.explode(F.array_distinct(R.tokens(F.col(query_text)))).alias("term"))
                    .withColumn("tb", term_bucket(F.col("term"))), "asked")
    few = q.limit(broadcast_terms + 1).count() <= broadcast_terms
    near = F.broadcast if few else (lambda df: df)
    key = ["scope", "tb", "term"]
    bounds = ["n", "top_tf", "low_tf", "top_len", "low_len"]
    heads = _scoped(_opened(index.postings, q), within).select(*key, *bounds).join(near(q.select(*key).distinct()), key)
    heads = cut_lineage(heads.groupBy(*key, *bounds[1:]).agg(F.sum("n").alias("n")), "heads")       # blocks of equal bounds count together
    stats = _scoped(index.lengths, within).groupBy("scope").agg(F.sum("n_chunks").alias("n_chunks"), (F.sum("words") / F.sum("n_chunks")).alias("avg_len"))
    terms = heads.groupBy(*key).agg(F.sum("n").alias("df")).join(stats, "scope")
    terms = terms.withColumn("idf", F.log(F.lit(1.0) + (F.col("n_chunks") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))).drop("n_chunks", "df")
    known = heads.join(near(terms.select(*key, "avg_len")), key).select(*key, "n", _upper().alias("high"), _lower().alias("low"))
    steps = known.groupBy(*key, F.floor(F.col("low") * STEPS).alias("step")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    above = F.sum("n").over(W.partitionBy(*key).orderBy(F.desc("step")))          # at most STEPS * (k1 + 1) rows a term
    best = steps.withColumn("above", above).groupBy(*key).agg(F.max("high").alias("high"), F.coalesce(F.max(F.when(F.col("above") >= k, F.col("low"))), F.lit(0.0)).alias("kth"))
    t = q.join(terms, key).join(best, key)
    mine = W.partitionBy("_q", "scope")
    floor_, most = F.max(F.col("idf") * F.col("kth")).over(mine), F.sum(F.col("idf") * F.col("high")).over(mine)
    need = (floor_ - most) / F.col("idf") + F.col("high") - F.lit(SLACK)
    return t.select(*key, "_q", "idf", "avg_len", need.alias("need")), few


def _opened(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Only the row groups of the asked term buckets; at most TERM_BUCKETS numbers come to the driver."""
    return postings.where(F.col("tb").isin([r["tb"] for r in terms.select("tb").distinct().collect()]))


def kept_blocks(index: Inverted, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "semantic", within: str | None = None,
                broadcast_terms: int = R.BROADCAST_TERMS, salts: int = 16) -> DataFrame:
    """Blocks joined with the query terms they matter to."""
    terms, few = asked_terms(index, queries, k, query_id, query_text, within, broadcast_terms)
    terms = cut_lineage(terms, "needs")
    post, key = _scoped(_opened(index.postings, terms), within), ["scope", "tb", "term"]
    if few:
        joined = post.join(F.broadcast(terms), key)
    else:
        spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        joined = post.withColumn("_s", F.pmod(F.xxhash64(F.get("rows", F.lit(0))["id"]), F.lit(salts)).cast("int")).join(terms.withColumn("_s", spread), [*key, "_s"])
    return joined.where(_upper() >= F.col("need"))


def topk(index: Inverted, queries: DataFrame, k: int, id_col: str = "chunk_id", query_id: str = "query_id", query_text: str = "semantic",
         within: str | None = None, broadcast_terms: int = R.BROADCAST_TERMS, salts: int = 16) -> DataFrame:
    """The rows of ``retrieval.bm25_topk``, (query_id, id, score, rank), from the stored index."""
    kept = kept_blocks(index, queries, k, query_id, query_text, within, broadcast_terms, salts)
    rows = kept.select("_q", "idf", "avg_len", F.explode("rows").alias("r")).select("_q", F.col("r.id").alias("_id"), (F.col("idf") * _part(F.col("r.tf"), F.col("r.len"), F.col("avg_len"))).alias("part"))
    scored = rows.groupBy("_id", "_q").agg(F.round(F.sum("part"), R.DIGITS).alias("score"))
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), "_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_q").alias(query_id), F.col("_id").alias(id_col), "score", "rank")
