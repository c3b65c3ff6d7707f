"""Retrieval queries: dense, BM25, hybrid."""

from pyspark.sql import functions as F

from entries import views as V
from quarry.operators import retrieval as R
from quarry.session import shared_dir
from quarry.sources import cells, inverted

CTE = V.CTE
CTE["dense_all"] = """SELECT q.query_id, e.vec_id AS doc_id,
  round(list_dot_product(q.vector::DOUBLE[], e.embedding::DOUBLE[])
   / (sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score
  FROM query_vectors q, embeddings e"""
CTE["dense_ranked"] = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense_all"
CTE["q_text"] = "SELECT item_id AS query_id, text AS semantic FROM benchmark"
CTE["toks"] = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents"
CTE["dl"] = "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS INTEGER) AS len FROM documents"
CTE["postings"] = "SELECT term, t.doc_id, len, count(*) AS tf FROM toks t JOIN dl USING (doc_id) GROUP BY ALL"
CTE["q_terms"] = "SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(semantic), '[a-z0-9_]+')) AS term FROM q_text"
CTE["idf"] = """SELECT term, ln(1.0::DOUBLE + ((SELECT count(*) FROM dl) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf
  FROM postings GROUP BY term"""
CTE["bm25_all"] = """SELECT query_id, doc_id, round(sum(idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (SELECT avg(len) FROM dl))))), 9) AS score
  FROM q_terms JOIN postings USING (term) JOIN idf USING (term) GROUP BY ALL"""
CTE["bm25_ranked"] = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all"
CTE["prefiltered"] = "SELECT * FROM documents WHERE source <> 'src7' AND n_chars > 200"
DENSE = ("query_vectors", "dense_all", "dense_ranked")
BM25 = ("q_text", "toks", "dl", "postings", "q_terms", "idf", "bm25_all", "bm25_ranked")


def q_text(spark, sf):
    return V.t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("semantic"))


def emb(spark, sf):
    return V.vectors(spark, sf).withColumnRenamed("vec_id", "doc_id")


def dense(spark, sf, k):
    return R.dense_topk(emb(spark, sf), V.query_vectors(spark, sf), k)


def bm25(spark, sf, k):
    return R.bm25_topk(V.files(spark, sf).select("doc_id", "content"), q_text(spark, sf), k)


def stored(spark, sf):
    """The inverted index of all documents, written and opened again."""
    root = shared_dir(spark, "inverted")
    chunks = V.files(spark, sf).select("corpus", F.substring(F.md5("path"), 1, 1).alias("bucket"), "doc_id", "content")
    inverted.write(chunks, root, id_col="doc_id")
    return inverted.load(spark, root, "bigint")


def bm25_stored(spark, sf, k):
    return inverted.topk(stored(spark, sf), q_text(spark, sf), k, "doc_id")


CELLS, PROBES, SHORTLIST = 16, 13, 60


def by_cells(spark, sf, probes):
    """Top 10 of each query from the stored cell index: a first ranking by codes, 60 vectors a query exactly."""
    root = shared_dir(spark, "cells")
    cells.write(emb(spark, sf), root, CELLS)
    return cells.topk(cells.load(spark, root), V.query_vectors(spark, sf), 10, probes, SHORTLIST)


def cells_recall(spark, sf):
    """Recall of the cell index with some cells left out: at least 0.9. These vectors have no clusters, so most cells matter."""
    exact = dense(spark, sf, 10).select("query_id", "doc_id")
    near = by_cells(spark, sf, PROBES).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "doc_id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"))


def out(df):
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


ANN_TABLES, ANN_BITS, ANN_SEED = 12, 4, 17


def dense_ann(spark, sf):
    return R.dense_topk_lsh(emb(spark, sf), V.query_vectors(spark, sf), 10, tables=ANN_TABLES, bits=ANN_BITS, probes=1, seed=ANN_SEED)


def dense_ann_recall(spark, sf):
    """Recall of the approximate variant against the exact one over all queries: at least 0.9."""
    exact = dense(spark, sf, 10).select("query_id", "doc_id")
    near = dense_ann(spark, sf).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "doc_id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"))


# the same hyperplanes as numbers: the bucket of a vector, and for queries the bucket across the least certain bit too
CTE["planes"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i // ANN_BITS}, {i % ANN_BITS}, {[float(x) for x in row]}::DOUBLE[])" for i, row in enumerate(R.hyperplanes(ANN_TABLES, ANN_BITS, 64, ANN_SEED))) + ") p(t, b, normal)"
CTE["chunk_bits"] = "SELECT e.vec_id AS doc_id, t, b, list_dot_product(e.embedding::DOUBLE[], normal) AS side FROM embeddings e, planes"
CTE["chunk_bucket"] = "SELECT doc_id, t, sum(CASE WHEN side > 0 THEN 1 << b ELSE 0 END) AS code FROM chunk_bits GROUP BY doc_id, t"
CTE["query_bits"] = "SELECT q.query_id, t, b, list_dot_product(q.vector::DOUBLE[], normal) AS side FROM query_vectors q, planes"
CTE["query_bucket"] = "SELECT query_id, t, sum(CASE WHEN side > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code, arg_min(b, abs(side)) AS unsure FROM query_bits GROUP BY query_id, t"
CTE["query_probe"] = "SELECT query_id, t, code FROM query_bucket UNION ALL SELECT query_id, t, xor(code, 1::BIGINT << unsure) FROM query_bucket"
CTE["ann_pairs"] = "SELECT DISTINCT query_id, doc_id FROM query_probe q JOIN chunk_bucket c ON c.t = q.t AND c.code = q.code"
CTE["ann_ranked"] = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense_all JOIN ann_pairs USING (query_id, doc_id)"
ANN = ("query_vectors", "dense_all", "planes", "chunk_bits", "chunk_bucket", "query_bits", "query_bucket", "query_probe", "ann_pairs", "ann_ranked")


def rrf(spark, sf):
    return R.rrf_fuse([dense(spark, sf, 80), bm25(spark, sf, 80)], ["query_id"], "doc_id", 100, 10)


def store_prefilter(spark, sf):
    """The filter holds before the top k on the dense and the sparse side alike."""
    keep = V.files(spark, sf).where("corpus <> 'src7' AND size > 200").select("doc_id", "content")
    vec = keep.select("doc_id").join(emb(spark, sf), "doc_id")
    d = R.dense_topk(vec, V.query_vectors(spark, sf), 20)
    b = R.bm25_topk(keep, q_text(spark, sf), 20)
    return R.rrf_fuse([d, b], ["query_id"], "doc_id", 100, 20)


QUERIES = {
    "dense_topk": lambda s, sf: out(dense(s, sf, 10)),
    "dense_threshold": lambda s, sf: out(dense(s, sf, 10)).where(F.col("score") >= 0.5),
    "score_threshold": lambda s, sf: out(dense(s, sf, 25)).where(F.col("score") >= R.check_threshold("dense", 0.25)),
    "dense_topk_ann": lambda s, sf: out(dense_ann(s, sf)),
    "dense_ann_recall": dense_ann_recall,
    "dense_topk_cells": lambda s, sf: out(by_cells(s, sf, CELLS)),
    "dense_cells_recall": cells_recall,
    "bm25_index": lambda s, sf: R.bm25_postings(V.files(s, sf)).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf")),
    "bm25_topk": lambda s, sf: out(bm25(s, sf, 10)),
    "bm25_stored_topk": lambda s, sf: out(bm25_stored(s, sf, 10)),
    "bm25_stored_index": lambda s, sf: stored(s, sf).postings.groupBy("term").agg(
        F.sum("n").alias("df"), F.sum("words").alias("occurrences"), F.max("top_tf").alias("max_tf")),
    "rrf_stored": lambda s, sf: out(R.rrf_fuse([dense(s, sf, 80), bm25_stored(s, sf, 80)], ["query_id"], "doc_id", 100, 10)),
    "rrf_hybrid": lambda s, sf: out(rrf(s, sf)),
    "store_prefilter": lambda s, sf: out(store_prefilter(s, sf)),
}

_OUT = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM"
_PRE = ("""SELECT query_id, doc_id, round(score,6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT query_id, doc_id, round(sum(1.0::DOUBLE/(100+rank)),12) AS score FROM (%s) GROUP BY ALL)) WHERE rank <= %d""")
SQL = {
    "dense_topk": V.sql(f"{_OUT} dense_ranked WHERE rank <= 10", *DENSE),
    "dense_threshold": V.sql(f"{_OUT} dense_ranked WHERE rank <= 10 AND round(score,6) >= 0.5", *DENSE),
    "score_threshold": V.sql(f"{_OUT} dense_ranked WHERE rank <= 25 AND round(score,6) >= 0.25", *DENSE),
    "dense_topk_ann": V.sql(f"{_OUT} ann_ranked WHERE rank <= 10", *ANN),
    "dense_ann_recall": "SELECT true AS recall_reached",
    "bm25_index": V.sql("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS max_tf FROM postings GROUP BY term", "toks", "dl", "postings"),
    "bm25_topk": V.sql(f"{_OUT} bm25_ranked WHERE rank <= 10", *BM25),
    "rrf_hybrid": V.sql(_PRE % ("SELECT query_id, doc_id, rank FROM dense_ranked WHERE rank <= 80 UNION ALL SELECT query_id, doc_id, rank FROM bm25_ranked WHERE rank <= 80", 10), *DENSE, *BM25),
    "store_prefilter": V.sql(
        _PRE % ("SELECT query_id, doc_id, rank FROM dense_ranked WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM bm25_ranked WHERE rank <= 20", 20),
        "prefiltered", *DENSE, *BM25, instead={
            "dense_all": CTE["dense_all"] + " WHERE e.vec_id IN (SELECT doc_id FROM prefiltered)",
            "toks": CTE["toks"].replace("FROM documents", "FROM prefiltered"), "dl": CTE["dl"].replace("FROM documents", "FROM prefiltered")}),
}
SQL["dense_topk_cells"], SQL["dense_cells_recall"] = SQL["dense_topk"], SQL["dense_ann_recall"]
SQL["bm25_stored_topk"], SQL["bm25_stored_index"], SQL["rrf_stored"] = SQL["bm25_topk"], SQL["bm25_index"], SQL["rrf_hybrid"]
