"""The stored inverted index and the cell index, against the same searches over text and all vectors."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.plans import index, search
from quarry.session import shared_dir
from quarry.sources import cells, inverted
from quarry.functions.embedders import letter_vector
from quarry.operators.state import fingerprint

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    rows = [(i, f"c{i % 3 if i % 2 else 0}", f"{i % 7:x}", " ".join(rng.choices(WORDS, weights=range(1, 11), k=rng.randint(1, 60))) + f" rare{i % 50}") for i in range(600)]
    rows += [(9000, "c0", "0", ""), (9001, "c1", "1", "  ,,, "), (9002, "c9", "f", "alone in its corpus")]
    return spark.createDataFrame(rows, "doc_id long, corpus string, bucket string, content string").cache()


@pytest.fixture(scope="module")
def stored(spark, chunks):
    root = shared_dir(spark, "inverted-test")
    inverted.write(chunks, root, id_col="doc_id")
    return root


def asked(spark):
    rows = [(1, "c0", "kappa alpha"), (2, "c1", "rare7 beta rare7"), (3, "c2", "kappa iota theta eta"), (4, "c0", "unknown"), (5, "c9", "alone kappa"), (6, "c0", ""), (7, "c1", "rare3 kappa iota")]
    return spark.createDataFrame(rows, "query_id long, corpus string, semantic string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("within", [None, "corpus"])
@pytest.mark.parametrize("k", [1, 5, 1000])
@pytest.mark.parametrize("few", [10**6, 0])
def test_same_rows_as_from_text(spark, chunks, stored, within, k, few):
    got = inverted.topk(inverted.load(spark, stored, "bigint"), asked(spark), k, "doc_id", within=within, broadcast_terms=few, salts=3)
    assert rows(got) == rows(R.bm25_topk(chunks, asked(spark), k, "doc_id", within=within))


def test_blocks_that_cannot_matter_are_left_out(spark, stored):
    opened = inverted.load(spark, stored, "bigint")
    q = spark.createDataFrame([(1, "rare7 kappa"), (2, "kappa")], "query_id long, semantic string")
    every = {r["_q"]: r["n"] for r in inverted.kept_blocks(opened, q, 10**6).groupBy("_q").agg(F.sum("n").alias("n")).collect()}
    kept = {r["_q"]: r["n"] for r in inverted.kept_blocks(opened, q, 3).groupBy("_q").agg(F.sum("n").alias("n")).collect()}
    assert kept[2] < every[2] / 3 and kept[1] <= every[1]


def test_search_opens_its_term_buckets_and_reads_no_text(spark, stored):
    plan = inverted.topk(inverted.load(spark, stored, "bigint"), spark.createDataFrame([(1, "kappa")], "query_id long, semantic string"), 3, "doc_id")._jdf.queryExecution().toString()
    assert "content" not in plan and "EqualTo(tb," in plan


def test_blocks_are_cut_from_sorted_batches(spark):
    # 300 chunks of one impact class for "same", which batches of 70 rows cut anywhere
    rows = [("c", "0", f"k{i:03d}", "same same word%d other" % (i % 40)) for i in range(300)] + [("c", "0", "none", "- -"), ("d", "1", "long", "same " * 50)]
    chunks = spark.createDataFrame(rows, "corpus string, bucket string, chunk_id string, content string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        made = inverted.blocks(chunks.coalesce(1))
        got = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(b.n for b in got if b.term == "same") == [1, 44, 128, 128] and sorted(b.n for b in got if b.term == "other") == [44, 128, 128]
    for b in got:
        tf, length = [r.tf for r in b.rows], [r.len for r in b.rows]
        assert (b.n, b.words, b.top_tf, b.low_tf, b.top_len, b.low_len) == (len(b.rows), sum(tf), max(tf), min(tf), max(length), min(length))
    want = {(c, b, i, w, t.split().count(w), len(t.split())) for c, b, i, t in rows for w in t.split() if w != "-"}
    assert sorted((b.corpus, b.bucket, r.id, b.term, r.tf, r.len) for b in got for r in b.rows) == sorted(want)
    assert "Window" not in made._jdf.queryExecution().toString()


def test_rewritten_buckets(spark, chunks, stored):
    root = shared_dir(spark, "inverted-again")
    inverted.write(chunks, root, id_col="doc_id")
    changed = chunks.where("NOT (corpus = 'c0' AND bucket = '2')").withColumn("content", F.when(F.col("bucket") == "3", F.lit("kappa new words")).otherwise(F.col("content")))
    parts = spark.createDataFrame([("c0", "2"), ("c0", "3"), ("c1", "3"), ("c2", "3")], "corpus string, bucket string")
    inverted.write(changed.join(parts, ["corpus", "bucket"], "left_semi"), root, replaces=parts, id_col="doc_id")
    for within in (None, "corpus"):
        assert rows(inverted.topk(inverted.load(spark, root, "bigint"), asked(spark), 9, "doc_id", within=within)) == rows(R.bm25_topk(changed, asked(spark), 9, "doc_id", within=within))
    inverted.drop(spark, root, spark.createDataFrame([("c0",)], "corpus string"))
    assert rows(inverted.topk(inverted.load(spark, root, "bigint"), asked(spark), 9, "doc_id")) == rows(R.bm25_topk(changed.where("corpus <> 'c0'"), asked(spark), 9, "doc_id"))


FP = {"provider": "p", "model": "m", "dimension": 26, "store": "parquet", "schema_version": "hybrid_v3"}


def test_built_and_synced_index_answers_like_the_text(spark):
    root, now = shared_dir(spark, "index-test"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    rng = random.Random(2)
    text = lambda: "\n".join(" ".join(rng.choices(WORDS, k=6)) for _ in range(rng.randint(1, 30)))
    files = [(f"c{i % 2}", f"src/f{i}.py", text(), i, 1000 + i) for i in range(30)]
    schema = "corpus string, path string, content string, size long, mtime long"
    q = spark.createDataFrame([(1, "c0", "kappa alpha", "mixed", "file", 5), (2, "c1", "where is beta", "runtime", "symbol", 4)],
                              "query_id long, corpus string, raw string, scope string, group_by string, result_limit int")

    def same():
        held, _ = index.load(spark, root)
        plain = search.search_raw(q, held, letter_vector).select("query_id", "chunk_id", "rank").collect()
        lists = search.pass_lists(search.prepare(q), held, letter_vector, lexical=index.load_postings(spark, root))
        assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, search.pass_lists(search.prepare(q), held, letter_vector).collect())) and plain

    index.build(spark.createDataFrame(files, schema), root, letter_vector, fingerprint(FP), now, "r1")
    same()
    files = [(*f[:2], text(), f[3] + 100, f[4] + 1) if i % 7 == 0 else f for i, f in enumerate(files)][2:]
    index.sync(spark.createDataFrame(files, schema), root, letter_vector, fingerprint(FP), now + F.expr("INTERVAL 1 HOUR"), "r2")
    same()


def test_a_run_that_dies_leaves_no_proof(spark, monkeypatch):
    root, now = shared_dir(spark, "index-dies"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    files = spark.createDataFrame([(c, f"src/{c}{i}.py", f"words {i}", 1, 1) for c in ("a", "b") for i in range(4)], "corpus string, path string, content string, size long, mtime long")
    proofs = lambda: {r["corpus"]: r["run_id"] for r in index.load(spark, root)[1].collect()}
    index.build(files, root, letter_vector, fingerprint(FP), now, "r1")
    assert proofs() == {"a": "r1", "b": "r1"}

    def dies(*_, **__):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(inverted, "write", dies)
        with pytest.raises(RuntimeError, match="lost"):
            index.build(files.where("corpus = 'a'"), root, letter_vector, fingerprint(FP), now + F.expr("INTERVAL 1 HOUR"), "r2")
        assert proofs() == {"b": "r1"}
        with pytest.raises(RuntimeError, match="lost"):
            index.sync(files.where("corpus = 'b'").withColumn("content", F.lit("x")).withColumn("mtime", F.col("mtime") + 1), root, letter_vector, fingerprint(FP), now + F.expr("INTERVAL 2 HOUR"), "r3")
        assert proofs() == {}
    index.build(files, root, letter_vector, fingerprint(FP), now + F.expr("INTERVAL 3 HOUR"), "r4")
    assert proofs() == {"a": "r4", "b": "r4"}


def test_candidates_without_a_text_shuffle(spark, chunks):
    c = chunks.selectExpr("cast(doc_id AS string) AS chunk_id", *[f"cast(NULL AS {t}) AS {n}" for n, t in (("path", "string"), ("start_line", "int"), ("end_line", "int"), ("language", "string"))],
                          "content", *[f"cast(NULL AS string) AS {n}" for n in ("symbol_id", "symbol_label", "indexed_at")])
    ids = c.where("chunk_id LIKE '1%'").select("chunk_id").union(c.limit(3).select("chunk_id"))
    want = sorted(r["chunk_id"] for r in ids.distinct().collect())
    for limit in (10**6, 1):
        assert sorted(r["chunk_id"] for r in search.fetch_chunks(c, ids, limit).collect()) == want


# --- approximate search ---------------------------------------------------------------------
def clustered(spark, n=4000, groups=40, dim=24):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((groups, dim))
    m = centre[rng.integers(0, groups, n)] + 0.35 * rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id long, vector array<float>").cache()


def found(df):
    return {(r["query_id"], r["doc_id"]) for r in df.collect()}


def test_cells_find_most_and_score_few(spark):
    vectors = clustered(spark)
    root = shared_dir(spark, "cells")
    cells.write(vectors, root, 40)
    opened = cells.load(spark, root)
    assert opened.rows.count() == 4000
    queries = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    exact = found(R.dense_topk(vectors, queries, 10))
    for room in (32 << 20, 8000):          # one block of queries, several
        near = cells.topk(opened, queries, 10, probes=4, shortlist=40, broadcast_bytes=room)
        assert len(exact & found(near)) >= 0.9 * len(exact)
    sizes = {r["cell"]: r["n"] for r in opened.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    read = [sum(sizes.get(c, 0) for c in r["cells"]) for r in cells.probed(opened, queries, 4).groupBy("_q").agg(F.collect_list("cell").alias("cells")).collect()]
    assert np.mean(read) <= 0.15 * 4000
    assert cells.shortlists(opened, queries, 4, 40).groupBy("_q").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= 40


def test_all_cells_and_rows_are_the_exact_search(spark):
    vectors = clustered(spark, 300, 5, 8)
    root = shared_dir(spark, "cells-all")
    cells.write(vectors.union(spark.createDataFrame([(None, [1.0] * 8), (999, None)], "doc_id long, vector array<float>")), root, 7)
    queries = vectors.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    for few in (10**6, 0):
        assert rows(cells.topk(cells.load(spark, root), queries, 6, probes=7, shortlist=300, broadcast_candidates=few)) == rows(R.dense_topk(vectors, queries, 6))


def test_all_cells_are_exact_when_codes_cannot_order_the_shortlist(spark):
    """Far more vectors than the shortlist holds within the error of the codes, and scores that differ beyond single precision only."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    m = np.vstack([base + 0.002 * rng.standard_normal((600, 16)), 30 * rng.standard_normal((200, 16))])
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id long, vector array<float>").repartition(5).cache()
    queries = vectors.where("doc_id % 97 = 0").withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    want = rows(R.dense_topk(vectors, queries, 10))
    for kind in ("array<float>", "array<double>"):
        root = shared_dir(spark, "cells-near")
        cells.write(vectors.withColumn("vector", F.col("vector").cast(kind)), root, 6, sample_rows=50)
        for room in (32 << 20, 600):
            assert rows(cells.topk(cells.load(spark, root), queries, 10, probes=6, shortlist=12, broadcast_bytes=room)) == want


def test_only_probed_cells_are_opened(spark):
    vectors = clustered(spark, 500, 5, 8)
    root = shared_dir(spark, "cells-plan")
    cells.write(vectors, root, 6)
    one = vectors.where("doc_id = 0").withColumnRenamed("doc_id", "query_id")
    plan = cells.shortlists(cells.load(spark, root), one, 1, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "ReadSchema: struct<id:bigint,codes:binary>" in plan


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "doc_id long, vector array<float>")
    root = shared_dir(spark, "cells-none")
    cells.write(none, root, 4)
    q = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    assert cells.topk(cells.load(spark, root), q, 3, 2, 3).collect() == []
