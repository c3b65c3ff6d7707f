import zlib
from collections import Counter

import numpy as np

from quarry.llm import sharding as S
from quarry.llm.queries import QUERIES


def check(rows, texts, shards=16):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    by = Counter(r["shard"] for r in rows)
    assert set(by) <= set(range(shards))
    assert max(by.values()) - min(by.get(s, 0) for s in range(shards)) <= 1
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))


def test_query_on_edge_rows_and_given_table(spark, docs, folder):
    from tests.llm.conftest import doc_rows
    sf = folder(documents=docs)
    once = QUERIES["op9_sharding"](spark, sf).collect()
    check(once, [r[:2] for r in doc_rows()])
    assert sorted(map(str, once)) == sorted(map(str, QUERIES["op9_sharding"](spark, sf).repartition(3).collect()))
    sf = "/root/testdata/sf0.001"
    check(QUERIES["op9_sharding"](spark, sf).collect(), [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_empty_table_and_clashing_columns(spark, no_docs, clashing):
    assert S.shuffle_into_shards(no_docs, ["doc_id", "text"]).count() == 0
    out = S.shuffle_into_shards(clashing, ["doc_id", "text"], 3)
    assert set(clashing.columns) == set(out.columns) and out.count() == clashing.count()
    assert dict(out.dtypes)["shard"] == "int"


def test_matrix_has_exact_margins():
    rows, sizes = [7, 0, 100, 13], S.shard_sizes(120, 7)
    m = S.communication_matrix(rows, sizes, 1)
    assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == sizes).all() and sizes.max() - sizes.min() <= 1


def test_shards_are_uniform(spark):
    """Neighbours in the input are no likelier to share a shard than others."""
    df = spark.range(8000).withColumnRenamed("id", "k")
    shard = np.array([r["shard"] for r in S.shuffle_into_shards(df, ["k"], 8).orderBy("k").collect()])
    same = (shard[1:] == shard[:-1]).mean()
    assert abs(same - 1 / 8) < 0.02
    counts = np.bincount(shard[:4000], minlength=8)
    assert counts.sum() == 4000 and abs(counts - 500).max() < 90
