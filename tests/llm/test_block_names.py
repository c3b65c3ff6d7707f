import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import block_names, common, queries


def lowered(text):
    return (text or "").encode().lower()


def check(rows, found):
    """``rows``: (doc_id, text) of the input; ``found``: the operator's rows."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(lowered(t)).hexdigest()].append(i)
    assert len(found) == len(rows)
    kept = defaultdict(list)
    for r in found:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None) and r["doc_id"] in ids
        if r["kept"]:
            kept[r["text_sha256"]].append(r["doc_id"])
    assert {k: len(v) for k, v in kept.items()} == dict.fromkeys(groups, 1)
    assert all(v == [max([i for i in groups[k] if i is not None], default=None)] for k, v in kept.items())


@pytest.mark.parametrize(("block", "bits"), [(4096, 128), (7, 128), (16, 4)])      # four bits: blocks clash, digests are drawn again
def test_edge_rows(spark, docs, clashing, block, bits):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = block_names.exact_groups(clashing, block_bytes=block, digest_bits=bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check(rows, found.collect())


def test_pairs_and_lengths(spark):
    """Texts that share their blocks but not all, prefixes of each other, and odd numbers of blocks."""
    texts = ["a" * n for n in range(40)] + ["ab" * n + tail for n in range(12) for tail in ("", "A", "b")] + ["É" * 9, "é" * 9, "ABCDEFGHabcdefgh", "abcdefghABCDEFGH"]
    rows = [(i % 50, t) for i, t in enumerate(texts + texts[::3])]
    check(rows, block_names.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4).collect())


def test_names_agree_with_another_split(spark, docs):
    named = lambda df: sorted((r["text_sha256"], r["level"], r["name"]) for r in block_names.identities(df, block_bytes=64).collect())
    assert named(docs.repartition(1)) == named(docs.repartition(7))


def test_empty_table_and_other_id_kinds(spark, no_docs):
    assert block_names.exact_groups(no_docs).collect() == []
    rows = [("b", "X"), ("a", "x"), (None, "x"), (None, None), ("c", "")]
    check(rows, block_names.exact_groups(spark.createDataFrame(rows, "name string, body string"), "name", "body").collect())


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1200, 0).otherwise(F.col("id")).alias("k"), "id")
    found = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_counted(rows, found, ["k"], "n", hot_rows=1000)
    assert {(r["k"], r["id"], r["n"]) for r in got.collect()} == {(0 if i < 1200 else i, i, 1200 if i < 1200 else 1) for i in range(3000)}


def test_query(spark, folder, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, queries.op13_exact_dedup(spark, folder(documents=docs)).collect())
