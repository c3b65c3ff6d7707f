import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry.llm import vptree as V
from quarry.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k=20):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for i, q in ok:
        if asked(i):
            near = sorted((-float(np.cumsum(q * v)[-1]), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_given_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op4_nearest"](spark, sf)) == brute(rows, lambda i: i % 20 == 0)


def test_edge_rows(spark, folder):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] + [1.0] * 7),
             (2100, [None] + [1.0] * 7), (None, [1.0] * 8), (2120, [1.0, 2.0, 3.0]), (2140, [3.0, 2.0, 1.0]), (-20, [50.0] * 8), (2160, [-0.0, 1.0] + [0.0] * 6), (2180, [0.0, 1.0] + [0.0] * 6)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    want = brute(rows, lambda i: i % 20 == 0)
    assert rows_of(QUERIES["op4_nearest"](spark, folder(embeddings=df))) == want
    small = V.nearest(df.withColumn("rank", F.lit(1)).withColumn("shard", F.lit("x")), F.col("vec_id") % 20 == 0, shard_rows=50, block_rows=5)
    assert rows_of(small) == want
    assert V.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("factor", [1.0, 1.3])
def test_recall_of_the_tree(factor):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.unique(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)), axis=0)
    tree = V.VantageTree(x, leaf=64)
    q = x[:200]
    rows = tree.search(q, 20, factor)
    scores = q @ x.T
    hits = sum(len(set(np.argsort(-s, kind="stable")[:20]) & set(r.tolist())) for s, r in zip(scores, rows, strict=True))
    recall = hits / (20 * len(q))
    assert recall == 1.0 if factor == 1.0 else recall >= 0.9
