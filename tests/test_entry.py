import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {n for n in set(q) - set(o) if not re.match(r"op\d+_|pipeline$", n)}
    assert not own


def test_flagship(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "query_id" in df.columns


def test_oracles_on_a_few_queries(spark):
    import duckdb
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels orders customer events lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for n in ("dense_topk", "snapshot_diff", "query_lexical_terms", "state_merge", "chunk_split_large"):
        df = E.queries()[n](spark, SF)
        cols = sorted(df.columns)
        got = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
        want = sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[n]})").fetchall()))
        assert got == want, n
