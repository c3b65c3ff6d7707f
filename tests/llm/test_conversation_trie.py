import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from quarry.llm import conversation_trie as T
from quarry.llm import queries
from quarry.llm.slots import SlotTable

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
    ends = lambda n: ",".join(map(str, sorted(c for c in members[n] if len(full[c]) == len(n))))
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest())
                  for n, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.collect())


def edge_rows():
    rows = [(c, t, ["user", "assistant"][t % 2], f"shared opening {t}" if t < 3 else f"turn {t} of {c % 3}") for c in range(60) for t in range(c % 9)]
    rows += [(c, t, "user", "the same for all") for c in range(100, 140) for t in range(5)]          # copies
    rows += [(7, None, None, None), (7, None, "user", ""), (8, 1, "user", None), (8, 1, "user", None), (None, 0, "user", "no id"), (None, None, None, None)]
    rows += [(201, t, "user", f"long {t}") for t in range(300)] + [(202, t, "user", f"long {t}") for t in range(200)]   # one hot conversation, shared deep
    return rows + [(203, 0, "user", "alone"), (1001, 0, "user", "base is absent"), (77, 2, "é", "ü\n" * 3)]


@pytest.fixture
def talks(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 20, "heavy_nodes": 10**6, "hot_rows": 3}, {"shard_rows": 3, "heavy_nodes": 10**6}, {"shard_rows": 3, "heavy_nodes": 40}])
def test_edge_rows(spark, talks, limits):
    extra = talks.selectExpr("*", "'x' AS cid", "1 AS depth", "2 AS part", "3 AS rank", "4 AS k1", "5 AS last")
    assert found(T.trie(extra.repartition(5), **limits)) == brute(edge_rows())


def test_clashing_digests_are_drawn_again(spark, talks):
    assert found(T.trie(talks, digest_bits=6)) == brute(edge_rows())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(T.trie(none)) == []
    assert found(T.trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA))) == []
    for rows in ([(3, 0, "user", "x")], [(5, 0, "user", "x")]):
        assert found(T.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_other_columns_names(spark):
    rows = [(5, 0, "a", "x"), (6, 0, "a", "x"), (6, 1, "b", "y")]
    assert found(T.trie(spark.createDataFrame(rows, "c int, n int, who string, said string"), "c", "n", "who", "said")) == brute(rows)


def test_query(spark, folder, talks):
    assert found(queries.op12_conversation_trie(spark, folder(conversations=talks))) == brute(edge_rows())


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_slots_are_a_permutation_and_strangers_are_found_out(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-2**63, 2**63 - 1, (n, 2)), axis=0) if n else np.zeros((0, 2), np.int64)
    table = SlotTable(keys[:, 0], keys[:, 1])
    assert sorted(table.slots.tolist()) == list(range(len(keys)))
    assert (table.find(keys[:, 0], keys[:, 1]) == table.slots).all()
    other = rng.integers(-2**63, 2**63 - 1, (1000, 2))
    assert (table.find(other[:, 0], other[:, 1]) == -1).all()


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError, match="repeat"):
        SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_accumulate_goes_from_the_deepest_up():
    frame = pd.DataFrame({"k1": [1, 2, 3, 4], "k2": [1, 2, 3, 4], "p1": [9, 1, 1, 3], "p2": [9, 1, 1, 3], "depth": [4, 5, 5, 6], "saved": [1, 10, 100, 1000], "leaves": [0, 1, 0, 1]})
    out = T.accumulate(frame)
    assert out["saved"].tolist() == [1111, 10, 1100, 1000] and out["leaves"].tolist() == [2, 1, 1, 1] and out["inner"].tolist() == [False, True, True, True]
