import hashlib
import random

import numpy as np
import pytest

from quarry.llm import intervals as I, substring_bwt as S
from quarry.llm.queries import QUERIES
from quarry.llm.seeds import window_seeds


def brute(texts, length=50):
    first = {}
    for d, t in texts:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if d is not None:
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in texts:
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if d is not None and first[data[i:i + length]] < d:
                gone[i:i + length] = [True] * length
        rest = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(map(str, out))


def planted(n, seed):
    random.seed(seed)
    word = lambda: random.choice(["tree", "a", "stone", "é", "walk", "of", "the", "river", "中文", "x1", "b", "light"])
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(random.randint(12, 60)) for _ in range(12)] + ["ab" * 60, "z" * 300]
    out = []
    for i in range(n):
        t = " ".join(random.choice([text(random.randint(0, 30)), random.choice(shared)]) for _ in range(random.randint(0, 6)))
        if out and random.random() < 0.3:
            t = list(random.choice(out)[1])
            for _ in range(random.randint(0, 3)):
                if t:
                    t[random.randrange(len(t))] = "q"
            t = "".join(t)
        out.append((i * 7 % n, t))
    return out


@pytest.mark.parametrize("batch_bytes", [4 << 20, 3000])
def test_planted_repeats(spark, folder, batch_bytes):
    texts = planted(150, 3) + [(None, "z" * 300), (None, None), (5000, None), (5001, ""), (5002, "y" * 49), (5003, "y" * 50), (5004, "y" * 51), (5004, "y" * 70), (-1, "z" * 120)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS batch", "'y' AS starts", "1 AS n_bytes")
    done = S.remove_repeats(df, batch_bytes=batch_bytes).collect()
    got = [(r["doc_id"], r["n_bytes"], sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest()) for r in done]
    assert sorted(map(str, got)) == brute(texts)


def test_query_on_edge_rows(spark, docs, folder, no_docs):
    from tests.llm.conftest import doc_rows
    texts = [r[:2] for r in doc_rows()]
    assert sorted(str(tuple(r)) for r in QUERIES["op7_suffix_dedup"](spark, folder(documents=docs)).collect()) == brute(texts)
    assert S.remove_repeats(no_docs).count() == 0


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op7_suffix_dedup"](spark, sf).collect()) == brute(texts)


def test_intervals_match_plain_search():
    rng = np.random.default_rng(1)
    for n, letters, length in ((1, 2, 3), (60, 2, 5), (400, 3, 8), (3000, 2, 20), (500, 1, 50), (2000, 4, 90)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        if n > 1000:
            data[n // 2:n // 2 + 200] = data[:200]
        owner = rng.integers(0, 1000, n)
        raw, least = data.tobytes(), {}
        for i in range(n):
            w = raw[i:i + length]
            least[w] = min(least.get(w, 1 << 60), owner[i])
        got = I.least_owner(data, owner, length)
        whole = max(0, n - length + 1)
        assert got[:whole].tolist() == [least[raw[i:i + length]] for i in range(whole)]


def test_every_window_has_its_seed():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    ends = np.array([0, 40, 40, 900, 901, 2500, 4000])
    at, h = window_seeds(data, ends, 50, 24)
    seeds = dict(zip(at.tolist(), h.tolist(), strict=True))
    by = {}
    for p in range(4000 - 49):
        if any(p < e < p + 50 for e in ends):
            continue
        inside = [(p2 - p, seeds[p2]) for p2 in range(p, p + 27) if p2 in seeds]
        low = min(x for _, x in inside)
        key = (data[p:p + 50].tobytes())
        assert by.setdefault(key, [o for o, x in inside if x == low]) == [o for o, x in inside if x == low]
