import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash as S
from quarry.llm.queries import QUERIES


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, limit=2):
    codes = sorted(set(prints))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    return {c: find(c) for c in codes}


def expected(texts):
    prints = [(d, brute_print(t)) for d, t in texts]
    roots = brute_components([h for _, h in prints])
    least = {}
    for d, h in prints:
        if d is not None:
            least[roots[h]] = min(d, least.get(roots[h], d))
    return Counter((d, f"{h:016x}", least.get(roots[h])) for d, h in prints)


def test_query_on_edge_rows(spark, docs, folder, no_docs, clashing):
    from tests.llm.conftest import doc_rows
    want = expected([r[:2] for r in doc_rows()])
    assert Counter(tuple(r) for r in QUERIES["op2_simhash"](spark, folder(documents=docs)).collect()) == want
    assert S.near_duplicates(no_docs).count() == 0
    assert S.near_duplicates(clashing).count() == len(doc_rows())


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op2_simhash"](spark, sf).collect()) == expected(texts)


def planted(n, seed):
    """Codes of which many lie within a few bits of each other, some in long chains."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(1, n):
        if rng.random() < 0.6:
            codes[i] = codes[rng.integers(0, i)]
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                codes[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(codes)


@pytest.mark.parametrize("fan_out", [2, 8])
def test_index_finds_all_within_limit(fan_out):
    codes = planted(700, 1)
    index = S.GrayIndex(codes, fan_out)
    q, c = index.search(codes, 2)
    got = set(zip(codes[q].tolist(), index.codes[c].tolist(), strict=True))
    assert got == {(a, b) for a in codes.tolist() for b in codes.tolist() if (a ^ b).bit_count() <= 2} and len(got) == len(q)


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_links_lose_none(spark, group_rows):
    """Also where groups are dealt out again and again."""
    from quarry.llm.components import connected
    codes = planted(400, 2)
    codes = np.unique(np.concatenate([codes, codes[0] ^ (np.uint64(1) << np.arange(0, 60, dtype=np.uint64))]))
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "h long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in connected(S.links(df, 2, group_rows)).collect()}
    want = brute_components(codes.tolist())
    parts = Counter(want.values())
    assert set(roots) == {c for c in codes.tolist() if parts[want[c]] > 1}
    assert len({(want[c], roots[c]) for c in roots}) == len(set(roots.values())) == sum(n > 1 for n in parts.values())


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64)
    assert (S.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()
