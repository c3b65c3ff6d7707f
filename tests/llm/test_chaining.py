import random
import re

import numpy as np
import pytest

from quarry.llm import chaining as C
from quarry.llm.queries import QUERIES
from quarry.llm.words import run_seeds, word_hashes


def brute_best(x, y, cost):
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    f = {}
    for j in order:
        f[j] = 1 + max([0.0] + [f[i] - cost * (x[j] - x[i] + y[j] - y[i]) for i in f if x[i] < x[j] and y[i] < y[j]])
    return max(f.values())


def test_chain_is_the_best_one():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        x, y = rng.permutation(80)[:n], rng.integers(0, 60, n)
        chains = C.chain(x, y, 0.02, 10**9)
        assert sorted(i for c in chains for i in c) == list(range(n))
        for c in chains:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
        first = chains[0]
        score = len(first) - 0.02 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(first, first[1:], strict=False))
        assert score == pytest.approx(brute_best(x.tolist(), y.tolist(), 0.02))


def test_passages_are_dense_and_lose_no_dense_stretch():
    rng = np.random.default_rng(2)
    for _ in range(100):
        flags = np.repeat(rng.random(40) < 0.6, rng.integers(1, 30, 40))
        found = C.passages(flags, 0.8, 20)
        for (a, z, n), nxt in zip(found, [*found[1:], (len(flags), 0, 0)], strict=True):
            assert z <= nxt[0] and n == flags[a:z].sum() and n >= 0.8 * (z - a) - 1e-9 and z - a >= 20
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        for a, z in zip(edges[::2], edges[1::2], strict=True):      # a run of matches of that length lies in a passage
            assert z - a < 20 or any(p <= a and z <= q for p, q, _ in found)


def test_word_hashes_and_seeds():
    texts = ["One two  THREE", "", "x" * 200 + " one", " two\n", "a b c d e f g h a b c d e f g h", "tail"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - [len(r) for r in raw]
    words, first = word_hashes(b"".join(raw), starts, ends)
    plain = [w.lower() for t in texts for w in t.split()]
    assert len(words) == len(plain) and len(set(words.tolist())) == len(set(plain))
    assert all((words[i] == words[j]) == (plain[i] == plain[j]) for i in range(len(plain)) for j in range(i))
    assert first.tolist() == [0, 3, 3, 5, 6, 22]
    at, h = run_seeds(words, first, 5, 5)
    assert at.min() >= 6 and at.max() + 5 <= 22
    for p in range(6, 22 - 8):
        assert any(p <= a <= p + 4 for a in at.tolist())


def make(seed=5):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(3, 7)))
    text = lambda n: [word() for _ in range(n)]
    docs = {i: text(random.randint(30, 300)) for i in range(80)}
    passages = [text(60) for _ in range(6)]
    held = {}
    for i in range(80, 140):
        p = random.randrange(6)
        body = list(passages[p])
        if random.random() < 0.5:
            for _ in range(2):      # changed, dropped or added words
                j = random.randrange(len(body))
                body[j:j + random.randint(0, 1)] = [word()] * random.randint(0, 2)
        docs[i] = text(random.randint(5, 80)) + body + text(random.randint(5, 80))
        held.setdefault(p, []).append(i)
    docs[140] = list(docs[7])
    docs[141] = docs[3][:20] + text(40) + docs[4][:15]
    return docs, held


@pytest.mark.parametrize("batch_bytes", [4 << 20, 9000])
def test_planted_passages_are_found_and_clean_documents_left_alone(spark, batch_bytes):
    docs, held = make()
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(None, " ".join(docs[3])), (500, None), (501, ""), (502, "few words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS batch", "'x' AS similarity", "2 AS kind")
    found = {}
    for r in C.shared_passages(df, batch_bytes=batch_bytes).collect():
        assert r["matched_words"] >= 0.8 * (r["end_word"] - r["start_word"]) and all(d < r["doc_id"] for d in r["earlier"])
        found.setdefault(r["doc_id"], []).append(r)
    for ids in held.values():
        assert min(ids) not in found
        for i in sorted(ids)[1:]:
            assert len(found[i]) == 1 and found[i][0]["end_word"] - found[i][0]["start_word"] >= 40 and set(found[i][0]["earlier"]) <= set(ids)
    assert found[140][0]["end_word"] - found[140][0]["start_word"] == len(docs[140]) and found[140][0]["earlier"] == [7]
    assert set(found) == {i for ids in held.values() for i in sorted(ids)[1:]} | {140}


def test_query_on_edge_rows_and_given_table(spark, docs, folder, no_docs):
    rows = QUERIES["op5_shared_passages"](spark, folder(documents=docs)).collect()
    assert {r["doc_id"] for r in rows} <= {10, 2, *range(100, 140)} and 6 not in {r["doc_id"] for r in rows}
    assert C.shared_passages(no_docs).count() == 0
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    runs = {}
    for d, w in texts.items():      # every run of 50 equal words that an earlier document holds lies in a passage
        for i in range(len(w) - 49):
            runs.setdefault(" ".join(w[i:i + 50]), []).append((d, i))
    found = {}
    for r in QUERIES["op5_shared_passages"](spark, sf).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    want = [(d, i) for at in runs.values() for d, i in at if d > min(at)[0]]
    missed = [x for x in want if not any(a <= x[1] and x[1] + 50 <= z for a, z in found.get(x[0], []))]
    assert want and len(missed) <= 0.01 * len(want), (len(missed), len(want))


def stretches_of(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = {}
    for r in C.shared_passages(df).collect():
        assert r["matched_words"] >= 0.8 * (r["end_word"] - r["start_word"]) - 1e-9
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["earlier"]))
    return found


def writer(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9)))
    return rng, word, lambda n: [word() for _ in range(n)]


def test_passages_whose_seeds_are_held_by_others_too(spark):
    rng, word, text = writer(11)
    docs, want, n = {}, {}, 0
    for change in [None] * 8 + [10] * 8:
        body = text(60)
        for i in range(0, 56):        # each run of 5 words stands in an earlier document of its own
            docs[n := n + 1] = text(15) + body[i:i + 5] + text(15)
        docs[(holder := (n := n + 1))] = text(20) + body + text(20)
        docs[(n := n + 1)] = text(30) + [word() if change and i % change == change - 1 else w for i, w in enumerate(body)] + text(30)
        want[n] = holder
    found = stretches_of(spark, docs)
    for d, holder in want.items():
        assert any(a <= 30 and z >= 89 and holder in earlier for a, z, earlier in found[d]), (d, found.get(d))


def test_evenly_and_randomly_changed_passages(spark):
    rng, word, text = writer(12)
    docs, n = {}, 0
    want = {}
    for change in [5, 6, 7, 0.15, 0.18] * 8:
        body = text(60)
        docs[(n := n + 1)] = text(20) + body + text(20)
        if change < 1:
            places = rng.sample(range(1, 59), round(60 * change))
        else:
            places = range(change - 1, 60, change)
        docs[(n := n + 1)] = text(30) + [word() if i in places else w for i, w in enumerate(body)] + text(30)
        want[n] = change
    found = stretches_of(spark, docs)
    missed = [(d, c) for d, c in want.items() if not any(a >= 25 and z <= 95 and earlier == [d - 1] for a, z, earlier in found.get(d, []))]
    assert not missed, missed


def test_every_equal_run_of_a_passage_is_found(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    runs = {}
    for d, w in texts.items():
        for i in range(len(w) - C.LEAST_WORDS + 1):
            runs.setdefault(" ".join(w[i:i + C.LEAST_WORDS]), []).append((d, i))
    found = {}
    for r in QUERIES["op5_shared_passages"](spark, sf).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    want = [(d, i) for at in runs.values() for d, i in at if d > min(at)[0]]
    assert want and not [x for x in want if not any(a <= x[1] and x[1] + C.LEAST_WORDS <= z for a, z in found.get(x[0], []))]


def test_no_stretch_with_the_share_is_without_a_passage():
    rng = np.random.default_rng(4)
    for _ in range(200):
        flags = np.repeat(rng.random(30) < 0.6, rng.integers(1, 12, 30))
        total, found = np.concatenate([[0], np.cumsum(flags)]), C.passages(flags, 0.8, 40)
        assert all(n == flags[a:z].sum() and n >= 0.8 * (z - a) - 1e-9 and z - a >= 40 for a, z, n in found)
        for a in np.flatnonzero(flags):
            for z in np.flatnonzero(flags) + 1:
                if z - a >= 40 and total[z] - total[a] >= 0.8 * (z - a):
                    assert any(p < z and a < q for p, q, _ in found), (a, z, found)


def plain_common(a, b):
    """Length of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def is_subsequence(a, b):
    rest = iter(b)
    return all(any(x == y for y in rest) for x in a)


def test_common_words_of_many_pairs_at_once():
    rng = np.random.default_rng(7)
    mine, other = rng.integers(0, 6, 4000).astype(np.uint32), rng.integers(0, 6, 4000).astype(np.uint32)
    n, m, step = rng.integers(0, 30, 300), rng.integers(0, 30, 300), rng.choice([1, -1], 300)
    a, b = rng.integers(30, 3970, 300), rng.integers(30, 3970, 300)
    pair, word = C.common(C.Windows(mine, other, a, n, b, m, step))
    for i in range(300):
        x, y = mine[a[i] + step[i] * np.arange(n[i])].tolist(), other[b[i] + step[i] * np.arange(m[i])].tolist()
        got = np.sort(word[pair == i]).tolist()
        assert len(got) == len(set(got)) == plain_common(x, y) and is_subsequence([x[j] for j in got], y)


def changed(rng, words):
    """The words with single ones replaced, dropped and added."""
    out = []
    for w in words:
        kind = rng.random()
        if kind > 0.06:
            out.append(w)
        if kind < 0.04:
            out.append(int(rng.integers(10**6, 10**7)))
    return out


def plain_between(a, b):
    """Words of a that a longest common subsequence with b matches, the earliest of a where there are several."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + (a[i] == b[j]))
    i, j, out = 0, 0, []
    while i < len(a) and j < len(b):
        if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_onward(a, b):
    n = min(len(a), len(b))
    near = min(n, 16)
    straight = [i for i in range(n) if a[i] == b[i]]
    placed = sum(i < near for i in straight)
    return plain_between(a, b) if placed < near and sum(w in b for w in a[:near]) > max(0.6 * near, placed) else straight


def plain_align(a, b, xs, ys):
    """One chain, match by match."""
    hit, run, beyond = set(), C.RUN, C.BEYOND
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        hit |= set(range(x, x + run))
        if i and x - xs[i - 1] == y - ys[i - 1]:
            hit |= {j for j in range(xs[i - 1], x) if a[j] == b[j - x + y]}
        elif i:
            begin, to = min(xs[i - 1] + run, x), min(ys[i - 1] + run, y)
            hit |= {begin + j for j in plain_between(a[begin:x], b[to:y])}
    hit |= {xs[0] - 1 - j for j in plain_onward(a[max(0, xs[0] - beyond):xs[0]][::-1], b[max(0, ys[0] - beyond):ys[0]][::-1])}
    x, y = xs[-1] + run, ys[-1] + run
    return sorted(hit | {x + j for j in plain_onward(a[x:x + beyond], b[y:y + beyond])})


def test_all_chains_of_a_batch_are_aligned_together_as_each_by_itself(monkeypatch):
    rng = np.random.default_rng(8)
    mine, other, edges, groups = [], [], [], []
    for _ in range(150):
        text = rng.integers(0, 10**6, 120).tolist()
        a, b = changed(rng, text), changed(rng, text)
        at = {tuple(b[j:j + C.RUN]): j for j in range(len(b) - C.RUN + 1)}
        xy = [(i, at[tuple(a[i:i + C.RUN])]) for i in range(len(a) - C.RUN + 1) if tuple(a[i:i + C.RUN]) in at]
        groups.append(np.array(xy) + [len(mine), len(other)])
        edges.append((len(mine), len(mine) + len(a), len(other), len(other) + len(b)))
        mine, other = mine + a, other + b
    mine, other = np.array(mine, np.uint32), np.array(other, np.uint32)
    new = np.concatenate([np.arange(len(g)) == 0 for g in groups])
    x, y = np.concatenate(groups).T
    tables = []
    monkeypatch.setattr(C, "_common", lambda a, b, plain=C._common: tables.append(len(a)) or plain(a, b))
    of, place = C.align(mine, other, new, x, y, np.array(edges).T)
    assert sum(tables) > 150 and len(tables) <= 18         # a table for gaps of like size, not one for each gap
    for i, (g, edge) in enumerate(zip(groups, edges, strict=True)):
        alone = C.align(mine, other, np.arange(len(g)) == 0, *g.T, np.array([edge]).T)[1]
        assert place[of == i].tolist() == alone.tolist()
        assert alone.min() >= edge[0] and alone.max() < edge[1] and np.isin(mine[alone], other[edge[2]:edge[3]]).all()
        assert set((g[:, :1] + np.arange(C.RUN)).ravel().tolist()) <= set(alone.tolist())
        assert (alone - edge[0]).tolist() == plain_align(mine[edge[0]:edge[1]].tolist(), other[edge[2]:edge[3]].tolist(), *(g - [edge[0], edge[2]]).T.tolist())


def test_orders_by_packed_numbers_are_the_stable_ones():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 700):
        for high in (5, 2**20, 2**40, 2**62):
            columns = [rng.integers(-high, high, n), rng.integers(0, 3, n), rng.integers(0, high, n).astype(np.int32 if high < 2**31 else np.int64)]
            assert C.by_columns(*columns).tolist() == np.lexsort(columns[::-1]).tolist()
            h = rng.integers(0, high, n).astype(np.uint64)      # small numbers differ in their last bits only
            for g in (h, h << np.uint64(40), h * np.uint64(0x9E3779B97F4A7C15)):
                assert C.by_hash(g).tolist() == np.argsort(g, kind="stable").tolist()


def test_word_hashes_of_all_sizes_also_in_32_bits():
    rng = random.Random(10)
    words = ["".join(rng.choice("abq1é中") for _ in range(rng.randint(1, 70))) for _ in range(20_000)] + ["abcdefg" + c for c in "0123456789pqrstuvwxy"]
    raw = " ".join(words).encode()
    h, _ = word_hashes(raw, np.array([0]), np.array([len(raw)]))
    assert len(h) == len(words) and len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert len(set(h.astype(np.uint32).tolist())) >= len(set(words)) - 3
    upper, _ = word_hashes(raw.upper(), np.array([0]), np.array([len(raw)]))
    assert upper.tolist() == h.tolist()


def test_a_batch_has_a_cell_in_few_buckets_and_offers_the_same_in_all(spark):
    import pandas as pd
    from quarry.llm import batches as B

    docs, _ = make(6)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    packed = [f for _, f in B.pack(df, 4).toPandas().groupby("batch")]
    offered = []
    for buckets in (1, 64):
        sent = pd.concat([C._send(buckets, 30)(f) for f in packed])
        flags = pd.concat([C._flags(f) for _, f in sent.groupby("bucket")])
        rows = [C._offer(buckets)(f, flags[flags["batch"] == f["batch"].iloc[0]]) for f in packed]
        offered.append([np.concatenate([C._unsqueezed(x) for x in r["entries"]]).tolist() for r in rows])
    assert offered[0] == offered[1] and all(offered[0])


def test_cells_are_few(spark):
    import pandas as pd
    from quarry.llm import batches as B

    docs, _ = make(7)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    n = B.batch_count(rows, 1000)
    buckets = -(-n // C.BUCKET_BATCHES)
    sent = pd.concat([C._send(buckets, 30)(f) for _, f in B.pack(rows, n).toPandas().groupby("batch")])
    assert n > 60 and len(sent) <= n * buckets <= n * (n / 4 + 1)
