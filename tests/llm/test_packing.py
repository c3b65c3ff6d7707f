import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import packing as P
from quarry.llm.queries import QUERIES
from quarry.llm.tokens import WordIds, public_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_vocabulary())


def check(rows, texts, tokenizer, window=4096):
    """Every id of every document lies in one piece; sequences are gapless and no longer than the window."""
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    copies, want = Counter(d for d, _ in texts), defaultdict(Counter)
    for d, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[d][len(ids), zlib.crc32(ids.tobytes())] += 1
        for r in by[d]:
            if copies[d] == 1:
                assert r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    assert set(by) == set(copies)
    for d in by:
        if copies[d] == 1:
            at = 0
            for r in sorted(by[d], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == by[d][0]["doc_tokens"]
        else:
            assert sum(r["length"] for r in by[d]) == sum(n * k for (n, _), k in want[d].items())
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    used = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        used += at
    assert sorted(seqs) == list(range(len(seqs)))
    return 1 - used / (window * len(seqs)) if seqs else 0


def test_query_on_edge_rows(spark, docs, folder, no_docs, clashing, tokenizer):
    from tests.llm.conftest import doc_rows
    extra = spark.createDataFrame([(901, "a <|endoftext|> b<|startoftext|>", "en", "z", 0), (902, "Don't STOP é ́x it's ΑΣ Σ", "en", "z", 0)], docs.schema)
    rows = QUERIES["op1_packing"](spark, folder(documents=docs.union(extra))).collect()
    texts = [(r[0], r[1]) for r in doc_rows()] + [(901, "a <|endoftext|> b<|startoftext|>"), (902, "Don't STOP é ́x it's ΑΣ Σ")]
    check(rows, texts, tokenizer)
    assert P.pack(P.cut_pieces(no_docs, public_vocabulary())).count() == 0
    packed = P.pack(P.cut_pieces(clashing, public_vocabulary())).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in packed)


def test_given_table_has_little_padding(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check(QUERIES["op1_packing"](spark, sf).collect(), texts, tokenizer) < 0.02


def test_word_ids_equal_whole_text_ids(tokenizer):
    from hypothesis import given, settings, strategies as st
    words = WordIds(public_vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=80), st.lists(st.text(alphabet="aBcÉßñſʼŉİ.,;:!?'é́", max_size=7), max_size=12).map(" ".join), st.text(alphabet="aAbÉé́ \n\t\x0b'stΣς  中12.,<|>", max_size=60)))
    def run(text):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    run()


def test_nnls_matches_exhaustive_search():
    rng = np.random.default_rng(3)
    from itertools import combinations
    for _ in range(20):
        a, b = rng.integers(0, 4, (4, 6)).astype(float), rng.integers(0, 9, 4).astype(float)
        best = np.inf
        for k in range(7):
            for at in combinations(range(6), k):
                x = np.zeros(6)
                if at:
                    x[list(at)] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
                if x.min() >= -1e-9:
                    best = min(best, float(np.sum((a @ x - b) ** 2)))
        x = P.nnls(a, b)
        assert x.min() >= 0 and np.sum((a @ x - b) ** 2) <= best + 1e-4


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = np.random.default_rng(5)
    for top in (3, 40, 256):
        h = Counter(rng.integers(1, top + 1, 3000).tolist())
        plan = P.plan_windows(dict(h), 256)
        got = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= 256
            for k in lengths:
                got[k] += n
        assert got == h
        assert sum(k * n for k, n in h.items()) / 256 / sum(n for _, n in plan) > 0.98
    assert P.plan_windows({}, 256) == []


@pytest.mark.parametrize("lengths", [
    {k: 5000 for k in range(1, 21)}, {1: 100_000}, {1: 1}, {127: 3, 128: 3, 4096: 2}, {1: 40_000, 60: 700, 130: 90, 900: 300, 4096: 7}, {200: 4000}, {}])
def test_seats_of_short_pieces(lengths):
    """Every piece has its own seat, no window is overfull, and short pieces are not rounded up one by one."""
    bins, histogram = {}, Counter()
    for k, n in lengths.items():
        bins[k] = -k if k < P.BUNDLE // 2 else -(-k // P.GRAIN)
        histogram[bins[k]] += n
    seat = P.plan_seats(dict(histogram))
    taken, used, seen = set(), Counter(), Counter()
    for k, n in lengths.items():
        window, slot = seat(np.full(n, bins[k], np.int64), np.arange(seen[bins[k]], seen[bins[k]] + n, dtype=np.int64))
        seen[bins[k]] += n
        taken |= set(zip(window.tolist(), slot.tolist()))
        for w in window.tolist():
            used[w] += k
    assert len(taken) == sum(lengths.values()) and max(used.values(), default=0) <= 4096
    assert sorted(used) == list(range(len(used)))
    least = -(-sum(k * n for k, n in lengths.items()) // 4096)
    assert len(used) <= 1.03 * least + 1


def test_table_of_short_texts_has_little_padding(spark, tmp_path, tokenizer):
    words = ["alpha", "beta", "gamma", "delta", "", None]
    texts = [(i, " ".join((words[i % 4],) * (i % 9)) if i % 11 else words[4 + i % 2]) for i in range(20_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = P.pack(P.cut_pieces(df, public_vocabulary(), with_ids=False)).collect()
    assert check(rows, texts, tokenizer) < 0.03
