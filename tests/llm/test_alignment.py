import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quarry.llm import alignment as A
from quarry.llm import queries
from tests.llm.conftest import doc_rows

PATHS = A.public_tokenizers_paths()


@pytest.fixture(scope="module")
def tool():
    return A.Aligner(*PATHS)


@pytest.fixture(scope="module")
def json_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def plain(tool, tokenizer, text):
    """Groups as lists of (ids of A, ids of B), by walking both tokenizations of the whole text; None without tokens."""
    if not text:
        return None
    a, b, full = tokenizer.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text), (" " + text).encode()
    if b"".join(tool.a_bytes[i] for i in a) != full or b"".join(tool.b_bytes[i] for i in b) != full:
        return None
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((tool.a_bytes, a), (tool.b_bytes, b))]
    out, x, y = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i, j = ends[0].index(end, x) + 1, ends[1].index(end, y) + 1
        out.append((a[x:i], b[y:j]))
        x, y = i, j
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "\r", ";\r", " ", "　", "\x1c", "\x00", "́", "é", "中", "▁", "'s", "12", ",", "...", "<s>", "<|endoftext|>", "<0x41>", "ﬁ", "Ａ", "🙂", "ing"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=20), max_size=4))
def test_units_give_what_whole_texts_give(tool, json_tokenizer, texts):
    for text, found in zip(texts, tool.align(texts), strict=True):
        want = plain(tool, json_tokenizer, text)
        assert (found is None) == (want is None), text
        if want is not None:
            groups, slots, n_a = found
            assert groups.decode() == written(want) and n_a == sum(len(a) for a, _ in want)
            pairs = tool.pairs[slots]
            assert Counter(pairs.tolist()) == Counter(a[-1] * len(tool.b_bytes) + b[-1] for a, b in want)


def brute(tool, tokenizer, rows):
    aligned = [plain(tool, tokenizer, t) or [] for _, t in rows]
    n = Counter((a[-1], b[-1]) for g in aligned for a, b in g)
    best = Counter()
    for (_, b), k in n.items():
        best[b] = max(best[b], k)
    out = []
    for (i, _), g in zip(rows, aligned, strict=True):
        links = [(a[-1], b[-1]) for a, b in g]
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links),
                    hashlib.sha256(written(g).encode()).hexdigest() if g else ""))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("parts", [1, 6])
def test_edge_rows(spark, tool, json_tokenizer, docs, clashing, folder, parts):
    rows = [(r[0], r[1]) for r in doc_rows()] + [(500, "joined▁by the mark"), (501, "x" * 5000), (502, "  a"), (503, " "), (504, "<|endoftext|> and <s>")]
    more = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "2 AS slots", "'x' AS groups", "3 AS n", "4 AS slot").repartition(parts)
    found = queries.op11_token_alignment(spark, folder(documents=more)).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(tool, json_tokenizer, rows), key=key)


def test_groups_and_empty_tables(spark, tool, json_tokenizer, no_docs):
    assert A.scored(no_docs, *PATHS).collect() == []
    df = spark.createDataFrame([("k", "Hello there, naïve 中文 world"), ("n", None)], "name string, body string")
    got = {r["doc_id"]: r for r in A.scored(df, *PATHS, "name", "body", keep_groups=True).collect()}
    assert got["k"]["groups"] == written(plain(tool, json_tokenizer, "Hello there, naïve 中文 world")) and got["n"]["groups"] == "" and got["n"]["groups_sha256"] == ""


def test_forgotten_units(tool, monkeypatch):
    texts = [" ".join(f"word{i * j}" for i in range(30)) for j in range(20)]
    want = [f[0] for f in tool.align(texts)]
    monkeypatch.setattr(A, "KNOWN_UNITS", 10)
    assert [tool.align([t])[0][0] for t in texts] == want


def test_coalesce_and_overlaps_with_gaps():
    a, b = (np.array([0, 3, 8]), np.array([3, 6, 9])), (np.array([0, 2, 6]), np.array([2, 5, 8]))
    assert A.coalesce(np.append(a[0], b[0]), np.append(a[1], b[1])).tolist() == [0, 0, 2, 0, 0, 1]
    left, right = A.overlaps(a, b)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1)]


@given(st.lists(st.integers(0, 2**33), max_size=50))
def test_packed_numbers(values):
    values = np.array(sorted(values), np.int64)
    assert A._undelta(A._delta(values)).tolist() == values.tolist()


@given(st.lists(st.integers(0, 400_000), max_size=80))
def test_packed_slots(slots):
    met, n = A._read_counted(A._counted(np.array(slots, "<i4")))
    assert dict(zip(met.tolist(), n.tolist(), strict=True)) == Counter(slots)
