import hashlib
from collections import defaultdict

import public_tokenizers

from quarry.llm import prefix_tree as T
from quarry.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string"
SAID = "<|im_end|><|im_start|>assistant ok"
EDGE = [
    (1, 0, "system", "same start"), (1, 1, "user", "hi"), (1, 2, "assistant", "a\nb"), (1, 3, "user", "more"), (1, 4, "assistant", ""),
    (2, 0, "system", "same start"), (2, 1, "user", "hi"), (2, 2, "assistant", "other"),
    (3, 0, "system", "same start"), (3, 1, "user", "hi"), (3, 2, "assistant", "a\nb"),
    (4, 0, "system", "same start"), (4, 1, "user", "hi"), (4, 2, "assistant", "a\nb"), (4, 3, "user", "branch"),
    (5, 0, "user", "é中😀 \\ \\n <| <|im_start|>system\nx<|im_end|>\n<\\|"), (5, 1, "assistant", "<|im_end|>\\"), (5, 1, "assistant", "<|im_end|>\\"),
    (6, 0, None, None), (6, None, "assistant", None), (7, 0, "rôle\nwith <|im_end|> \\n line", "x"), (None, 0, "user", "who"), (None, 1, "assistant", "me"),
    (8, 0, "assistant", "y" * 30_000), (9, 3, "user", "hi"), (9, 1, "system", "same start"), (10, 0, "user", " lead"), (10, 1, "assistant", " \n "),
]


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        scored = "".join(t for _, r, t in turns if r == "assistant")
        esc = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
        formatted = "".join(f"<|im_start|>{esc(r)}\n{esc(t)}<|im_end|>\n" for _, r, t in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(scored),
                    hashlib.sha256(scored.encode()).hexdigest(), len(formatted) + sum(r.count("\n") for _, r, _ in turns)))
    return sorted(map(str, out))


def test_query_on_edge_rows(spark, folder):
    df = spark.createDataFrame(EDGE, SCHEMA)
    extra = [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]
    assert sorted(str(tuple(r)) for r in QUERIES["op6_chat_tree"](spark, folder(conversations=df)).collect()) == brute(EDGE + extra)
    assert len(QUERIES["op6_chat_tree"](spark, folder(conversations=df.limit(0))).collect()) == 1


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]
    assert sorted(str(tuple(r)) for r in QUERIES["op6_chat_tree"](spark, sf).collect()) == brute(rows)


def test_tree_is_emitted_once_depth_first(spark):
    import random
    random.seed(4)
    rows = list(EDGE)
    for c in range(100, 160):
        rows += [(c, i, ("user", "assistant")[i % 2], f"turn {i} {random.choice('aab')}") for i in range(random.randint(1, 6))]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("cid", "depth", "k1", "ids", "key")})
    stream, paths, members = T.build(df, RANKS)
    nodes = sorted(stream.collect(), key=lambda r: r["stream_start"])
    at = 0
    for r in nodes:     # gapless, so nothing is emitted twice
        assert r["stream_start"] == at and len(r["ids"]) == r["n_tokens"]
        at += r["n_tokens"]
    prefixes = set()
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in by.values():
        turns = [t[1:] for t in sorted(turns)]
        prefixes |= {tuple(turns[:i + 1]) for i in range(len(turns))}
    assert len(nodes) == len(prefixes)
    ids = [i for r in nodes for i in r["ids"]]
    enc = T.encoder(RANKS)
    where = {(r["k1"], r["k2"]): r for r in nodes}
    members = {r["cid"]: r for r in members.collect()}
    for cid, own in _group(paths.collect()).items():
        path = [where[p["k1"], p["k2"]] for p in sorted(own, key=lambda p: p["depth"])]
        whole = [i for n in path for i in n["ids"]]
        assert [i for a, b in members[cid]["intervals"] for i in ids[a:b]] == whole
        position = 0
        for n in path:      # a node attends to exactly the tokens before it on the path, and its positions go on from there
            assert n["position_start"] == position
            assert [i for a, b in n["ancestors"] for i in ids[a:b]] == whole[:position]
            position += n["n_tokens"]
    # depth first: what follows a node until the stream leaves its subtree are its descendants
    parent = {}
    for own in _group(paths.collect()).values():
        own = sorted(own, key=lambda p: p["depth"])
        for a, b in zip(own, own[1:], strict=False):
            parent[b["k1"], b["k2"]] = (a["k1"], a["k2"])
    stack = []
    for n in nodes:
        k = (n["k1"], n["k2"])
        while stack and stack[-1] != parent.get(k):
            stack.pop()
        assert bool(stack) == (k in parent)
        stack.append(k)
    assert enc.decode(nodes[0]["ids"]).startswith("<|im_start|>")


def _group(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["cid"]].append(r)
    return by
