import random

from pyspark.sql import functions as F

from quarry.operators import graph as G

EDGE = "corpus string, src string, dst string, kind string, file string, line int, confidence double"
NODE = "corpus string, symbol_id string, symbol_label string, file string, language string, start_line int, end_line int"


def walk_sequential(edges, seed, direction, depth, limit):
    order = sorted(edges)
    visited, selected, frontier = [seed], [], [seed]
    for _ in range(depth):
        nxt = []
        for s in frontier:
            todo = ([e for e in order if e[0] == s] if direction != "callers" else []) + ([e for e in order if e[1] == s] if direction != "callees" else [])
            for e in todo:
                if e not in selected:
                    if len(selected) >= limit:
                        break
                    selected.append(e)
                peer = e[1] if e[0] == s else e[0]
                if peer not in visited:
                    visited.append(peer)
                    nxt.append(peer)
            if len(selected) >= limit:
                break
        frontier = nxt
        if not frontier or len(selected) >= limit:
            break
    return selected, set(visited)


def test_traversal_equals_a_sequential_walk_with_hubs(spark):
    rnd = random.Random(5)
    names = [f"s{i:02d}" for i in range(14)]
    edges = {(rnd.choice(names + ["s00"] * 8), rnd.choice(names + ["s01"] * 8), rnd.choice(["call", "dynamic", "import"]), rnd.randint(1, 9), "f") for _ in range(160)}
    e = spark.createDataFrame([("c", s, d, k, f, ln, 0.9) for s, d, k, ln, f in edges], EDGE)
    cases = [(f"{n}-{d}-{dep}-{lim}", "c", n, d, dep, lim) for n in names for d in ("callers", "callees", "both") for dep, lim in ((1, 4), (2, 9), (3, 20), (3, 2))]
    seeds = spark.createDataFrame(cases, "seed_id string, corpus string, symbol_id string, direction string, depth int, edge_limit int")
    got = {r.seed_id: r for r in G.traverse(seeds, e).collect()}
    for sid, _, n, d, dep, lim in cases:
        sel, vis = walk_sequential(edges, n, d, dep, lim)
        assert [tuple(x) for x in got[sid].selected] == sel, sid
        assert set(got[sid].visited) == vis, sid


def test_a_walk_is_spread_over_tasks_and_fetches_only_lists_that_can_matter(spark):
    # rows of the same edge, edges to itself, pairs linked both ways, and frontiers whose lists hold far more than the limit
    edges = {("hub", f"a{i:02d}", "call", i % 3, "f") for i in range(20)} | {(f"a{i:02d}", "hub", "call", 1, "f") for i in range(0, 20, 2)}
    edges |= {(f"a{i:02d}", f"b{j}", "call", j, "g") for i in range(20) for j in range(9)} | {("hub", "hub", "call", 7, "f"), ("a03", "a03", "call", 2, "f")}
    edge_table = spark.createDataFrame([("c", s, d, k, f, ln, c) for s, d, k, ln, f in sorted(edges) for c in (0.9, 0.7)], EDGE)
    cases = [(f"{n}-{d}-{lim}", "c", n, d, 3, lim) for n in ("hub", "a03", "b4", "alone") for d in ("callers", "callees", "both") for lim in (1, 7, 22, 45)]
    seeds = spark.createDataFrame(cases, "seed_id string, corpus string, symbol_id string, direction string, depth int, edge_limit int")
    walk = G.traverse(seeds, edge_table)
    got = {r.seed_id: r for r in walk.collect()}
    assert len(got) == len(cases)
    for sid, _, n, d, dep, lim in cases:
        sel, vis = walk_sequential(edges, n, d, dep, lim)
        assert [tuple(x) for x in got[sid].selected] == sel, sid
        assert set(got[sid].visited) == vis, sid
    assert "REPARTITION_BY_NUM" in walk._jdf.queryExecution().toString()


def test_resolution_equals_brute_force_for_a_hot_name(spark):
    rnd = random.Random(9)
    nodes = [("c", f"n{i:03d}", f"function {rnd.choice(['get', 'get', 'put', 'run'])}()", f"f{rnd.randint(0, 9)}.ts", "typescript", rnd.randint(1, 40), 99) for i in range(80)]
    sites = [("c", f"n{rnd.randint(0, 79):03d}", f"f{rnd.randint(0, 14)}.ts", rnd.randint(1, 50), rnd.choice(["get", "get", "put", "nope"]), "call") for _ in range(300)]
    nd = spark.createDataFrame(nodes, NODE)
    st = spark.createDataFrame(list(dict.fromkeys(sites)), "corpus string, src string, file string, line int, name string, kind string")
    got = {(r.src, r.file, r.line, r.name): r.dst for r in G.resolve(st, nd).collect()}
    assert len(got) == len(set(sites))
    for c, src, file, line, name, kind in set(sites):
        cand = [n for n in nodes if n[2] == f"function {name}()"]
        pool = [n for n in cand if n[3] == file] or cand
        best = min(pool, key=lambda n: (abs(n[5] - line), n[3], n[5], n[2], n[1]), default=None)
        assert got[(src, file, line, name)] == (best[1] if best else None)


def test_build_graph_from_source(spark):
    code = ["class RuntimeGraph:", "    def gamma(self):", "        self.beta()", "def beta():", "    return getattr(x, 'y')", "def alpha():",
            "    beta(); other.gamma()  # call delta()", "    if (x): missing(1)", "from m import Beta as b, alpha"]
    files = spark.createDataFrame([("c", "g.py", "\n".join(code))], "corpus string, path string, content string")
    rows = [("c", "g.py", 1, 3, "class RuntimeGraph", "s_class"), ("c", "g.py", 2, 3, "function gamma(self)", "s_gamma"), ("c", "g.py", 4, 5, "function beta()", "s_beta"),
            ("c", "g.py", 6, 9, "function alpha()", "s_alpha"), ("c", "g.py", 9, 9, None, None)]
    chunks = spark.createDataFrame([(*r, "python", f"k{i}") for i, r in enumerate(rows)],
                                   "corpus string, path string, start_line int, end_line int, symbol_label string, symbol_id string, language string, chunk_id string")
    nodes, edges, notes = G.build_graph(chunks, files)
    assert nodes.count() == 4
    got = {(r.src, r.dst, r.kind, r.line, r.confidence) for r in edges.collect()}
    assert got == {("s_gamma", "s_beta", "call", 3, 0.92), ("s_gamma", "s_beta", "dynamic", 3, 0.72), ("s_class", "s_beta", "call", 3, 0.92), ("s_class", "s_beta", "dynamic", 3, 0.72),
                   ("s_alpha", "s_beta", "call", 7, 0.92), ("s_alpha", "s_gamma", "call", 7, 0.92), ("s_alpha", "s_gamma", "dynamic", 7, 0.72),
                   ("s_alpha", "s_beta", "import", 9, 0.65), ("s_alpha", "s_alpha", "import", 9, 0.65)}
    kinds = {(r.type, r.line, r.symbol_id) for r in notes.collect()}
    assert ("missing_symbol_metadata", 9, None) in kinds and ("unresolved_edge", 8, "s_alpha") in kinds and ("dynamic_edge", 5, "s_beta") in kinds
    assert not any(r.detail.startswith("could not resolve delta") for r in notes.collect())


def test_outline_and_exact(spark):
    nodes = spark.createDataFrame([("c", "sym_b", "function zebra()", "src/runtime.ts", "typescript", 10, 15), ("c", "sym_a", "function alpha()", "src/runtime.ts", "typescript", 10, 15),
                                   ("c", "sym_c", None, "src/runtime.ts", "typescript", 20, 21)], NODE)
    notes = spark.createDataFrame([("c", "missing_symbol_metadata", "src/runtime.ts")], "corpus string, type string, file string")
    req = spark.createDataFrame([("all", "c", "src/runtime.ts", None, None), ("w", "c", "src/runtime.ts", 16, 30)], "request_id string, corpus string, file string, window_start int, window_end int")
    got = G.outline(req, nodes, notes, 2).orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.label, r.has_more, r.missing) for r in got] == [
        ("all", "function alpha()", True, 1), ("all", "function zebra()", True, 1), ("w", "sym_c", False, 1)]
    ask = spark.createDataFrame([("1", "c", "src/runtime.ts", "sym_a", None), ("2", "c", "src/runtime.ts", None, "nope"), ("3", "c", "src/runtime.ts", None, None), ("4", "c", "x", "sym_a", None)],
                                "request_id string, corpus string, file string, want_id string, want_label string")
    assert {r.request_id: (r.status, r.matches) for r in G.symbol_exact(ask, nodes).collect()} == {"1": ("ok", 1), "2": ("not_found", 0), "3": ("ambiguous", 3), "4": ("not_found", 0)}
    files = spark.createDataFrame([("c", "src/runtime.ts", "\n".join(f"l{i}" for i in range(1, 31)) + "\n")], "corpus string, path string, content string")
    (r,) = G.read_symbols(ask, nodes, files).collect()
    assert (r.request_id, r.first_line, r.last_line, r.text.split("\n")[0]) == ("1", 10, 15, "l10")
    (s,) = G.read_spans(spark.createDataFrame([("x", "c", "src/runtime.ts", 3, None)], "request_id string, corpus string, path string, start int, end int"), files, 5).collect()
    assert (s.first_line, s.last_line, s.next_start, s.total) == (3, 7, 8, 30)


def test_defined_names_are_those_of_the_patterns(spark):
    """Against the patterns with each name put in, over random lines."""
    rng = random.Random(3)
    parts = ["function ", "class\t", "def  ", "Function", "foo", "a$b", "$", "b", "_x9", "(", ")", "()", " => ", "{", " ", ".", "1", "foo(bar(1) {"]
    lines = [(i, "".join(rng.choices(parts, k=rng.randint(1, 12)))) for i in range(1500)]
    t, n = F.col("text"), F.col("name")
    df = spark.createDataFrame(lines, "line int, text string").withColumn("name", F.explode(F.expr("array('foo', 'a', 'b', 'a$b', '$', 'bar', '_x9', 'x9', 'function')")))
    e = F.regexp_replace(n, r"\$", r"\\\$")
    named = F.rlike(t, F.concat(F.lit(r"(?i)(?:^|[^A-Za-z0-9_])(?:function|class|def)\s+"), e, F.lit("(?:[^A-Za-z0-9_]|$)")))
    body = F.rlike(t, F.concat(F.lit("(?i)(?:^|[^A-Za-z0-9_])"), e, F.lit(r"\s*\([^)]*\)\s*(?:=>|\{)")))
    direct = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    plain = (rf"{G.WORD_EDGE}({G.NAME})\s*\(", rf"{G.NAME}\.({G.NAME})\s*\(")
    got = df.select("text", "name", (named | body).alias("want"), G.is_defined(n, *G.defined_names(t)).alias("got"),
                    (direct(plain[0]) == direct(G.DIRECT_CALL)).alias("d"), (direct(plain[1]) == direct(G.MEMBER_CALL)).alias("m")).collect()
    assert not [r for r in got if r.want != r.got or not r.d or not r.m] and 100 < sum(r.want for r in got) < len(got) - 100


def test_only_lines_that_ask_for_a_node_meet_the_candidates(spark):
    """Names without a node keep no target, and those with one take the nearest, in their file first."""
    nodes = spark.createDataFrame([("c", "s1", "function run()", "a.ts", "typescript", 1, 3), ("c", "s2", "function run()", "b.ts", "typescript", 9, 12)],
                                  "corpus string, symbol_id string, symbol_label string, file string, language string, start_line int, end_line int")
    sites = spark.createDataFrame([("c", "x", "a.ts", 20, "run", "call"), ("c", "x", "d.ts", 8, "run", "call"), ("c", "x", "d.ts", 8, "none", "call"), ("e", "x", "a.ts", 1, "run", "call")],
                                  "corpus string, src string, file string, line int, name string, kind string")
    got = {(r.corpus, r.file, r.name): (r.dst, r.dst_file) for r in G.resolve(sites, nodes).collect()}
    assert got == {("c", "a.ts", "run"): ("s1", "a.ts"), ("c", "d.ts", "run"): ("s2", "b.ts"), ("c", "d.ts", "none"): (None, None), ("e", "a.ts", "run"): (None, None)}


def test_stored_graph_reads_no_text_for_its_chunks(spark, monkeypatch):
    from entries import graph as entry

    read = []
    for name in ("build", "sync"):
        plain = getattr(entry.graph_index, name)
        monkeypatch.setattr(entry.graph_index, name, lambda chunks, *rest, plain=plain: (read.extend(chunks.inputFiles()), plain(chunks, *rest))[1])
    assert entry.stored(spark, "/root/testdata/sf0.001")[0].count() > 0
    assert read and not [f for f in read if "documents" in f]
