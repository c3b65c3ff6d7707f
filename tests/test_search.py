import pytest
from pyspark.sql import functions as F

from quarry.functions import querylog as Q
from quarry.operators import grouping as G, scoring as S
from quarry.plans import search as P

NOW = "2026-01-01 01:00:00"


def analyzed(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "query_id long, raw string")
    return [r.asDict(True) for r in Q.analyze(Q.parse_operators(df)).orderBy("query_id").collect()]


def test_operators_from_the_prefix_block(spark):
    a, b, c, d = analyzed(spark, 'lang:TypeScript path:"src/**" must:ERR_CODE_42 exclude:legacy\n\nauth failure',
                          r'\lang:x -path:"a \"b\"" must: plain', "lang:go", "x " * 110 + "must:late")
    assert (a["lang"], a["path"], a["must"], a["exclude"], a["semantic"]) == (["typescript"], ["src/**"], ["ERR_CODE_42"], ["legacy"], "auth failure")
    assert (b["not_path"], b["must"], b["semantic"]) == (['a "b"'], [], "lang:x plain")
    assert (c["lang"], c["semantic"]) == (["go"], "lang:go")
    assert d["must"] == [] and d["semantic"].endswith("must:late")


@pytest.mark.parametrize("raw,intent,confidence,ref", [
    ("hurst", "uncertain", "medium", False), ("HurstGateState", "identifier", "high", False), ("where is HurstGateState used", "mixed", "medium", True),
    ("how does login work", "semantic", "high", False), ("the", "uncertain", "low", False), ("find parseA and parseB quickly", "mixed", "high", False)])
def test_intent(spark, raw, intent, confidence, ref):
    (r,) = analyzed(spark, raw)
    assert (r["intent"], r["confidence"], r["reference_seeking"]) == (intent, confidence, ref)


def test_terms(spark):
    (r,) = analyzed(spark, "parseHTTPQuery check_hurst")
    assert [(t["value"], t["kind"]) for t in r["terms"]] == [
        ("parsehttpquery", "whole"), ("parse", "fragment"), ("httpquery", "fragment"), ("check_hurst", "whole"), ("check", "fragment"), ("hurst", "fragment")]


CHUNK = "chunk_id string, path string, start_line int, end_line int, language string, content string, symbol_id string, symbol_label string, indexed_at string"


def scored(spark, raw, chunks, scope="mixed", limit=10, fusion=None):
    q = P.prepare(spark.createDataFrame([(1, raw, scope, "symbol", limit)], "query_id long, raw string, scope string, group_by string, result_limit int"))
    c = spark.createDataFrame(chunks, CHUNK)
    f = F.create_map(*[F.lit(x) for kv in (fusion or {k[0]: 0.02 for k in chunks}).items() for x in kv])
    j = c.join(q, F.lit(True)).withColumn("fusion", F.element_at(f, F.col("chunk_id"))).withColumn("changed_mult", F.lit(1.0))
    j = S.with_category(j).withColumn("reason", S.drop_reason())
    return j, S.rank_candidates(S.score_candidates(j.where("reason IS NULL")))


def row(cid, path, content="x", label=None, sid=None, start=1, end=5, at=None):
    return (cid, path, start, end, "typescript", content, sid, label, at)


def test_operator_filters_keep_one(spark):
    raw = 'lang:typescript path:"src/**" must:ERR_CODE_42 exclude:legacy\n\nauth failure'
    chunks = [row("a", "src/auth.ts", "throw ERR_CODE_42"), row("b", "src/old.ts", "legacy ERR_CODE_42"), row("c", "lib/auth.ts", "ERR_CODE_42")]
    j, r = scored(spark, raw, chunks)
    assert [x.path for x in r.collect()] == ["src/auth.ts"]
    assert {x.chunk_id: x.reason for x in j.collect()} == {"a": None, "b": "exclude", "c": "path"}


def test_scopes(spark):
    paths = ["src/auth/runtime.ts", "src/session/runtime.ts", "docs/auth.md", "src/auth/auth.test.ts", "src/__fixtures__/auth-fixture.ts"]
    chunks = [row(p, p) for p in paths]
    assert {x.path for x in scored(spark, "auth", chunks, "runtime")[1].collect()} == {paths[0], paths[1], paths[4]}
    assert {x.path for x in scored(spark, "auth", chunks, "docs")[1].collect()} == {paths[2], paths[3]}


def test_exact_term_is_pinned(spark):
    chunks = [row("a", "src/regime_gate.ts", label="function checkRegimeGate()"), row("b", "src/hurst_gate.ts", label="function check_hurst_gate()")]
    r = scored(spark, "hurst", chunks, "runtime", fusion={"a": 0.021, "b": 0.019})[1].orderBy("rank").collect()
    assert r[0].path == "src/hurst_gate.ts" and r[0].exact


def test_reference_seeking_puts_usage_before_declaration(spark):
    chunks = [row("a", "src/types.ts", "type HurstGateState = { a: 1 }", "type HurstGateState"),
              row("b", "src/use.ts", "const s = new HurstGateState(config);", "function run()")]
    r = scored(spark, "where is HurstGateState used", chunks, "runtime")[1].orderBy("rank").collect()
    assert [x.chunk_id for x in r] == ["b", "a"] and not r[0].pin and not r[0].exact


def test_usage_and_declarations(spark):
    rows = [("new foo(x)", "foo"), ("a = foo (1)", "foo"), ("foo = 2", "foo"), ("import {a, foo} from 'x'", "foo"), ("xfoo(1)", "foo"),
            ("const foo = async (a) => 1", "foo"), ("class foo {", "foo"), ("renew foo", "foo")]
    got = [(r[0], r[1]) for r in spark.createDataFrame(rows, "c string, t string").select(S.usage_kind(F.col("c"), F.col("t")), S.declares(F.col("c"), F.col("t"))).collect()]
    assert got == [("executable", False), ("executable", False), ("executable", False), ("import", False), (None, False),
                   ("executable", True), (None, True), (None, False)]


def test_grouped_hit_supports_the_graph(spark):
    chunks = [row("a", "src/auth.ts", label="function validate()", sid="sym_auth_validate", start=3, end=6, at="2026-01-01T00:30:00Z")]
    ranked = scored(spark, "validate", chunks, "runtime")[1]
    (g,) = G.nav_hint(G.group_hits(ranked, F.lit(NOW).cast("timestamp"))).collect()
    assert (g.group_id, g.start_line, g.end_line, g.staleness, g.graph_supported) == ("sym_auth_validate", 3, 6, "fresh", True)


def sequential_diversity(files, limit):
    picked, counts, skipped = [], {}, 0

    def run(cap):
        nonlocal skipped
        for i, f in enumerate(files):
            if len(picked) >= limit:
                return
            if i in picked:
                continue
            if counts.get(f, 0) >= cap:
                skipped += 1
                continue
            picked.append(i)
            counts[f] = counts.get(f, 0) + 1

    run(2)
    relaxed = len(picked) < min(limit, len(files))
    if relaxed:
        run(3)
    return picked, skipped, relaxed


def test_diversity_equals_the_sequential_rule(spark):
    import random
    rnd = random.Random(3)
    cases, rows = {}, []
    for q in range(150):
        files = [rnd.choice("abcd") for _ in range(rnd.randint(1, 14))]
        limit = rnd.randint(1, 10)
        cases[q] = (files, limit)
        rows += [(q, i + 1, f, limit) for i, f in enumerate(files)]
    df = spark.createDataFrame(rows, "query_id int, rank int, path string, result_limit int")
    got = {}
    for r in G.diversify(df).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r["rank"] - 1, r.skipped_by_file, r.relaxed))
    for q, (files, limit) in cases.items():
        picked, skipped, relaxed = sequential_diversity(files, limit)
        assert [x[0] for x in got[q]] == picked, (files, limit)
        assert all(x[1:] == (skipped, relaxed) for x in got[q]), (files, limit)


def test_rerank_and_changed_files(spark):
    chunks = [row("a", "src/a.ts"), row("b", "src/b.ts"), row("c", "src/c.ts")]
    ranked = scored(spark, "how does login work", chunks, "runtime", fusion={"a": 0.03, "b": 0.02, "c": 0.01})[1]
    ranks = spark.createDataFrame([(1, 2, 1), (1, 2, 3), (1, 99, 2)], "query_id long, idx int, new_rank int")
    assert [r.chunk_id for r in S.rerank(ranked, ranks).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.chunk_id for r in S.rerank(ranked, ranks.limit(0)).orderBy("rank").collect()] == ["a", "b", "c"]
    by_length = S.model_scorer(lambda: lambda q, d: [float(x.count("c.ts")) for x in d])
    got = S.ranks_from_scores(ranked, by_length).orderBy("new_rank").collect()
    assert [(r.idx, r.new_rank) for r in got] == [(2, 1), (0, 2), (1, 3)]
    c = spark.createDataFrame([("p1",), ("p2",)], "path string")
    few, many = spark.createDataFrame([("p1",)], "path string"), spark.range(51).select(F.concat(F.lit("p"), "id").alias("path"))
    assert {r.path: r.changed_mult for r in S.changed_multiplier(c, few).collect()} == {"p1": 1.1, "p2": 1.0}
    assert {r.changed_mult for r in S.changed_multiplier(c, many).collect()} == {1.0}


def test_pass_status(spark):
    p = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    lists = spark.createDataFrame([(1, "primary"), (1, "expanded"), (2, "expanded")], "query_id long, pass string")
    got = {r.query_id: (r.status, r.missing_pass) for r in P.pass_status(p, lists).collect()}
    assert got == {1: ("ok", None), 2: ("degraded", "primary"), 3: ("error", None)}


def test_whole_search_with_a_reranker(spark):
    from quarry.functions.embedders import letter_vector
    chunks = spark.createDataFrame([row(f"c{i}", f"src/f{i % 4}.ts", f"login session number {i} " * 3, f"function f{i}()", f"s{i}", start=i * 30 + 1, end=i * 30 + 9) for i in range(12)], CHUNK)
    q = spark.createDataFrame([(1, "how does login session work", "mixed", "symbol", 6), (2, "f3 must:nothing", "mixed", "file", 3)],
                              "query_id long, raw string, scope string, group_by string, result_limit int")
    now = F.lit(NOW).cast("timestamp")
    best = S.model_scorer(lambda: lambda q, d: [1.0 if "number 7 " in x else 0.0 for x in d])
    got = P.search_batch(q, chunks, letter_vector, now, scorer=best).orderBy("place").collect()
    assert {r.query_id for r in got} == {1} and got[0].group_id == "s7" and len(got) == 6
    assert max(sum(r.path == p for r in got) for p in {r.path for r in got}) <= 2
