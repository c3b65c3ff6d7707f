import re

import pytest

from quarry.llm import mixing as M
from quarry.llm.queries import QUERIES


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = max(0, total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def check(rows, docs):
    """docs: (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in rows) == sorted((str(d), size(t), str(s)) for d, t, s in docs)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in own)
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in own)
        yield s, sum(r["taken"] for r in own), want[s], own


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = QUERIES["op3_mixing"](spark, sf).collect()
    for _, taken, want, _ in check(rows, docs):
        assert abs(taken - want) <= max(0.01 * want, 30)
    again = QUERIES["op3_mixing"](spark, sf).repartition(5).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_edge_rows(spark, docs, folder, no_docs, clashing):
    from tests.llm.conftest import doc_rows
    rows = QUERIES["op3_mixing"](spark, folder(documents=docs)).collect()
    for _, taken, want, own in check(rows, [(r[0], r[1], r[3]) for r in doc_rows()]):
        assert abs(taken - want) <= max(r["size"] for r in own)
    empty = no_docs.selectExpr("doc_id", "source", "0L AS size")
    planned = M.plan(empty)
    assert planned.count() == 0 and M.occurrences(planned).count() == 0
    sized = clashing.drop("size").selectExpr("*", "length(text) AS size")
    assert M.plan(sized, carry=["target_x"] if "target_x" in sized.columns else []).count() == len(doc_rows())


def test_positions_follow_the_schedules(spark):
    """At any time the words delivered so far follow the integrals of the schedules."""
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' ELSE 'c' END AS source", "10 + id % 7 AS size")
    planned = M.plan(df)
    occ = M.occurrences(planned)
    parts = occ.rdd.glom().map(lambda p: [r["position"] for r in p]).filter(bool).collect()
    assert all(p == sorted(p) for p in parts) and all(a[-1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))
    rows = occ.join(planned.select("row_id", "source", "weight", "target"), "row_id").collect()
    for s, w in (("a", 5.0), ("b", 2.0), ("c", 1.0)):
        own = [r for r in rows if r["source"] == s]
        knots = M.SCHEDULES[w]
        for t in (0.2, 0.5, 0.8):
            demand = 0.0
            for t0, length, w0, slope, done in M.segments(knots):
                x = min(max(t - t0, 0), length)
                demand += w0 * x + slope * x * x / 2
            got = sum(r["size"] for r in own if r["position"] <= t) / own[0]["target"]
            assert got == pytest.approx(demand, abs=0.01)


def test_sharing_stops_at_three_times_a_source(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "c", 10), (4, "d", 1000), (5, None, 0)], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    assert got == pytest.approx(targets({"a": 10, "b": 10, "c": 10, "d": 1000, None: 0}))
    assert got["a"] == 30 and got["d"] == pytest.approx(940)
