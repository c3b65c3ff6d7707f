import datetime as dt
import random

from pyspark.sql import functions as F

from quarry.operators import state as S
from quarry.session import shared_dir
from quarry.streaming import ingest, watch
from tests.test_incremental import split

NOW = F.lit
FP = {"provider": "p", "model": "m", "dimension": 4, "store": "s", "schema_version": "hybrid_v3"}
COMMIT = "corpus string, kind string, fingerprint struct<provider:string,model:string,dimension:int,store:string,schema_version:string>, indexed_files long, total_chunks long, completed_at string, run_id string"
STATE = "corpus string, status string, pct double, reason string, indexed_files long, total_chunks long, last_updated string"


def commits(spark):
    good, other = ("p", "m", 4, "s", "hybrid_v3"), ("p", "m2", 4, "s", "hybrid_v3")
    t = "2026-01-01T00:00:00Z"
    return spark.createDataFrame([("ok", "index_completion_v1", good, 3, 9, t, "r1"), ("ok", "index_completion_v1", other, 1, 1, "2025-01-01T00:00:00Z", "r0"),
                                  ("fp", "index_completion_v1", other, 3, 9, t, "r1"), ("bad", "index_completion_v1", good, -1, 9, t, "r1"), ("kind", "x", good, 1, 9, t, "r1")], COMMIT)


def test_recovery_of_interrupted_runs(spark):
    old, new = "2026-01-01T00:00:00Z", "2026-01-01T00:59:00Z"
    st = spark.createDataFrame([(c, "indexing", 5.0, None, None, None, old) for c in ("ok", "fp", "bad", "kind", "none")] + [("fresh", "indexing", 5.0, None, None, None, new), ("done", "indexed", 5.0, None, 1, 1, old)], STATE)
    got = {r.corpus: (r.status, r.reason, r.total_chunks) for r in S.recover_interrupted(st, commits(spark), S.fingerprint(FP), F.lit("2026-01-01 01:00:00").cast("timestamp")).collect()}
    assert got == {"ok": ("indexed", "valid_marker", 9), "fp": ("indexfailed", "fingerprint_mismatch", None), "bad": ("indexfailed", "invalid_marker_payload", None),
                   "kind": ("indexfailed", "invalid_marker_payload", None), "none": ("indexfailed", "missing_marker", None), "fresh": ("indexing", None, None), "done": ("indexed", None, 1)}


def test_completion_proof_reasons(spark):
    st = spark.createDataFrame([(c, "indexed", None, None, None, None, None) for c in ("ok", "fp", "kind", "none")], STATE)
    got = {r.corpus: (r.proof, r.proof_reason) for r in S.completion_proof(st, commits(spark), S.fingerprint(FP)).collect()}
    assert got == {"ok": ("valid", None), "fp": ("fingerprint_mismatch", "fingerprint_mismatch"), "kind": ("stale_local", "invalid_marker_kind"), "none": ("stale_local", "missing_marker_doc")}


def test_merge_rules(spark):
    sch = "corpus string, status string, pct double, last_updated string"
    t = lambda m: f"2026-01-01T00:{m:02d}:00Z"
    local = spark.createDataFrame([("a", "indexed", None, t(50)), ("b", "indexing", 10.0, t(10)), ("c", "indexing", 10.0, t(59)), ("d", "indexed", None, t(1)), ("e", "indexed", None, t(1)), ("h", "indexing", 9.0, "?")], sch)
    disk = spark.createDataFrame([("a", "indexing", 50.0, t(40)), ("b", "indexed", None, t(5)), ("c", "indexing", 60.0, t(58)), ("d", "requires_reindex", None, t(0)), ("f", "indexed", None, t(1)), ("g", "indexed", None, t(1)), ("h", "indexing", 1.0, t(59))], sch)
    got = {r.corpus: r.winner for r in S.state_merge(local, disk, spark.createDataFrame([("g",), ("e",)], "corpus string"), F.lit("2026-01-01 01:00:00").cast("timestamp")).collect()}
    assert got == {"a": "local", "b": "disk", "c": "disk", "d": "disk", "e": "local", "f": "disk", "h": "disk"}


def test_root_resolve_takes_the_longest_whole_segment_prefix(spark):
    st = spark.createDataFrame([("/r/a", "indexed"), ("/r/a/b", "indexing"), ("/r/a/b/c", "indexfailed")], "corpus string, status string")
    req = spark.createDataFrame([(1, "/r/a/b/c/x.ts"), (2, "/r/ab/x"), (3, "/r/a"), (4, "/r/a/bc")], "request_id int, path string")
    got = {r.request_id: r.root for r in S.root_resolve(req, st, ["indexed", "indexing"]).collect()}
    assert got == {1: "/r/a/b", 2: None, 3: "/r/a", 4: "/r/a"}


def test_telemetry_percentiles(spark):
    ev = spark.range(101).select(F.lit("fast").alias("profile"), F.lit("synced").alias("freshness_mode"), F.col("id").cast("double").alias("latency_ms"), *[
        F.lit(1).alias(c) for c in ("results_before", "results_after", "results_returned", "pass_failures")], (F.col("id") % 2 == 0).alias("reranker_used"), F.lit(None).cast("string").alias("error"))
    r = S.search_telemetry(ev).first()
    assert (r.p50_latency, r.p95_latency) == (50.0, 95.0) and r.searches == 101 and r.error_rate == 0


def test_throttle_over_several_triggers_with_one_busy_corpus(spark):
    rnd = random.Random(2)
    t0 = dt.datetime(2026, 1, 1)
    rows = [("busy" if rnd.random() < 0.7 else f"c{rnd.randint(0, 5)}", i, t0 + dt.timedelta(seconds=3 * i + rnd.random())) for i in range(400)]
    src, out, ck = (shared_dir(spark, n) for n in ("req", "out", "ck"))
    schema = "corpus string, request_id long, ts timestamp"
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = watch.throttle(spark.readStream.schema(schema).parquet(src), 60).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        q.awaitTermination()
    last, want = {}, {}
    for c, i, t in rows:
        due = c not in last or (t - last[c]).total_seconds() >= 60
        if due:
            last[c] = t
        want[i] = "synced" if due else "skipped_recent"
    assert {r.request_id: r.mode for r in spark.read.parquet(out).collect()} == want


def test_event_filter(spark):
    ev = spark.createDataFrame([("c", p) for p in ("src/a.ts", ".gitignore", "../x", ".git/a", "dist/a.js", "")] + [("bad", "src/a.ts")], "corpus string, path string")
    st = spark.createDataFrame([("c", "indexed"), ("bad", "indexing")], "corpus string, status string")
    assert {(r.path, r.is_control) for r in watch.event_filter(ev, st, ["dist/"]).collect()} == {("src/a.ts", False), (".gitignore", True), ("", False)}


def test_ingest_batches_can_be_repeated(spark):
    root = shared_dir(spark, "idx")
    mk = lambda *r: spark.createDataFrame(list(r), "corpus string, path string, content string, mtime long, deleted boolean")
    one = mk(("c", "a", "old", 0, False), ("c", "a", "one", 1, False), ("c", "b", "bee", 1, False), ("c", "never", None, 1, True))
    two = mk(("c", "a", "two", 2, False), ("c", "b", None, 2, True), ("c", "d", "dee", 2, False))
    live = lambda: {(r.path, r.content) for r in ingest.current_chunks(spark, root).collect()}
    ingest.apply_batch(one, 0, root, split)
    assert live() == {("a", "one"), ("b", "bee")}
    ingest.apply_batch(two, 1, root, split)
    ingest.apply_batch(two, 1, root, split)
    assert live() == {("a", "two"), ("d", "dee")}
    ingest.apply_batch(mk(("c", "a", "two", 3, False), ("c", "d", "stale", 1, False)), 2, root, split)
    assert live() == {("a", "two"), ("d", "dee")}
    assert spark.read.parquet(f"{root}/versions").where("batch = 2").count() == 0


def test_rollups_of_rollups(spark):
    """Parts merged in any order are the roll-up of all rows: sums exactly, percentiles within 2 % of rank."""
    t0 = dt.datetime(2026, 1, 1)
    rnd = random.Random(4)
    rows = [("fast" if i % 3 else "slow", "synced" if i % 5 else None, t0 + dt.timedelta(minutes=i), rnd.random() * 100 if i % 11 else None, i % 7, i % 5, i % 3, i % 2, i % 4 == 0, "e" if i % 9 == 0 else None) for i in range(6000)]
    ev = spark.createDataFrame(rows, "profile string, freshness_mode string, ts timestamp, latency_ms double, results_before long, results_after long, results_returned long, pass_failures long, reranker_used boolean, error string")
    key = ["profile", "freshness_mode"]
    parts = S.telemetry_parts(ev)
    whole = S.read_telemetry(S.merge_telemetry(parts, key)).collect()
    halves = S.merge_telemetry(parts.where("hour(bucket) < 9"), key).unionByName(S.merge_telemetry(parts.where("hour(bucket) >= 9"), key))
    again = {(r.profile, r.freshness_mode): r for r in S.read_telemetry(S.merge_telemetry(halves, key)).collect()}
    exact = {(r.profile, r.freshness_mode): r for r in S.search_telemetry(ev).collect()}
    assert len(whole) == len(exact) == 4
    for got in whole:
        want, other = exact[got.profile, got.freshness_mode], again[got.profile, got.freshness_mode]
        same = ["searches", "max_latency", "before", "after", "returned", "pass_failures", "rerank_rate", "error_rate"]
        assert [got[c] for c in same] == [want[c] for c in same] == [other[c] for c in same] and abs(got.avg_latency - want.avg_latency) < 1e-5
        values = sorted(r[3] for r in rows if (r[0], r[1]) == (got.profile, got.freshness_mode) and r[3] is not None)
        for r in (got, other):
            for q, v in ((0.5, r.p50_latency), (0.95, r.p95_latency)):
                assert abs(sum(x <= v for x in values) / len(values) - q) <= 0.02
    assert S.read_telemetry(S.merge_telemetry(parts.limit(0), key)).collect() == []


def test_compacted_versions(spark):
    """With bases every second batch the versions and chunks are those without; deletes stay deleted and a batch can be repeated."""
    rnd = random.Random(8)
    schema = "corpus string, path string, content string, mtime long, deleted boolean"
    split = lambda f: f.select("corpus", "path", "content")
    roots = {n: shared_dir(spark, f"compact{n}") for n in (2, 100)}
    for b in range(5):
        rows = [("c", f"f{rnd.randint(0, 5)}", f"t{rnd.randint(0, 3)}", b if b < 4 else rnd.randint(0, 5), rnd.random() < 0.3) for _ in range(5)]
        batch = spark.createDataFrame(rows, schema)
        for every, root in roots.items():
            for _ in range(2 if b in (2, 3) else 1):
                ingest.apply_batch(batch, b, root, split, every)
    assert ingest.base_batch(spark, roots[2]) == 3 and ingest.base_batch(spark, roots[2], 3) == 1 and ingest.base_batch(spark, roots[100]) == -1
    state = {n: (sorted(map(tuple, ingest.versions(spark, r).collect())), sorted(map(tuple, ingest.current_chunks(spark, r).collect()))) for n, r in roots.items()}
    assert state[2] == state[100] and any(v[3] for v in state[2][0])
    plan = ingest.versions(spark, roots[2])._jdf.queryExecution().toString()
    assert "(batch#" in plan and "> 3)" in plan         # earlier batches are not opened
    ingest.compact(spark, roots[2], 4)
    assert sorted(map(tuple, ingest.versions(spark, roots[2]).collect())) == state[100][0]
