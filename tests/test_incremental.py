import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking as C, incremental as I
from quarry.session import shared_dir
from quarry.sources import tables as T

FILES = "corpus string, path string, content string, size long, mtime long"


def files(spark, *rows):
    return spark.createDataFrame([("c", p, t, len(t or ""), m) for p, t, m in rows], FILES)


def split(f):
    return C.finish_chunks(C.chunk_windows(f, 200)).select("chunk_id", "corpus", "path", "start_line", "end_line", "content")


def changes(df):
    return {r.path: r.change for r in df.collect()}


def test_delta_and_reindex(spark):
    a = files(spark, ("src/service.ts", "old", 1), ("src/obsolete.ts", "x", 1), ("src/same.ts", "s", 1))
    b = files(spark, ("src/service.ts", "new", 2), ("src/new.ts", "n", 2), ("src/same.ts", "s", 1))
    first, delta = I.reindex(split(a), None, I.file_snapshot(a), a, split)
    assert changes(delta) == {"src/service.ts": "added", "src/obsolete.ts": "added", "src/same.ts": "added"} and first.count() == 3
    table, delta = I.reindex(first, I.file_snapshot(a), I.file_snapshot(b), b, split)
    assert changes(delta) == {"src/service.ts": "modified", "src/obsolete.ts": "removed", "src/new.ts": "added"}
    assert {(r.path, r.content) for r in table.collect()} == {("src/service.ts", "new"), ("src/new.ts", "n"), ("src/same.ts", "s")}
    assert [tuple(r)[1:] for r in I.diff_counts(delta).collect()] == [(1, 1, 1)]


def test_touch_only_hashes_once_and_finds_nothing(spark):
    a = I.file_snapshot(files(spark, ("a.ts", "x", 1)))
    touched = files(spark, ("a.ts", "x", 9))
    s = I.snapshot_with_reuse(touched, a)
    assert I.snapshot_diff(a, s).count() == 0 and s.where("hashed").count() == 1
    again = I.snapshot_with_reuse(touched, s.drop("hashed"))
    assert again.where("hashed").count() == 0
    assert I.snapshot_with_reuse(touched, s.drop("hashed"), force=True).where("hashed").count() == 1


def test_binary_content_is_hashed_by_bytes(spark):
    mk = lambda h: spark.createDataFrame([("c", "b", bytearray.fromhex(h), 6, 1)], "corpus string, path string, content binary, size long, mtime long")
    d = I.snapshot_diff(I.file_snapshot(mk("ff007f1234ab")), I.file_snapshot(mk("ff007f1234ac")))
    assert changes(d) == {"b": "modified"}


def test_partial_scan_keeps_only_what_it_could_not_see(spark):
    prev = I.file_snapshot(files(spark, ("src/locked.ts", "l", 1), ("sub/dir/a.ts", "a", 1), ("subdir/b.ts", "b", 1), ("gone.ts", "g", 1), ("sub/dir/x.log", "x", 1), (".h/a", "q", 1)))
    now = I.file_snapshot(files(spark, ("new.ts", "n", 1)))
    unreadable = spark.createDataFrame([("c", "src/locked.ts"), ("c", ".h/a")], "corpus string, path string")
    unscanned = spark.createDataFrame([("c", "./sub//"), ("c", "sub/dir"), ("c", "../x")], "corpus string, prefix string")
    assert [r.prefix for r in I.compress_prefixes(unscanned).collect()] == ["sub"]
    state = I.preserve_unscanned(prev, now, unreadable, unscanned, ["*.log"])
    assert {r.path for r in state.collect()} == {"new.ts", "src/locked.ts", "sub/dir/a.ts"}
    assert changes(I.snapshot_diff(prev, state)) == {"new.ts": "added", "subdir/b.ts": "removed", "gone.ts": "removed", "sub/dir/x.log": "removed", ".h/a": "removed"}


def test_merkle_root_sees_every_change_and_no_order(spark):
    rows = [(f"f{i}", str(i), 1) for i in range(40)]
    root = lambda r: I.merkle_root(I.file_snapshot(files(spark, *r)), 1).first().root
    assert root(rows) == root(rows[::-1])
    assert len({root(rows), root(rows[:-1]), root(rows[:-1] + [("f39", "changed", 1)]), root(rows[:-1] + [("g", "39", 1)])}) == 4


def test_control_signature_preflight_and_status_lines(spark):
    f = files(spark, (".gitignore", "abc", 7), ("a.ts", "x", 1))
    assert I.control_signature(f, f).first().signature == ".gitignore:7:3|.indexignore:missing"
    lines = ["M  a.ts", "?? new.ts", "!! skip.ts", "R  old.ts -> dir/new name.ts", ' M "q \\"x\\".ts"', " D ../out", "x", " M /abs.ts  "]
    st = spark.createDataFrame([("c", x) for x in lines], "corpus string, line string")
    assert {r.path for r in I.changed_paths(st).collect()} == {"a.ts", "dir/new name.ts", 'q "x".ts', "abs.ts"}
    assert I.changed_paths(st, include_untracked=True).where("path = 'new.ts'").count() == 1


def test_upsert_delete_and_partition_writes(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "chunk_id string, corpus string, path string, v int")
    old, new = mk(("1", "a", "p", 1), ("2", "a", "q", 1), ("3", "b", "p", 1)), mk(("2", "a", "q", 2), ("4", "a", "r", 2), ("4", "a", "r", 2))
    up = T.upsert(old, new)
    assert sorted((r.chunk_id, r.v) for r in up.collect()) == [("1", 1), ("2", 2), ("3", 1), ("4", 2)]
    paths = spark.createDataFrame([("a", "./p"), ("a", "p/"), ("a", "../p")], "corpus string, path string")
    assert {r.chunk_id for r in T.delete_paths(up, paths).collect()} == {"2", "3", "4"}
    assert [tuple(r) for r in T.deleted_counts(up, paths).collect()] == [("a", 1, 1)]
    where = shared_dir(spark, "table")
    T.write_partitions(old, where)
    table = lambda: spark.read.parquet(where)
    T.write_partitions(T.upsert(table().where("corpus = 'a'").select(*old.columns), new), where)      # reads what it replaces
    assert sorted((r.chunk_id, r.v) for r in table().collect()) == [("1", 1), ("2", 2), ("3", 1), ("4", 2)]


def test_cap_on_one_corpus_that_holds_most_rows(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.9 else "cold", f"f{rnd.randint(0, 60):03d}", i, f"c{i:05d}") for i in range(800)]
    df = spark.createDataFrame(rows, "corpus string, path string, start_line int, chunk_id string")
    got = T.cap_chunks(df, 100, buckets=7)
    want = {r[3] for c in ("hot", "cold") for r in sorted([x for x in rows if x[0] == c], key=lambda x: (x[1], x[2]))[:100]}
    assert {r.chunk_id for r in got.collect()} == want
    n_cold = sum(r[0] == "cold" for r in rows)
    assert {r.corpus: r.status for r in got.select("corpus", "status").distinct().collect()} == {
        "hot": "limit_reached", "cold": "completed" if n_cold < 100 else "limit_reached"}


def test_a_query_is_cut_only_where_asked(spark):
    df = spark.range(20000).select(F.format_string("%06d", "id").alias("chunk_id"))
    assert T.query(df, "", ["chunk_id"]).count() == 20000 and T.query(df, "", ["chunk_id"], 16384).count() == 16384 and T.query(df, "chunk_id >= '000000'", ["chunk_id"]).count() == 20000


def test_index_build_sync_and_rebuild(spark):
    from quarry.functions.embedders import keyword_vector
    from quarry.operators.state import fingerprint
    from quarry.plans import index
    root, now = shared_dir(spark, "index"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    fp = fingerprint({"provider": "n", "model": "k", "dimension": 4, "store": "parquet", "schema_version": "hybrid_v3"})
    mk = lambda *rows: spark.createDataFrame([(c, p, t, len(t), m) for c, p, t, m in rows], FILES)
    live = lambda: {(r.corpus, r.path, r.content) for r in index.load(spark, root)[0].collect()}
    index.build(mk(("007", "a.py", "def f():\n  1", 1), ("007", "b.ts", "x", 1), ("x", "c.go", "y", 1), ("x", "skip.bin", "z", 1)), root, keyword_vector, fp, now, "r1")
    assert live() == {("007", "a.py", "def f():\n  1"), ("007", "b.ts", "x"), ("x", "c.go", "y")}
    delta = index.sync(mk(("007", "a.py", "def g():\n  1", 2), ("x", "d.go", "w", 2)), root, keyword_vector, fp, now, "r2")
    assert changes(delta) == {"a.py": "modified", "b.ts": "removed", "c.go": "removed", "d.go": "added"}
    assert live() == {("007", "a.py", "def g():\n  1"), ("x", "d.go", "w")}
    assert index.sync(mk(("007", "a.py", "def g():\n  1", 2), ("x", "d.go", "w", 2)), root, keyword_vector, fp, now, "r3").count() == 0
    assert live() == {("007", "a.py", "def g():\n  1"), ("x", "d.go", "w")}
    index.build(mk(("007", "new.py", "n", 3)), root, keyword_vector, fp, now, "r4")
    assert live() == {("007", "new.py", "n"), ("x", "d.go", "w")}
    chunks, commits = index.load(spark, root)
    assert {(r.corpus, r.indexed_files, r.run_id) for r in commits.collect()} == {("007", 1, "r4"), ("x", 1, "r2")}


def test_index_caps_touches_partial_scans_and_clear(spark):
    from quarry.functions.embedders import keyword_vector
    from quarry.operators.state import fingerprint
    from quarry.plans import index
    root, now = shared_dir(spark, "index"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    fp = fingerprint({"provider": "n", "model": "k", "dimension": 4, "store": "parquet", "schema_version": "hybrid_v3"})
    mk = lambda *rows: spark.createDataFrame([(c, p, t, len(t), m) for c, p, t, m in rows], FILES)
    paths = lambda: sorted(r.path for r in index.load(spark, root)[0].collect())
    snap = lambda: {r.path: r.mtime for r in spark.read.parquet(f"{root}/snapshot").collect()}
    five = [("a", f"src/f{i}.ts", f"x{i}", 1) for i in range(4)] + [("a", "lib/g.go", "y", 1)]
    index.build(mk(*five), root, keyword_vector, fp, now, "r1", cap=2)
    assert len(paths()) == 2 and set(snap()) == set(paths())
    assert index.load(spark, root)[1].first().status == "limit_reached"
    assert index.sync(mk(*five), root, keyword_vector, fp, now, "r2").count() == 3 and len(paths()) == 5
    later = [(c, p, t, 2) for c, p, t, _ in five]
    assert index.sync(mk(*later), root, keyword_vector, fp, now, "r3").count() == 0 and set(snap().values()) == {2}
    assert index.sync(mk(*later), root, keyword_vector, fp, now, "r4").count() == 0
    assert index.load(spark, root)[1].first().run_id == "r3"        # nothing to store: no new record
    prefix = spark.createDataFrame([("a", "src")], "corpus string, prefix string")
    lost = spark.createDataFrame([("a", "lib/g.go")], "corpus string, path string")
    assert index.sync(mk(("a", "lib/h.go", "z", 1)), root, keyword_vector, fp, now, "r5", unscanned=prefix, unreadable=lost).count() == 1
    assert len(paths()) == 6
    assert index.sync(mk(*later), root, keyword_vector, fp, now, "r6", rules=["lib/"]).count() == 2 and len(paths()) == 4
    index.build(mk(("b", "z.ts", "z", 1)), root, keyword_vector, fp, now, "r7")
    index.clear(spark, root, mk(*later))
    assert paths() == ["z.ts"] and set(snap()) == {"z.ts"} and [r.corpus for r in index.load(spark, root)[1].collect()] == ["b"]


def test_cuts_are_removed_at_the_end(spark, tmp_path):
    import os

    from quarry.session import cut_lineage, temporary_cuts
    kept = cut_lineage(spark.range(3), "kept")
    with pytest.raises(RuntimeError), temporary_cuts(spark):
        inner = cut_lineage(spark.range(5), "inner")
        path = inner.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert inner.count() == 5 and os.path.exists(path)
        raise RuntimeError
    assert not os.path.exists(path) and kept.count() == 3
