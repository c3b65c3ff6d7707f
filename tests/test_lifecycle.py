import pytest
from pyspark.sql import functions as F

from quarry.functions.embedders import keyword_vector
from quarry.operators.state import fingerprint
from quarry.plans import index, lifecycle as L
from quarry.session import shared_dir
from quarry.sources import tables as T

FP = {"provider": "n", "model": "k", "dimension": 4, "store": "parquet", "schema_version": "hybrid_v3"}


def at(minute):
    return F.lit(f"2026-01-01 00:{minute:02d}:00").cast("timestamp")


def mk(spark, *rows):
    return spark.createDataFrame([(c, p, t, len(t), m) for c, p, t, m in rows], "corpus string, path string, content string, size long, mtime long")


def statuses(spark, root):
    return {r.corpus: (r.status, r.indexed_files, r.total_chunks) for r in L.current(spark, root).collect()}


def opened(spark, root, fp):
    return {r.corpus: r.reason for r in L.gate(spark, root, fp).collect()}


def test_transitions_around_build_sync_and_failure(spark):
    root, fp = shared_dir(spark, "index"), fingerprint(FP)
    assert L.current(spark, root).count() == 0
    L.build(mk(spark, ("a", "x.py", "x", 1), ("b", "y.py", "y", 1)), root, keyword_vector, fp, at(0), "r1")
    assert statuses(spark, root) == {"a": ("indexed", 1, 1), "b": ("indexed", 1, 1)} and opened(spark, root, fp) == {"a": None, "b": None}
    assert L.sync(mk(spark, ("a", "x.py", "x", 1), ("a", "z.py", "z", 1)), root, keyword_vector, fp, at(1), "r2").count() == 1
    assert statuses(spark, root) == {"a": ("indexed", 2, 2), "b": ("indexed", 1, 1)}

    def broken(text):
        raise ValueError("no model")

    with pytest.raises(ValueError, match="no model"):
        L.build(mk(spark, ("b", "y.py", "other", 2)), root, broken, fp, at(2), "r3")
    b = L.current(spark, root).where("corpus = 'b'").first()
    assert (b.status, b.error, b.run_id) == ("indexfailed", "ValueError: no model", "r3")
    assert opened(spark, root, fp) == {"a": None, "b": "not_ready:indexfailed"}
    L.build(mk(spark, ("b", "y.py", "other", 2)), root, keyword_vector, fp, at(3), "r4")
    b = L.current(spark, root).where("corpus = 'b'").first()
    assert (b.status, b.error, b.reason) == ("indexed", None, None) and opened(spark, root, fp)["b"] is None
    versions = [r.version for r in L.transitions(spark, root).where("corpus = 'b'").orderBy("version").collect()]
    assert versions == list(range(1, len(versions) + 1))


def test_a_corpus_in_work_is_not_written_by_another_run(spark):
    root, fp = shared_dir(spark, "index"), fingerprint(FP)
    files = mk(spark, ("a", "x.py", "x", 1))
    L.begin(files, root, fp, at(0), "r1")
    with pytest.raises(L.Busy, match="a"):
        L.build(files, root, keyword_vector, fp, at(1), "r2")
    L.beat(spark, root, "r1", at(3), 40.0)
    with pytest.raises(L.Busy):
        L.begin(files, root, fp, at(4), "r3")
    assert L.recover(spark, root, fp, at(4)).count() == 0 and L.current(spark, root).first().pct == 40.0
    L.build(files, root, keyword_vector, fp, at(9), "r4")         # silent for over the grace time: taken over
    assert statuses(spark, root) == {"a": ("indexed", 1, 1)}
    L.finish(spark, root, "r1", at(10))                           # the run that was thought dead has no say any more
    assert L.current(spark, root).first().run_id == "r4"


def test_interrupted_runs_are_recovered_by_their_proof(spark):
    """Runs whose driver died: before anything was written, between chunks and commit, and between commit and last transition."""
    root, fp = shared_dir(spark, "index"), fingerprint(FP)
    first = lambda c: mk(spark, (c, "x.py", "x", 1))
    L.begin(first("early"), root, fp, at(0), "r0")
    assert {(r.corpus, r.status, r.reason) for r in L.recover(spark, root, fp, at(5)).collect()} == {("early", "indexfailed", "missing_marker")}
    for c in ("between", "late", "untouched"):
        L.build(first(c), root, keyword_vector, fp, at(6), "r1-" + c)
    for c in ("between", "late", "untouched"):
        L.begin(first(c), root, fp, at(10), "r2-" + c)
    index._withdraw(first("between").select("corpus"), root, fp, at(10), "r2-between")
    index.build(mk(spark, ("late", "x.py", "x", 2), ("late", "y.py", "y", 2)), root, keyword_vector, fp, at(10), "r2-late")
    assert L.recover(spark, root, fp, at(11)).count() == 0
    got = {r.corpus: (r.action, r.status) for r in L.recover(spark, root, fp, at(20)).collect()}
    assert got == {"between": ("mark_failed", "indexfailed"), "late": ("promote_indexed", "indexed"), "untouched": ("promote_indexed", "indexed")}
    assert statuses(spark, root)["late"] == ("indexed", 2, 2)
    assert opened(spark, root, fp) == {"early": "not_ready:indexfailed", "between": "not_ready:indexfailed", "late": None, "untouched": None}
    assert L.recover(spark, root, fp, at(30)).count() == 0
    other = fingerprint(FP | {"model": "new"})
    L.begin(first("late"), root, other, at(31), "r3")
    assert [(r.status, r.reason) for r in L.recover(spark, root, other, at(40)).collect()] == [("indexfailed", "fingerprint_mismatch")]
    assert T.exists(spark, f"{root}/state")
