import os

import pytest
from pyspark.sql import functions as F

from quarry.functions.embedders import keyword_vector
from quarry.operators.state import fingerprint
from quarry.plans import index
from quarry.session import shared_dir
from quarry.sources import corpus as C, walk as W

FP = {"provider": "n", "model": "k", "dimension": 4, "store": "parquet", "schema_version": "hybrid_v3"}
NOW = "2026-01-01 00:00:00"


def plant(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def roots(spark, **where):
    return spark.createDataFrame([(c, str(p)) for c, p in where.items()], "corpus string, root string")


TREE = {"src/a.ts": "a", "src/deep/b.py": "b", "node_modules/m/x.js": "x", "node_modules/m/n/y.js": "y", "build/z.ts": "z", "gen/g.ts": "g", "gen/keep/k.ts": "k",
        ".git/config": "c", ".hidden/h.ts": "h", ".gitignore": "gen/\n!build/\n!build/**\n*.log.ts\n", "q.log.ts": "q", "sp ace/ü%20.ts": "u", "empty.ts": "", "bin.ts": b"\xff\x00"}


def listed_folders(folder_log):
    return {line for name in os.listdir(folder_log) for line in (folder_log / name).read_text().splitlines()}


def test_walk_equals_full_listing_and_lists_no_ignored_folder(spark, tmp_path):
    a, b, log = tmp_path / "a", tmp_path / "b", tmp_path / "log"
    plant(a, TREE)
    plant(b, {"build/z.ts": "z", "one.go": "o", "vendor/v.ts": "v", "vendor/w/w.ts": "w"})
    log.mkdir()
    os.symlink(a / "src", a / "loop")
    os.symlink(a / "src/a.ts", a / "src/link.ts")

    def lister(root, path):
        with open(log / str(os.getpid()), "a") as f:
            f.write(f"{os.path.basename(root)}:{path}\n")
        return W.list_folder(root, path)

    tree = W.walk(roots(spark, a=a, b=f"file://{b}"), rules=["vendor/**"], lister=lister)
    got = {(r.corpus, r.path, r.size) for r in tree.files.collect()}
    every = [(c, str(p.relative_to(top)), p.stat().st_size, bytearray(p.read_bytes())) for c, top in (("a", a), ("b", b)) for p in top.rglob("*") if p.is_file() and not p.is_symlink()]
    full = spark.createDataFrame(every, "corpus string, path string, size long, content binary")
    assert got == {(r.corpus, r.path, r.size) for r in C.discover(full, ["vendor/**"], corpus_rules=C.root_rules(full)).select("corpus", "path", "size").collect()}
    assert ("a", "build/z.ts", 1) in got and ("b", "build/z.ts", 1) not in got
    assert listed_folders(log) == {"a:", "a:src", "a:src/deep", "a:build", "a:sp ace", "b:"}
    assert tree.unlisted.count() == 0
    content = {r.path: bytes(r.content) for r in W.read_files(tree.files.where("corpus = 'a'")).collect()}
    assert content["sp ace/ü%20.ts"] == b"u" and content["bin.ts"] == b"\xff\x00" and content["empty.ts"] == b""


def test_walk_of_nothing_of_lost_folders_and_of_lost_roots(spark, tmp_path):
    assert W.walk(spark.createDataFrame([], "corpus string, root string")).files.count() == 0
    (tmp_path / "void").mkdir()
    assert W.walk(roots(spark, v=tmp_path / "void")).files.count() == 0
    plant(tmp_path / "a", {"src/a.ts": "a", "locked/b.ts": "b"})

    def lister(root, path):
        if path == "locked":
            raise PermissionError(path)
        return W.list_folder(root, path)

    tree = W.walk(roots(spark, a=tmp_path / "a"), lister=lister)
    assert [tuple(r) for r in tree.unlisted.collect()] == [("a", "locked")] and [r.path for r in tree.files.collect()] == ["src/a.ts"]
    with pytest.raises(OSError, match="gone"):
        W.walk(roots(spark, gone=tmp_path / "nowhere"))


def test_large_contents_leave_in_parts_and_lost_files_are_left_out(spark, tmp_path):
    plant(tmp_path, {f"f{i}.ts": str(i) * 3_000_000 for i in range(9)})
    files = spark.createDataFrame([("c", str(tmp_path), f"f{i}.ts", i) for i in range(11)], "corpus string, root string, path string, extra int").coalesce(1)
    got = {r.path: (len(r.content), r.extra) for r in W.read_files(files).collect()}
    assert got == {f"f{i}.ts": (3_000_000, i) for i in range(9)}


def test_sync_by_listing_reads_only_changed_files(spark, tmp_path):
    a, log, root = tmp_path / "a", tmp_path / "log", shared_dir(spark, "index")
    plant(a, {f"src/f{i}.ts": f"const x{i} = {i}" for i in range(6)})
    log.mkdir()
    at, now, fp = roots(spark, a=a), F.lit(NOW).cast("timestamp"), fingerprint(FP)

    def opener(r, path):
        with open(log / str(os.getpid()), "a") as f:
            f.write(path + "\n")
        return W.open_file(r, path)

    def reads():
        seen = sorted(line for name in os.listdir(log) for line in (log / name).read_text().splitlines())
        for name in os.listdir(log):
            (log / name).write_text("")
        return seen

    def sync(run):
        tree = W.walk(at)
        return {r.path: r.change for r in index.sync(tree.files, root, keyword_vector, fp, now, run, unscanned=tree.unlisted,
                                                      fetch=W.fetcher(at, opener), corpus_rules=tree.rules).collect()}

    live = lambda: {(r.path, r.content) for r in index.load(spark, root)[0].collect()}
    index.build(W.read_files(W.walk(at).files), root, keyword_vector, fp, now, "r1")
    assert sync("r2") == {} and reads() == []
    plant(a, {"src/f1.ts": "const other = 1", "new.ts": "n"})
    (a / "src/f2.ts").unlink()
    os.utime(a / "src/f3.ts", (1, 1))
    assert sync("r3") == {"src/f1.ts": "modified", "new.ts": "added", "src/f2.ts": "removed"}
    assert reads() == ["new.ts", "src/f1.ts", "src/f3.ts"]
    assert live() == {(f"src/f{i}.ts", f"const x{i} = {i}") for i in (0, 3, 4, 5)} | {("src/f1.ts", "const other = 1"), ("new.ts", "n")}
    assert sync("r4") == {} and reads() == []
    plant(a, {"src/f4.ts": "const locked = 4444"})
    lost = lambda wanted: W.fetcher(at)(wanted).where("path <> 'src/f4.ts'")
    delta = index.sync(W.walk(at).files, root, keyword_vector, fp, now, "r5", fetch=lost)
    assert delta.count() == 0 and ("src/f4.ts", "const x4 = 4") in live()       # unreadable: its earlier state stays
    assert sync("r6") == {"src/f4.ts": "modified"}
