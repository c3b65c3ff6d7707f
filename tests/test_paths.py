import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions import fixed as X, paths as P
from quarry.functions.ignore_rules import compile_rules, glob_regex_column, is_ignored, pattern_regex
from quarry.sources import corpus as C


def ignored(spark, rules, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in df.where(is_ignored(F.col("path"), rules)).collect()}


def test_negation_keeps_a_file_whose_folder_is_not_itself_ignored(spark):
    paths = ["src/main.ts", "generated/drop.ts", "generated/keep.ts"]
    assert ignored(spark, ["generated/**", "!generated/keep.ts"], paths) == {"generated/drop.ts"}
    # the folder itself is ignored, so nothing below comes back
    assert ignored(spark, ["generated/", "!generated/keep.ts"], paths) == {"generated/drop.ts", "generated/keep.ts"}


@pytest.mark.parametrize("rule,hits", [
    ("*.log", {"a.log", "x/b.log"}), ("/a.log", {"a.log"}), ("x/", {"x/b.log", "x/y/z.ts"}), ("x/**/z.ts", {"x/y/z.ts"}),
    ("**/y", {"x/y/z.ts"}), ("[ab].?og", {"a.log", "x/b.log"}), ("# x/", set()), ("\\#f", {"#f"}),
])
def test_single_rules(spark, rule, hits):
    assert ignored(spark, [rule], ["a.log", "x/b.log", "x/y/z.ts", "#f", "xx/q.ts"]) == hits


def sequential(path, rules):
    """Walk from the top folder down; the last matching rule decides; an ignored folder ends the walk."""
    segs = path.split("/")
    for i in range(1, len(segs) + 1):
        entry = "/".join(segs[:i]) + ("/" if i < len(segs) else "")
        verdict = False
        for r in rules:
            if re.fullmatch(r.regex, entry):
                verdict = not r.negate
        if verdict:
            return True
    return False


name = st.sampled_from(["a", "b", "dist", "x.ts", "y.log"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["dist/", "!dist/", "*.log", "!y.log", "a/**", "!a/b/**", "b", "!a/x.ts", "/b/*", "**/x.ts"]), min_size=1, max_size=5),
       st.lists(st.lists(name, min_size=1, max_size=4).map("/".join), min_size=1, max_size=30, unique=True))
def test_rules_agree_with_a_walk(spark, patterns, paths):
    rules = compile_rules(patterns)
    assert ignored(spark, patterns, paths) == {p for p in paths if sequential(p, rules)}


def test_query_patterns_as_columns_agree_with_compiled_ones(spark):
    pats = ["src/**", "*.ts", "src/a/", "/lib", "**/x.ts", "a?c", "src/*/b.ts", "docs", "a.b+c", "!no", ""]
    paths = ["src/a/b.ts", "lib/q", "x/lib/q", "x.ts", "d/x.ts", "abc", "src/a/c", "docs/r.md", "a.b+c", "aXbc"]
    df = spark.createDataFrame([(p,) for p in pats], "p string").select("p", glob_regex_column(F.col("p")).alias("r"))
    for row in df.collect():
        want = pattern_regex(row.p)
        assert (row.r is None) == (want is None)
        if want:
            assert [bool(re.search(row.r, x)) for x in paths] == [bool(re.search(want, x)) for x in paths], row.p


def test_normalize_and_categories(spark):
    rows = [(" ./a//b/ ",), ("a/../b",), ("\\a\\.\\b",), ("./.",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(P.normalize_path(F.col("p"))).collect()]
    assert got == ["a/b", None, "a/b", None, None]
    cat = {"docs/auth.md": ("docs", "docs"), "src/x.ts": ("neutral", "runtime"), "a/src/x.ts": ("srcRuntime", "runtime"),
           "dist/x.js": ("neutral", "generated"), "a/dist/x.js": ("generated", "generated"), "src/a.test.ts": ("tests", "tests"),
           "src/__fixtures__/f.ts": ("neutral", "fixtures"), "a/core/x.ts": ("core", "runtime"), "b/Index.ts": ("entrypoint", "runtime")}
    df = spark.createDataFrame([(k,) for k in cat], "p string")
    got = {r.p: (r.a, r.b) for r in df.select("p", P.path_category(F.col("p")).alias("a"), P.noise_category(F.col("p")).alias("b")).collect()}
    assert got == cat


def test_scan_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("hello")
    (tmp_path / "b.bin").write_bytes(bytes.fromhex("ff007f1234ab"))
    f = C.scan_files(spark, str(tmp_path), "c1")
    assert {(r.path, r.size) for r in f.collect()} == {("src/a.ts", 5), ("b.bin", 6)}
    assert [r.path for r in C.discover(f).collect()] == ["src/a.ts"]
    assert "content" not in C.scan_files(spark, str(tmp_path), "c1", with_content=False).columns


def test_language_names(spark):
    rows = [("TS ",), ("c++",), ("go",), ("cobol",), ("",), (None,)]
    df = spark.createDataFrame(rows, "l string")
    assert [r[0] for r in df.select(P.normalize_language(F.col("l"))).collect()] == ["typescript", "cpp", "go", "cobol", "text", "text"]
    assert [r[0] for r in df.select(P.graph_capable(F.col("l"), F.lit(".x"))).collect()] == [True, False, False, False, False, False]


GLOBS = ["src/*", "*", "**/*", "a/*/b", "***/b", "*.py[co]", "*.g[oe]", "[!a]*.ts", "[^ab].ts", "\\*.ts", "a\\[b", "**/x", "x/**", "a/**/b", "**", "a**b", "?", "a?c/", "/a", "a/b", "[a-c]/", "[]a].ts", "a[", "a.b+c", "(a|b)", "a{1}$", "\\a", "x\\"]
SAMPLES = ["src", "src/a", "src/a/b", "a.pyc", "a.pyo", "a.py", "a.go", "a.ge", "x/a.gx", "b.ts", "a.ts", "c.ts", "*.ts", "a[b", "x", "q/x", "x/y/z", "a/b", "a/q/b", "a/q/r/b", "aXb", "a/b/c", "abc/d", "abc", "a", "b/a", "b/", "d/", "].ts", "a[", "a.b+c",
           "aXbbc", "(a|b)", "a{1}$", "[x", "x\\", "a\\"]


def test_one_meaning_of_globs(spark):
    """The list compiler and the column compiler match the same paths, classes and escapes included."""
    made = spark.createDataFrame([(g,) for g in GLOBS], "g string").select("g", glob_regex_column(F.col("g")).alias("whole"), glob_regex_column(F.col("g"), entry=True).alias("entry")).collect()
    for r in made:
        rule = compile_rules([r["g"]])[0]
        want, whole = re.compile(f"(?:{rule.regex})$"), re.compile(pattern_regex(r["g"]))
        for p in SAMPLES:
            for path in (p, p + "/"):
                assert bool(re.match(r["entry"], path)) == bool(want.match(path)), (r["g"], path)
            assert bool(re.match(r["whole"], p)) == bool(whole.match(p)), (r["g"], p)


def test_own_rules_bring_back_what_earlier_rules_drop(spark):
    from quarry.sources.corpus import discover, root_rules
    paths = ["x.min.js", "build/a.ts", "src/a.ts", "lib/b.ts", "a.go", "b.ge", "pkg/build/c.ts", "src/gen/d.ts"]
    own = {"one": "!*.min.js\n!build/\n!build/**\n*.g[oe]\nsrc/gen/\n", "two": "!lib/\nsrc/*\n!src/a.ts\nbuild", "three": "# nothing\n"}
    rows = [(c, p, "x") for c in (*own, "four") for p in paths] + [(c, ".gitignore", t) for c, t in own.items()]
    files = spark.createDataFrame(rows, "corpus string, path string, content string")
    before = [*X.DEFAULT_IGNORE_RULES, "lib/"]
    got = discover(files, ["lib/"], [".go", ".ge"], root_rules(files, before=before)).collect()
    kept = {c: sorted(r["path"] for r in got if r["corpus"] == c) for c in (*own, "four")}
    plain = ["a.go", "b.ge", "src/a.ts", "src/gen/d.ts"]
    assert kept == {"one": ["build/a.ts", "pkg/build/c.ts", "src/a.ts", "x.min.js"], "two": ["a.go", "b.ge", "lib/b.ts", "src/a.ts"], "three": plain, "four": plain}
