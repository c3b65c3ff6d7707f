from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions.text import breadcrumbs
from quarry.operators import chunking as C


def files(spark, *rows):
    return spark.createDataFrame([("c", p, t) for p, t in rows], "corpus string, path string, content string")


def pack(text, size):
    """Sequential packing of whole lines; a longer line is cut at the size."""
    units = []
    lines = text.split("\n")
    for i, ln in enumerate(lines):
        ln += "\n" if i < len(lines) - 1 else ""
        units += [(ln[j : j + size], i + 1) for j in range(0, max(len(ln), 1), size)]
    out, cur, n = [], [], 0
    for u in units:
        if n > 0 and n + len(u[0]) > size:
            out.append(cur)
            cur, n = [], 0
        cur.append(u)
        n += len(u[0])
    out.append(cur)
    return [("".join(u[0] for u in c), c[0][1], c[-1][1]) for c in out if "".join(u[0] for u in c).strip()]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=12), st.integers(3, 25))
def test_windows_equal_a_sequential_packer(spark, texts, size):
    f = files(spark, *[(f"f{i}", t) for i, t in enumerate(texts)])
    got = {}
    for r in C.chunk_windows(f, size).orderBy("path", "chunk_no").collect():
        got.setdefault(r.path, []).append((r.content, r.start_line, r.end_line))
    for i, t in enumerate(texts):
        assert got.get(f"f{i}", []) == pack(t, size)


TS = """import { a } from 'b';
export class Auth {
  x = 1;
}
export async function issue(user: string) {
  return 1;
}
interface Opts { a: 1 }
type Id = string;"""
PY = """import os
class Graph:
    pass
async def run(a, b):
    return 1
def beta():
    return 2"""


def test_declarations_and_labels(spark):
    c = C.finish_chunks(C.chunk_declarations(files(spark, ("a.ts", TS), ("b.py", PY), ("c.md", "just\ntext"))))
    got = {}
    for r in c.orderBy("path", "chunk_no").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.symbol_label, r.symbol_id is not None))
    assert got["a.ts"] == [(1, 1, None, False), (2, 4, "class Auth", True), (5, 7, "async function issue(user: string)", True),
                           (8, 8, "interface Opts", True), (9, 9, "type Id", True)]
    assert got["b.py"] == [(1, 1, None, False), (2, 3, "class Graph", True), (4, 5, "async function run(a, b)", True), (6, 7, "function beta()", True)]
    assert got["c.md"] == [(1, 2, None, False)]


def test_large_chunks_are_cut_on_lines_and_keep_their_symbol(spark):
    body = "def f():\n" + "\n".join(f"    x{i} = {i}" for i in range(30))
    c = C.split_large(C.finish_chunks(C.chunk_declarations(files(spark, ("a.py", body)))), 100).orderBy("part").collect()
    assert len(c) > 3 and all(len(r.content) <= 100 and r.symbol_label == "function f()" for r in c)
    assert c[0].start_line == 1 and c[-1].end_line == 31
    assert all(b.start_line == a.end_line + 1 for a, b in zip(c, c[1:]))


def test_overlap_keeps_the_own_span(spark):
    c = C.chunk_windows(files(spark, ("a", "aaaa\nbbbb\ncccc")), 5, overlap=3).orderBy("chunk_no").collect()
    assert [(r.start_line, r.overlap_start, r.embed_text) for r in c] == [(1, 1, "aaaa\n"), (2, 1, "aa\n\nbbbb\n"), (3, 1, "bb\n\ncccc")]


def test_breadcrumbs(spark):
    rows = [(["a", "a", " b  c ", "x" * 130],), (["", " "],), (["one"],), (["p", "q", "p"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<string>").select(breadcrumbs(F.col("s"))).collect()]
    assert got == [["b c", "x" * 117 + "..."], None, ["one"], ["q", "p"]]


def test_methods_arrows_and_constructors_are_chunks(spark):
    code = {
        "a.ts": "export class Box {\n  constructor(private n: number) {\n    this.n = n;\n  }\n  async open(key: string): Promise<void> {\n    if (key) {\n      use(key);\n    }\n  }\n}\nexport const add = (a: number, b: number) => a + b;",
        "B.java": "public class B {\n  private final int n;\n  public B(int n) {\n    this.n = n;\n  }\n  protected static List<String> names(int k) throws X {\n    return null;\n  }\n}",
    }
    df = spark.createDataFrame([("c", p, t) for p, t in code.items()], "corpus string, path string, content string")
    got = {}
    for r in C.split_code(df).orderBy("path", "start_line").collect():
        got.setdefault(r.path, []).append((r.start_line, r.symbol_label))
    assert [x for x, _ in got["a.ts"]] == [1, 2, 5, 11] and [x for x, _ in got["B.java"]] == [1, 3, 6]
    labels = [x for _, x in got["a.ts"]]
    assert labels[0] == "class Box" and labels[1].startswith("method constructor(") and labels[2].startswith("async method open(key")


def test_split_code_has_no_exchange_and_cuts_long_lines(spark):
    long = "x" * 7000
    df = spark.createDataFrame([("c", "a.py", "def f():\n  " + long + "\ndef g():\n  pass")], "corpus string, path string, content string")
    out = C.split_code(df, 2500, 10)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.orderBy("chunk_no", "part").collect()
    assert max(len(r.content) for r in rows) <= 2500 and sum(r.content.count("x") for r in rows) == 7000
    assert all(b.overlap_text == a.content[-10:] for a, b in zip(rows, rows[1:], strict=False))
