"""Nested declarations by language, and the chunks made of them."""
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.functions.outline import BLANKED, blanked, outline
from quarry.operators import structure

TS = '''import { a } from "./a";

export class Store {
  // class Fake {
  private name = "function no() {";
  constructor(private size: number) {
    this.name = `}
    class Inner {`;
  }

  async load(id: string): Promise<void> {
    if (id) {
      run(id);
    }
    const inner = (x: number) => {
      return x;
    };
  }
}

export type Pair = { a: number; b: string };
interface Shape
{
  area(): number;
}
const twice = (x) => x * 2;
function outer(a, { b }) {
  function nested() { return 1; }
  return nested();
}
run();
'''
PY = '''"""class Doc:"""
import os


@cache
@other(1)
class Store:
    """def no():
class AlsoNo:
    """

    def load(self,
             key=")",
    ):
        x = """
def hidden(): pass
"""
        def inner():
            return [
1,
            ]
        return inner

    async def save(self): pass

def last(): # def no()
    return 1
done = True
'''
JAVA = '''package a;
public class Store<T> extends Base {
    private final char open = '{';
    public Store(int n) { this.n = n; }
    @Override
    public List<T> all(Map<String, T> m) throws IOException {
        for (T t : m.values()) { use(t); }
        return new ArrayList<>() { };
    }
    abstract int size();
    interface Inner { void go(String s); }
}
'''
CPP = '''#include <x>
namespace app {
struct Point { int x; };
class Store : public Base {
 public:
  explicit Store(int n) : n_(n) {}
  int size() const { return n_; }
};
}
int app::run(const char* s) {
  if (s) { return 1; }
  return 0;
}
'''
GO = '''package main

const limit = 10
var (
	a = "}"
	b = 2
)
type Store struct {
	name string
}
func (s *Store) Load(id string) error {
	if id == "" { return nil }
	return `raw
} func`
}
func main() {}
'''
RUST = '''use a::b;
pub struct Store<'a> { name: &'a str }
impl<'a> Store<'a> {
    pub async fn load(&self, c: char) -> bool {
        c == '}' || c == '\\''
    }
}
mod inner { fn f() {} }
trait T { fn g(&self); }
'''
CS = '''namespace App {
  public class Store {
    public int Size => 1;
    public async Task<int> Load(string id) { return 1; }
    internal static int Twice(int x) => x * 2;
  }
}
'''
SCALA = '''object App {
  case class P(x: Int)
  def twice(x: Int): Int = x * 2
  def many(x: Int): Int = {
    def deep = 1
    x
  }
}
'''


def named(code, language):
    """(first, last, how deep, the own header's first words) of declarations."""
    return [(a, b, len(h), h[-1][:22]) for a, b, h in outline(code, language) if h]


@pytest.mark.parametrize(("language", "code", "want"), [
    ("typescript", TS, [(3, 19, 1, "export class Store {"), (6, 9, 2, "constructor(private si"), (11, 18, 2, "async load(id: string)"), (15, 17, 3, "const inner = (x: numb"),
                        (21, 21, 1, "export type Pair = {"), (22, 25, 1, "interface Shape {"), (26, 26, 1, "const twice = (x) => x"), (27, 30, 1, "function outer(a, { b "), (28, 28, 2, "function nested() {")]),
    ("python", PY, [(5, 24, 1, "class Store:"), (12, 22, 2, "def load(self, key=\")\""), (18, 21, 3, "def inner():"), (24, 24, 2, "async def save(self):"), (26, 27, 1, "def last():")]),
    ("java", JAVA, [(2, 12, 1, "public class Store<T> "), (4, 4, 2, "public Store(int n) {"), (5, 9, 2, "@Override public List<"), (10, 10, 2, "abstract int size();"), (11, 11, 2, "interface Inner {")]),
    ("cpp", CPP, [(2, 9, 1, "namespace app {"), (3, 3, 2, "struct Point {"), (4, 8, 2, "class Store : public B"), (6, 6, 3, "explicit Store(int n) "), (7, 7, 3, "int size() const {"), (10, 13, 1, "int app::run(const cha")]),
    ("go", GO, [(3, 3, 1, "const limit = 10"), (4, 7, 1, "var ( a = \"}\" b = 2 )"), (8, 10, 1, "type Store struct {"), (11, 15, 1, "func (s *Store) Load(i"), (16, 16, 1, "func main() {")]),
    ("rust", RUST, [(2, 2, 1, "pub struct Store<'a> {"), (3, 7, 1, "impl<'a> Store<'a> {"), (4, 6, 2, "pub async fn load(&sel"), (8, 8, 1, "mod inner {"), (9, 9, 1, "trait T {")]),
    ("csharp", CS, [(1, 7, 1, "namespace App {"), (2, 6, 2, "public class Store {"), (4, 4, 3, "public async Task<int>"), (5, 5, 3, "internal static int Tw")]),
    ("scala", SCALA, [(1, 8, 1, "object App {"), (2, 2, 2, "case class P(x: Int)"), (3, 3, 2, "def twice(x: Int): Int"), (4, 7, 2, "def many(x: Int): Int "), (5, 5, 3, "def deep = 1")]),
])
def test_nested_declarations(language, code, want):
    assert named(code, language) == want


def test_lines_outside_of_all():
    assert [(a, b) for a, b, h in outline(TS, "typescript") if not h] == [(1, 2), (20, 20), (31, 32)]
    assert outline("a\nb", "text") == [(1, 2, [])] and outline("", "python") == [(1, 1, [])] and outline(None, "go") == [(1, 1, [])]
    assert outline("x = 1\n", "python") == [(1, 2, [])]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(BLANKED)), st.lists(st.sampled_from(["class A {", "def f(x):", "func f() {", "fn g() {", "}", "{", "(", ")", "[", "'", '"', "`", '"""', "//", "/*", "*/", "#", "\n", "\n    ", "\n  ", " ", "x", ";", "=>", "int m() {", "@d", ":"]), max_size=40).map("".join))
def test_any_text(language, code):
    """Blanking keeps every place; ranges lie in the text, nest or follow, and cover every line."""
    assert len(blanked(code, language)) == len(code) and blanked(code, language).count("\n") == code.count("\n")
    got, n = outline(code, language), code.count("\n") + 1
    assert all(1 <= a <= b <= n for a, b, _ in got)
    assert [a for a, _, _ in got] == sorted(a for a, _, _ in got)
    assert {line for a, b, _ in got for line in range(a, b + 1)} == set(range(1, n + 1))
    for (a, b, h), (c, d, k) in zip(got, got[1:], strict=False):
        if len(k) > len(h) > 0:
            assert k[:len(h)] == h and a <= c and d <= b


def test_a_deep_and_a_wide_file_take_linear_time():
    deep = "".join("function f() {\n" for _ in range(3000)) + "}\n" * 3000
    wide = "class A {\n" + "  m(a) { return [1, (2)]; }\n" * 20_000 + "}\n"
    assert len(named(deep, "javascript")) == 3000 and len(named(wide, "javascript")) == 20_001
    assert len(named("def f():\n    pass\n" * 20_000, "python")) == 20_000


def test_chunks_carry_their_scopes(spark):
    rows = [("c", "a/s.ts", TS), ("c", "a/s.py", PY), ("c", "a/t.md", "# words\n\nmore"), ("c", "e.ts", ""), ("c", "n.ts", None)]
    files = spark.createDataFrame(rows, "corpus string, path string, content string")
    got = {(r["path"], r["start_line"], r["end_line"]): r for r in structure.structure_chunks(files).collect()}
    assert got["a/s.ts", 11, 18]["breadcrumbs"] == ["class Store", "async method load(id: string)"]
    assert got["a/s.ts", 3, 19]["breadcrumbs"] == ["class Store"] and got["a/s.ts", 1, 2]["breadcrumbs"] is None
    assert got["a/s.ts", 28, 28]["breadcrumbs"] == ["function outer(a, { b })", "function nested()"]
    assert got["a/s.py", 18, 21]["breadcrumbs"][1] == "function inner()" and got["a/s.py", 26, 27]["symbol_label"] == "function last()"
    assert got["a/t.md", 1, 3]["content"] == "# words\n\nmore" and not any(p in ("e.ts", "n.ts") for p, _, _ in got)
    parts = structure.split_structured(files, 60).where("path = 'a/s.ts' AND symbol_label LIKE '%load%'").orderBy("part").collect()
    assert len(parts) > 1 and len({r["symbol_id"] for r in parts}) == 1 and all(len(r["content"]) <= 60 for r in parts) and parts[0]["embed_text"].startswith("class Store > async method load")


def test_nothing_shuffles(spark):
    files = spark.createDataFrame([("c", "a.ts", TS)], "corpus string, path string, content string")
    assert "Exchange" not in structure.split_structured(files)._jdf.queryExecution().toString()


def test_index_with_scopes(spark):
    from quarry.functions.embedders import letter_vector
    from quarry.operators.state import fingerprint
    from quarry.plans import index
    from quarry.session import shared_dir
    root, now = shared_dir(spark, "structured"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    fp = fingerprint({"provider": "p", "model": "m", "dimension": 26, "store": "parquet", "schema_version": "hybrid_v3"})
    rows = [("c", "a/s.ts", TS, len(TS), 1), ("c", "a/s.py", PY, len(PY), 1)]
    schema = "corpus string, path string, content string, size long, mtime long"
    index.build(spark.createDataFrame(rows, schema), root, letter_vector, fp, now, "r1", split=index.structured_rows)
    held = index.load(spark, root)[0]
    assert held.where("size(breadcrumbs) = 2").count() == 7 and held.select("chunk_id").distinct().count() == held.count()
    later = [(*rows[0][:2], TS.replace("load", "fetch"), len(TS) + 1, 2), rows[1]]
    index.sync(spark.createDataFrame(later, schema), root, letter_vector, fp, now + F.expr("INTERVAL 1 HOUR"), "r2", split=index.structured_rows)
    assert {r["symbol_label"] for r in index.load(spark, root)[0].where("path = 'a/s.ts' AND symbol_label LIKE '%(id%'").collect()} == {"async method fetch(id: string)"}
