"""Chunking and embedding queries."""

from pyspark.sql import functions as F

from entries import views as V
from entries.search import _LET, _trim
from quarry.functions import embedders as M
from quarry.operators import chunking as C, structure as S

SIZE, OVER = 600, 80
# prose made to look like code: a line that opens with two words becomes a declaration header
CODE = """CASE WHEN path LIKE '%.py' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '{0}def {1}({2}):{3})
 WHEN path LIKE '%.go' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '{0}func {1}({2}) {{{3})
 WHEN path LIKE '%.ts' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '{0}export function {1}({2}) {{{3})
 WHEN path LIKE '%.js' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '{0}class {1} {2}{3}) ELSE content END"""
SPARK_CODE = CODE.format("$1", "$2", "$3", "'")
DUCK_CODE = CODE.format("\\1", "\\2", "\\3", "', 'g'")

c = V.CTE
c["code"] = f"SELECT * EXCLUDE (content), {DUCK_CODE} AS content, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' ELSE 'text' END AS language FROM files"


def packing(src, key, lens_cte, size):
    """Greedy packing as a recursive CTE over numbered units (key, i, n)."""
    return f"""SELECT {key}, i, n AS cur, 0 AS chunk_no FROM {lens_cte} WHERE i = 1 UNION ALL
      SELECT u.{key}, u.i, CASE WHEN p.cur > 0 AND p.cur + u.n > {size} THEN u.n ELSE p.cur + u.n END, p.chunk_no + CASE WHEN p.cur > 0 AND p.cur + u.n > {size} THEN 1 ELSE 0 END
      FROM {src} p JOIN {lens_cte} u ON u.{key} = p.{key} AND u.i = p.i + 1"""


c["ln0"] = "SELECT doc_id, corpus, path, string_split(content, chr(10)) AS ls FROM files"
c["ln"] = "SELECT doc_id, corpus, path, unnest(range(1, len(ls)+1)) AS line, len(ls) AS nl, ls FROM ln0"
c["ln2"] = "SELECT doc_id, corpus, path, line, ls[line] || CASE WHEN line < nl THEN chr(10) ELSE '' END AS t FROM ln"
c["pc"] = f"SELECT doc_id, corpus, path, line, j, substr(t, j*{SIZE}+1, {SIZE}) AS t FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(t)/{SIZE}.0) AS INTEGER)))) AS j FROM ln2)"
c["un"] = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, j) AS i, length(t) AS n FROM pc"
c["pk"] = packing("pk", "doc_id", "un", SIZE)
c["win"] = """SELECT doc_id, any_value(corpus) AS corpus, any_value(path) AS path, chunk_no, min(line) AS start_line, max(line) AS end_line, string_agg(t, '' ORDER BY i) AS content
  FROM pk JOIN un USING (doc_id, i) GROUP BY doc_id, chunk_no"""
c["win1"] = f"SELECT * FROM win WHERE {_trim('content')} <> ''"
WIN = ("files", "ln0", "ln", "ln2", "pc", "un", "pk", "win", "win1")
_TS = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function|interface|type|enum)\s+[A-Za-z_$]"
c["dl0"] = "SELECT doc_id, path, language, string_split(content, chr(10)) AS ls FROM code"
c["dl1"] = "SELECT doc_id, path, language, unnest(range(1, len(ls)+1)) AS line, ls FROM dl0"
c["dl2"] = rf"""SELECT doc_id, path, language, line, ls[line] AS t, CASE language WHEN 'typescript' THEN regexp_matches(ls[line], '{_TS}') WHEN 'javascript' THEN regexp_matches(ls[line], '^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class|function)\s+[A-Za-z_$]')
  WHEN 'python' THEN regexp_matches(ls[line], '^\s*(?:async\s+)?(?:def|class)\s+[A-Za-z_]') WHEN 'go' THEN regexp_matches(ls[line], '^\s*(?:func|type)\s+[A-Za-z_(]') ELSE false END AS head FROM dl1"""
c["dl3"] = "SELECT *, sum(CASE WHEN head OR line = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS chunk_no FROM dl2"
c["dl4"] = "SELECT doc_id, any_value(path) AS path, any_value(language) AS language, chunk_no, min(line) AS start_line, max(line) AS end_line, string_agg(t, chr(10) ORDER BY line) AS content, max(CASE WHEN head THEN t END) AS header FROM dl3 GROUP BY doc_id, chunk_no"
c["decl"] = rf"""SELECT *, CASE language WHEN 'python' THEN regexp_replace(regexp_replace({_trim("regexp_replace(header, '\\s+', ' ', 'g')")}, '\s*:$', ''), '^def ', 'function ')
  WHEN 'typescript' THEN 'function ' || regexp_extract(header, 'function ([A-Za-z]+)', 1) || regexp_extract(header, '(\([^)]*\))', 1) WHEN 'javascript' THEN 'class ' || regexp_extract(header, 'class ([A-Za-z]+)', 1) END AS symbol_label FROM dl4 WHERE {_trim('content')} <> ''""".replace("\\\\s", "\\s")
DECL = ("files", "code", "dl0", "dl1", "dl2", "dl3", "dl4", "decl")
# large declarations, cut again on whole lines
c["sl0"] = f"SELECT *, doc_id || '/' || chunk_no AS k, string_split(content, chr(10)) AS ls FROM decl"
c["sl1"] = "SELECT k, unnest(range(1, len(ls)+1)) AS line, len(ls) AS nl, ls FROM sl0"
c["sla"] = "SELECT k, line, ls[line] || CASE WHEN line < nl THEN chr(10) ELSE '' END AS t FROM sl1"
c["slb"] = f"SELECT k, line, j, substr(t, j*{SIZE}+1, {SIZE}) AS t FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(t)/{SIZE}.0) AS INTEGER)))) AS j FROM sla)"
c["sl2"] = "SELECT k, line, t, length(t) AS n, row_number() OVER (PARTITION BY k ORDER BY line, j) AS i, count(*) OVER (PARTITION BY k) AS nl FROM slb"
c["slp"] = packing("slp", "k", "sl2", SIZE)
c["sl3"] = f"SELECT k, CASE WHEN length(content) > {SIZE} THEN slp.chunk_no ELSE 0 END AS part, i, line, t, nl, length(content) > {SIZE} AS big FROM slp JOIN sl2 USING (k, i) JOIN sl0 USING (k)"
c["sl4"] = "SELECT k, part, min(line) AS i0, max(line) AS i1, max(i) AS last, any_value(nl) AS nl, any_value(big) AS big, string_agg(t, '' ORDER BY i) AS t FROM sl3 GROUP BY k, part"
c["large"] = f"""SELECT doc_id, chunk_no, part, symbol_label, start_line + i0 - 1 AS start_line, CASE WHEN big THEN start_line + i1 - 1 ELSE end_line END AS end_line,
  CASE WHEN big THEN {_trim('t')} ELSE t END AS content FROM sl4 JOIN (SELECT k, doc_id, chunk_no, symbol_label, start_line, end_line FROM sl0) USING (k) WHERE NOT (big AND last = nl AND {_trim('t')} = '')"""
LARGE = DECL + ("sl0", "sl1", "sla", "slb", "sl2", "slp", "sl3", "sl4", "large")


def code(s, sf):
    return V.files(s, sf).withColumn("content", F.expr("CASE WHEN path LIKE '%.py' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '$1def $2($3):') WHEN path LIKE '%.go' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '$1func $2($3) {') WHEN path LIKE '%.ts' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '$1export function $2($3) {') WHEN path LIKE '%.js' THEN regexp_replace(content, '(^|\\n)([A-Z][a-z]+) ([a-z]+)', '$1class $2 $3') ELSE content END"))


def L(x):
    return F.col(x).cast("long").alias(x)


def windows(s, sf, overlap=0):
    return C.chunk_windows(V.files(s, sf), SIZE, overlap)


def decl(s, sf):
    return C.chunk_declarations(code(s, sf))


def md5(x="content"):
    return F.md5(x).alias("md5")


def span(s, sf):
    """First and last line of a chunk, and the text of the first one read from the file itself."""
    w = windows(s, sf).select("doc_id", "path", L("chunk_no"), L("start_line"), L("end_line"))
    return w


def nested_code(s, sf):
    """Every document as a class with a method for each of its lines, which stands in a comment; brackets and quotes in it mean nothing."""
    d = V.t(s, sf, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("ts"), F.split("text", "\n", -1).alias("ls"))
    ts = F.transform("ls", lambda x, i: F.format_string("  m%d(a) {\n    // {}%s\n    return a;\n  }", i + 1, x))
    py = F.transform("ls", lambda x, i: F.format_string("    def m%d(a):\n        # (\"%s\n        return a", i + 1, x))
    name = F.concat(F.lit("class D"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.lit("c").alias("corpus"), F.when(F.col("ts"), "a.ts").otherwise("a.py").alias("path"),
                    F.when(F.col("ts"), F.concat(name, F.lit(" {\n"), F.array_join(ts, "\n"), F.lit("\n}"))).otherwise(F.concat(name, F.lit(":\n"), F.array_join(py, "\n"))).alias("content"))


def structured(s, sf):
    return S.structure_chunks(nested_code(s, sf)).select("doc_id", L("start_line"), L("end_line"), "symbol_label", F.array_join("breadcrumbs", " > ").alias("crumbs"), md5())


c["nl0"] = "SELECT doc_id, doc_id % 2 = 0 AS ts, string_split(text, chr(10)) AS ls FROM documents"
c["nl1"] = """SELECT doc_id, ts, i, CASE WHEN ts THEN '  m' || i || '(a) {' || chr(10) || '    // {}' || ls[i] || chr(10) || '    return a;' || chr(10) || '  }'
  ELSE '    def m' || i || '(a):' || chr(10) || '        # ("' || ls[i] || chr(10) || '        return a' END AS body, len(ls) AS n FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM nl0)"""
c["nl2"] = """SELECT doc_id, 1 AS start_line, any_value(CASE WHEN ts THEN 4 * n + 2 ELSE 3 * n + 1 END) AS end_line, 'class D' || doc_id AS symbol_label, 'class D' || doc_id AS crumbs,
  md5('class D' || doc_id || any_value(CASE WHEN ts THEN ' {' ELSE ':' END) || chr(10) || string_agg(body, chr(10) ORDER BY i) || any_value(CASE WHEN ts THEN chr(10) || '}' ELSE '' END)) AS md5 FROM nl1 GROUP BY doc_id
  UNION ALL SELECT doc_id, CASE WHEN ts THEN 4 * i - 2 ELSE 3 * i - 1 END, CASE WHEN ts THEN 4 * i + 1 ELSE 3 * i + 1 END, CASE WHEN ts THEN 'method m' ELSE 'function m' END || i || '(a)',
    'class D' || doc_id || ' > ' || CASE WHEN ts THEN 'method m' ELSE 'function m' END || i || '(a)', md5(body) FROM nl1"""

QUERIES = {
    "chunk_structure": structured,
    "chunk_windows": lambda s, sf: windows(s, sf).select("doc_id", L("chunk_no"), F.length("content").cast("long").alias("n"), md5()),
    "chunk_line_span": span,
    "chunk_declarations": lambda s, sf: decl(s, sf).select("doc_id", L("chunk_no"), L("start_line"), L("end_line"), md5()),
    "symbol_label": lambda s, sf: decl(s, sf).select("doc_id", L("chunk_no"), "symbol_label"),
    "chunk_split_large": lambda s, sf: C.split_large(decl(s, sf), SIZE).select("doc_id", L("chunk_no"), L("part"), L("start_line"), L("end_line"), "symbol_label", md5()),
    "chunk_overlap": lambda s, sf: windows(s, sf, OVER).select("doc_id", L("chunk_no"), L("start_line"), L("overlap_start"), md5("embed_text")),
    "embed_chunks": lambda s, sf: V.files(s, sf).select("doc_id", F.posexplode(F.concat(M.keyword_vector(F.col("content")), M.letter_vector(F.col("content")))).alias("pos", "v")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("dim"), F.round(F.sum(F.col("v") * (F.col("pos") + 1)), 6).alias("weighted")),
    "embed_dimension_check": lambda s, sf: M.wrong_dimension(V.vectors(s, sf), "vector", 64).groupBy().agg(F.count(F.lit(1)).alias("wrong")),
}
_KW = "[" + ",".join(f"CASE WHEN regexp_matches(lower(content), '{g}') THEN 1.0::DOUBLE ELSE 0::DOUBLE END" for g in M.KEYWORD_GROUPS) + ", least(1.0::DOUBLE, length(content)/200.0::DOUBLE)]"
SQL = {
    "chunk_structure": V.sql("SELECT doc_id, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, symbol_label, crumbs, md5 FROM nl2", "nl0", "nl1", "nl2"),
    "chunk_windows": V.sql("SELECT doc_id, chunk_no::BIGINT AS chunk_no, length(content) AS n, md5(content) AS md5 FROM win1", *WIN, recursive=True),
    "chunk_line_span": V.sql("SELECT doc_id, path, chunk_no::BIGINT AS chunk_no, start_line, end_line FROM win1", *WIN, recursive=True),
    "chunk_declarations": V.sql("SELECT doc_id, chunk_no::BIGINT AS chunk_no, start_line, end_line, md5(content) AS md5 FROM decl", *DECL),
    "symbol_label": V.sql("SELECT doc_id, chunk_no::BIGINT AS chunk_no, symbol_label FROM decl", *DECL),
    "chunk_split_large": V.sql("SELECT doc_id, chunk_no::BIGINT AS chunk_no, part::BIGINT AS part, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, symbol_label, md5(content) AS md5 FROM large", *LARGE, recursive=True),
    "chunk_overlap": V.sql(f"""SELECT doc_id, chunk_no::BIGINT AS chunk_no, start_line, CASE WHEN o IS NULL THEN start_line ELSE greatest(1, start_line - (length(o) - length(replace(o, chr(10), '')) + 1)) END AS overlap_start,
      md5(CASE WHEN o IS NULL THEN content ELSE o || chr(10) || content END) AS md5 FROM (SELECT *, right(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_no), {OVER}) AS o FROM win1)""", *WIN, recursive=True),
    "embed_chunks": V.sql(f"SELECT doc_id, count(*) AS dim, round(sum(v * i), 6) AS weighted FROM (SELECT doc_id, unnest(e) AS v, unnest(range(1, len(e)+1)) AS i FROM (SELECT doc_id, list_concat({_KW}, {_LET('content')}) AS e FROM files)) GROUP BY doc_id", "files"),
    "embed_dimension_check": "SELECT count(*) AS wrong FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64",
}
