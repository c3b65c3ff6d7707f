"""Symbol graph queries."""

from pyspark.sql import functions as F

from entries import views as V
from quarry.operators import graph as G
from quarry.plans import graph_index
from quarry.session import cut_lineage, shared_dir

c = V.CTE
L = lambda x, n=None: F.col(x).cast("long").alias(n or x)
CODE = """CASE WHEN path LIKE '%.py' THEN regexp_replace(t, '^([A-Za-z]+) ([a-z]+)', 'from m import {0}, {1} as x, ')
 WHEN path LIKE '%.ts' THEN regexp_replace(t, '^([A-Za-z]+) ([a-z]+)', 'import {{{0}, {1} as x}} from "m" ') ELSE t END"""

# --- DuckDB side ------------------------------------------------------------------------------
c["gfiles"] = f"SELECT corpus, path, {CODE.format(chr(92)+'1', chr(92)+'2')} AS content FROM (SELECT corpus, path, regexp_replace(content, '([A-Za-z]+)([.,])', '\\1()\\2', 'g') AS t FROM files)"
# files that a graph is built from
c["gchunks"] = r"SELECT * FROM chunks WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|mjs|cjs|py)$') AND NOT regexp_matches(path, '(^|/)(node_modules|\.git|dist|build|coverage|\.next)/')"
c["nodes"] = "SELECT corpus, symbol_id, symbol_label, path AS file, language, start_line, end_line FROM gchunks WHERE symbol_id IS NOT NULL"
_NAME = "[A-Za-z_$][A-Za-z0-9_$]*"
c["sidx"] = f"""SELECT *, lower(CASE WHEN symbol_label LIKE 'class %' THEN regexp_extract(symbol_label, '^class ({_NAME})', 1) ELSE regexp_extract(symbol_label, '^function ({_NAME})\\(', 1) END) AS name FROM nodes"""
c["glines0"] = r"SELECT corpus, path AS file, regexp_split_to_array(content, '\r?\n') AS ls FROM gfiles"
c["glines1"] = "SELECT corpus, file, unnest(range(1, len(ls)+1)) AS line, ls FROM glines0"
c["glines"] = """SELECT n.corpus, n.symbol_id AS src, n.file, n.language, l.line, CASE WHEN n.language='python' THEN regexp_replace(ls[l.line], '#.*$', '') ELSE regexp_replace(ls[l.line], '//.*$', '') END AS text
  FROM nodes n JOIN glines1 l ON l.corpus=n.corpus AND l.file=n.file AND l.line BETWEEN n.start_line AND n.end_line"""
_KW = "('if', 'for', 'while', 'switch', 'catch', 'return', 'new', 'typeof', 'function', 'class', 'def', 'await', 'with', 'from', 'import')"
c["sites0"] = rf"""SELECT DISTINCT corpus, src, file, line, text, lower(unnest(regexp_extract_all(text, '\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1))) AS name, 'call' AS kind FROM glines
  UNION SELECT DISTINCT corpus, src, file, line, text, lower(unnest(regexp_extract_all(text, '{_NAME}\.({_NAME})\s*\(', 1))), 'dynamic' FROM glines
  UNION SELECT DISTINCT corpus, src, file, line, text, 'getattr', 'dynamic' FROM glines WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9_])getattr\s*\(')"""
c["calls"] = rf"""SELECT corpus, src, file, line, name, kind FROM sites0 WHERE name NOT IN {_KW}
  AND NOT regexp_matches(text, '(?:^|[^A-Za-z0-9_])(?:function|class|def)\s+' || regexp_escape(name) || '(?:[^A-Za-z0-9_]|$)', 'i')
  AND NOT regexp_matches(text, '(?:^|[^A-Za-z0-9_])' || regexp_escape(name) || '\s*\([^)]*\)\s*(?:=>|\{{)', 'i')"""
c["imports"] = r"""SELECT DISTINCT corpus, src, file, line, name, 'import' AS kind FROM (
  SELECT corpus, src, file, line, true AS py, lower(trim(regexp_split_to_array(trim(unnest(string_split(regexp_extract(text, '^\s*from\s+[^\s]+\s+import\s+(.+)$', 1), ','))), '(?i)\s+as\s+')[1])) AS name FROM glines WHERE language='python'
  UNION ALL SELECT corpus, src, file, line, false, lower(unnest(regexp_split_to_array(regexp_replace(regexp_extract(text, '^\s*import\s+(.+)\s+from\s+["\x27][^"\x27]+["\x27]', 1), '[{}*]', ' ', 'g'), '[\s,]+'))) FROM glines WHERE language <> 'python') WHERE name <> '' AND (py OR name <> 'as')"""
c["allsites"] = "SELECT * FROM calls UNION ALL SELECT * FROM imports"
c["resolved"] = """SELECT s.*, t.symbol_id AS dst, t.file AS dst_file FROM allsites s LEFT JOIN sidx t ON t.corpus=s.corpus AND t.name=s.name
  QUALIFY row_number() OVER (PARTITION BY s.corpus, s.src, s.file, s.line, s.name, s.kind ORDER BY CASE WHEN t.file=s.file THEN 0 ELSE 1 END, abs(t.start_line-s.line), t.file, t.start_line, t.symbol_label, t.symbol_id) = 1"""
c["edges"] = """SELECT corpus, src, dst, kind, file, line, max(CASE kind WHEN 'call' THEN CASE WHEN dst_file=file THEN 0.92 ELSE 0.78 END WHEN 'dynamic' THEN CASE WHEN dst_file=file THEN 0.72 ELSE 0.62 END
  ELSE CASE WHEN dst_file=file THEN 0.65 ELSE 0.55 END END::DOUBLE) AS confidence FROM resolved WHERE dst IS NOT NULL GROUP BY corpus, src, dst, kind, file, line"""
c["notes"] = """SELECT DISTINCT corpus, CASE WHEN kind='dynamic' THEN 'dynamic_edge' ELSE 'unresolved_edge' END AS type, file, line, src AS symbol_id, 'could not resolve ' || name || '() from ' || src AS detail FROM resolved WHERE dst IS NULL AND kind <> 'import'"""
c["missing"] = "SELECT corpus, 'missing_symbol_metadata' AS type, path AS file, start_line AS line, CAST(NULL AS VARCHAR) AS symbol_id, 'no symbol for ' || path || ':' || start_line || '-' || end_line AS detail FROM gchunks WHERE symbol_id IS NULL"
NODES = ("chunks0", "chunks1", "chunks", "gchunks", "nodes")
LINES = ("files",) + NODES + ("gfiles", "glines0", "glines1", "glines")
CALLS = LINES + ("sites0", "calls")
EDGES = LINES + ("sidx", "sites0", "calls", "imports", "allsites", "resolved", "edges")
c["adj"] = """SELECT corpus, src AS sym, 0 AS dir, dst AS peer, src||'|'||dst||'|'||kind||'|'||lpad(CAST(line AS VARCHAR),9,'0')||'|'||file AS ek FROM edges
  UNION ALL SELECT corpus, dst, 1, src, src||'|'||dst||'|'||kind||'|'||lpad(CAST(line AS VARCHAR),9,'0')||'|'||file FROM edges"""
_SEED = ("symbol_id AS seed_id", "corpus", "symbol_id", "CASE length(symbol_label) % 3 WHEN 0 THEN 'callers' WHEN 1 THEN 'callees' ELSE 'both' END AS direction",
         "CAST(1 + length(symbol_label) % 3 AS INT) AS depth", "CAST(4 + length(symbol_label) % 47 AS INT) AS edge_limit")
c["seeds"] = "SELECT " + ", ".join(_SEED) + " FROM nodes"
c["f1"] = "SELECT seed_id, symbol_id AS sym, 1 AS pos FROM seeds"
c["s0"] = "SELECT CAST(NULL AS VARCHAR) AS seed_id, CAST(NULL AS VARCHAR) AS ek, CAST(NULL AS VARCHAR) AS peer, CAST(NULL AS BIGINT) AS found WHERE false"


def _level(n):
    """Edges found at level n (s<n> holds all up to n) and the frontier of level n+1."""
    c[f"c{n}"] = f"""SELECT f.seed_id, f.pos, a.dir, a.ek, a.peer, d.edge_limit FROM f{n} f JOIN seeds d USING (seed_id) JOIN adj a ON a.corpus=d.corpus AND a.sym=f.sym
      AND (d.direction='both' OR a.dir = CASE WHEN d.direction='callees' THEN 0 ELSE 1 END) WHERE d.depth >= {n} AND NOT EXISTS (SELECT 1 FROM s{n-1} s WHERE s.seed_id=f.seed_id AND s.ek=a.ek)"""
    c[f"u{n}"] = f"SELECT * FROM c{n} QUALIFY row_number() OVER (PARTITION BY seed_id, ek ORDER BY pos, dir) = 1"
    c[f"r{n}"] = f"""SELECT u.*, coalesce(k.n, 0) + row_number() OVER (PARTITION BY u.seed_id ORDER BY pos, dir, ek) AS found FROM u{n} u LEFT JOIN (SELECT seed_id, count(*) AS n FROM s{n-1} GROUP BY seed_id) k ON k.seed_id=u.seed_id"""
    c[f"s{n}"] = f"SELECT seed_id, ek, peer, found FROM s{n-1} UNION ALL SELECT seed_id, ek, peer, found FROM r{n} WHERE found <= edge_limit"
    c[f"f{n+1}"] = f"""SELECT seed_id, peer AS sym, row_number() OVER (PARTITION BY seed_id ORDER BY min(found)) AS pos FROM r{n} r WHERE found <= edge_limit AND peer <> seed_id
      AND NOT EXISTS (SELECT 1 FROM s{n-1} s WHERE s.seed_id=r.seed_id AND (split_part(s.ek,'|',1) = r.peer OR split_part(s.ek,'|',2) = r.peer)) GROUP BY seed_id, peer"""
    return (f"c{n}", f"u{n}", f"r{n}", f"s{n}", f"f{n+1}")


WALK = EDGES + ("adj", "seeds", "f1", "s0") + _level(1) + _level(2) + _level(3)
c["visited"] = "SELECT seed_id, seed_id AS symbol_id FROM seeds UNION SELECT seed_id, split_part(ek,'|',1) FROM s3 UNION SELECT seed_id, split_part(ek,'|',2) FROM s3"
c["vfiles"] = "SELECT v.seed_id, n.corpus, n.file FROM visited v JOIN nodes n USING (symbol_id) UNION SELECT s.seed_id, d.corpus, split_part(ek,'|',5) FROM s3 s JOIN seeds d USING (seed_id)"
c["allnotes"] = "SELECT * FROM notes UNION ALL SELECT * FROM missing"
c["gnotes"] = """SELECT v.seed_id, n.* FROM vfiles v JOIN allnotes n ON n.corpus=v.corpus AND n.file=v.file WHERE n.symbol_id IS NULL OR EXISTS (SELECT 1 FROM visited x WHERE x.seed_id=v.seed_id AND x.symbol_id=n.symbol_id)"""
NOTES = WALK + ("visited", "vfiles", "notes", "missing", "allnotes", "gnotes")


# --- Spark side -------------------------------------------------------------------------------
def as_code(files):
    return files.withColumn("t", F.regexp_replace("content", "([A-Za-z]+)([.,])", "$1()$2")).select(
        "corpus", "path", "lang", F.expr(CODE.format("$1", "$2")).alias("content"))


def gfiles(s, sf):
    return as_code(V.files(s, sf)).drop("lang")


def chunks(s, sf):
    return G.in_graph(V.chunks(s, sf))


def nodes(s, sf):
    return G.symbol_nodes(chunks(s, sf))


def lines(s, sf):
    return G.source_lines(nodes(s, sf), gfiles(s, sf))


def sites(s, sf):
    return G.extract_sites(lines(s, sf))


def resolved(s, sf):
    return G.resolve(cut_lineage(sites(s, sf), "sites"), nodes(s, sf))


def graph(s, sf):
    return G.build_graph(V.chunks(s, sf), gfiles(s, sf))


def walk(graph):
    """Every node of a graph (nodes, edges, …) is a seed."""
    return G.traverse(graph[0].selectExpr(*_SEED), graph[1])


def walk_nodes(s, sf):
    g = graph(s, sf)
    return G.traversal_nodes(walk(g), g[0])


def notes(s, sf):
    n, e, found = graph(s, sf)
    return G.graph_notes(cut_lineage(walk((n, e)), "walk"), n, found, 10).select(
        "seed_id", L("rank"), "type", "file", L("line"), "symbol_id", L("total"), "truncated")


# one request per file: whole files, windows, open windows, swapped windows
REQ = ("doc_id AS request_id", "corpus", "path AS file", "CAST(CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE NULL END AS INT) AS window_start",
       "CAST(CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 1 END AS INT) AS window_end")


def folded(s, sf):
    """Files by language and source, so that one of them holds many symbols."""
    return nodes(s, sf).withColumn("file", F.concat("language", F.lit("/all")))


def outline(s, sf):
    r = V.files(s, sf).selectExpr(*REQ)
    miss = G.missing_symbol_notes(chunks(s, sf))
    return G.outline(r, nodes(s, sf), miss).select("request_id", "symbol_id", "label", L("rank"), L("start_line"), L("end_line"), "has_more", L("missing"))


def outline_folded(s, sf):
    r = folded(s, sf).select("corpus", "file").distinct().selectExpr("corpus || ':' || file AS request_id", "corpus", "file", "cast(NULL AS int) AS window_start", "cast(NULL AS int) AS window_end")
    return G.outline(r, folded(s, sf), None, 5).select("request_id", "symbol_id", L("rank"), "has_more")


def exact(s, sf):
    r = folded(s, sf).selectExpr("symbol_id AS request_id", "corpus", "file", "CASE WHEN symbol_label LIKE 'class%' THEN symbol_id END AS want_id",
                                 "CASE WHEN symbol_label LIKE 'class%' THEN NULL WHEN end_line > 30 THEN symbol_label || '!' ELSE symbol_label END AS want_label")
    return G.symbol_exact(r, folded(s, sf)).select("request_id", "status", L("matches"), "symbol_id", L("start_line"), L("end_line"))


def spans(s, sf):
    r = V.files(s, sf).selectExpr("doc_id AS request_id", "corpus", "path", "CAST(CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE NULL END AS INT) AS start",
                                  "CAST(CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 12 ELSE 7 END AS INT) AS end")
    return G.read_spans(r, V.files(s, sf), 10).select("request_id", L("total"), L("first_line"), L("last_line"), L("next_start"), F.md5("text").alias("md5"))


def stored(s, sf):
    """A graph built from an older state of the files and synced: index.ts files were not there, French ones had another text and
    symbol, and copies of the English Python files have gone since."""
    # the chunk table is written once; texts are read for the sites of the build, and the changed ones for the sync
    root, files = shared_dir(s, "graph"), V.files(s, sf)
    now = cut_lineage(V.chunks(s, sf).drop("content"), "chunks")
    lang = cut_lineage(files.select("corpus", "path", "lang"), "lang")
    french, gone = F.col("lang") == "fr", F.concat(F.lit("gone/"), "path")
    old = now.join(lang, ["corpus", "path"]).where("path NOT LIKE '%/index.ts'").withColumn(
        "symbol_label", F.when(french & F.col("symbol_label").isNotNull(), F.lit("function the()")).otherwise(F.col("symbol_label")))
    copied, touched = "lang = 'en' AND path LIKE '%.py'", "lang = 'fr' OR path LIKE '%/index.ts'"
    both = F.when(F.expr(copied), F.array("path", gone)).otherwise(F.array("path"))
    text = as_code(G.in_graph(files)).withColumn("content", F.when(french, F.upper("content")).otherwise(F.col("content")))
    text = text.select("corpus", F.explode(both).alias("path"), "content")
    removed = old.where(copied).withColumn("path", gone).withColumns({c: F.concat(F.lit("g"), c) for c in ("symbol_id", "chunk_id")})
    graph_index.build(old.unionByName(removed), text, root)
    changed = lang.where(touched).unionByName(lang.where(copied).withColumn("path", gone))
    graph_index.sync(now, as_code(G.in_graph(files).where(touched)).drop("lang"), changed, root)
    return graph_index.load(s, root)


def stored_walk(s, sf):
    return walk(stored(s, sf))


QUERIES = {
    "graph_sync_nodes": lambda s, sf: stored(s, sf)[0].select("corpus", "symbol_id", "symbol_label", "file", "language", L("start_line"), L("end_line")),
    "graph_sync_edges": lambda s, sf: stored(s, sf)[1].select("corpus", "src", "dst", "kind", "file", L("line"), "confidence"),
    "graph_sync_notes": lambda s, sf: stored(s, sf)[2].where("type <> 'missing_symbol_metadata'").select("corpus", "type", "file", L("line"), "symbol_id", "detail"),
    "graph_stored_traverse": lambda s, sf: G.traversal_edges(stored_walk(s, sf)).select("seed_id", (F.col("found") + 1).cast("long").alias("found"), "src", "dst", "kind", L("line"), "file"),
    "symbol_nodes": lambda s, sf: nodes(s, sf).select("corpus", "symbol_id", "symbol_label", "file", "language", L("start_line"), L("end_line")),
    "missing_symbol_notes": lambda s, sf: G.missing_symbol_notes(chunks(s, sf)).select("corpus", "type", "file", L("line"), "detail"),
    "symbol_index": lambda s, sf: G.symbol_index(nodes(s, sf)).select("corpus", "name", "symbol_id", "file"),
    "extract_calls": lambda s, sf: G.extract_calls(lines(s, sf)).select("corpus", "src", "file", L("line"), "name", "kind"),
    "extract_imports": lambda s, sf: G.extract_imports(lines(s, sf)).select("corpus", "src", "file", L("line"), "name", "kind"),
    "resolve_edges": lambda s, sf: G.edges(resolved(s, sf)).select("corpus", "src", "dst", "kind", "file", L("line"), "confidence"),
    "unresolved_notes": lambda s, sf: G.unresolved_notes(resolved(s, sf)).select("corpus", "type", "file", L("line"), "symbol_id", "detail"),
    "graph_traverse": lambda s, sf: G.traversal_edges(walk(graph(s, sf))).select("seed_id", (F.col("found") + 1).cast("long").alias("found"), "src", "dst", "kind", L("line"), "file"),
    "graph_traverse_nodes": lambda s, sf: walk_nodes(s, sf).select("seed_id", "symbol_id", "file"),
    "graph_notes": notes,
    "symbol_outline": outline,
    "symbol_outline_paged": outline_folded,
    "symbol_exact": exact,
    "read_spans": spans,
}
SQL = {
    "symbol_nodes": V.sql("SELECT corpus, symbol_id, symbol_label, file, language, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM nodes", *NODES),
    "missing_symbol_notes": V.sql("SELECT corpus, type, file, line::BIGINT AS line, detail FROM missing", *NODES, "missing"),
    "symbol_index": V.sql("SELECT corpus, name, symbol_id, file FROM sidx", *NODES, "sidx"),
    "extract_calls": V.sql("SELECT corpus, src, file, line, name, kind FROM calls", *CALLS),
    "extract_imports": V.sql("SELECT corpus, src, file, line, name, kind FROM imports", *LINES, "imports"),
    "resolve_edges": V.sql("SELECT corpus, src, dst, kind, file, line, confidence FROM edges", *EDGES),
    "unresolved_notes": V.sql("SELECT corpus, type, file, line, symbol_id, detail FROM notes", *EDGES[:-1], "notes"),
    "graph_traverse": V.sql("SELECT seed_id, found, split_part(ek,'|',1) AS src, split_part(ek,'|',2) AS dst, split_part(ek,'|',3) AS kind, CAST(split_part(ek,'|',4) AS BIGINT) AS line, split_part(ek,'|',5) AS file FROM s3", *WALK),
    "graph_traverse_nodes": V.sql("SELECT seed_id, symbol_id, file FROM visited JOIN nodes USING (symbol_id)", *WALK, "visited"),
    "graph_notes": V.sql("""SELECT seed_id, rank, type, file, line::BIGINT AS line, symbol_id, total, total > 10 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY file, type, symbol_id NULLS LAST, line, sha1(detail)) AS rank, count(*) OVER (PARTITION BY seed_id) AS total FROM gnotes) WHERE rank <= 10""", *NOTES),
    "symbol_outline": V.sql("""SELECT request_id, symbol_id, symbol_label AS label, row_number() OVER (PARTITION BY request_id ORDER BY start_line, end_line, symbol_label, symbol_id) AS rank, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, false AS has_more,
      (SELECT count(*) FROM missing m WHERE m.corpus=r.corpus AND m.file=r.file) AS missing FROM (SELECT """ + ", ".join(REQ) + """ FROM files) r JOIN nodes n USING (corpus, file)
      WHERE start_line <= coalesce(CASE WHEN window_start IS NOT NULL THEN greatest(window_start, window_end) ELSE window_end END, 1000000) AND end_line >= coalesce(window_start, 0)""", "files", *NODES, "missing"),
    "symbol_outline_paged": V.sql("""SELECT corpus || ':' || language || '/all' AS request_id, symbol_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY corpus, language) > 5 AS has_more FROM nodes
      WINDOW w AS (PARTITION BY corpus, language ORDER BY start_line, end_line, symbol_label, symbol_id) QUALIFY row_number() OVER w <= 5""", *NODES),
    "symbol_exact": V.sql("""SELECT r.symbol_id AS request_id, CASE WHEN count(n.symbol_id)=0 THEN 'not_found' WHEN count(n.symbol_id)=1 THEN 'ok' ELSE 'ambiguous' END AS status, count(n.symbol_id) AS matches,
      CASE WHEN count(n.symbol_id)=1 THEN min(n.symbol_id) END AS symbol_id, CASE WHEN count(n.symbol_id)=1 THEN min(n.start_line)::BIGINT END AS start_line, CASE WHEN count(n.symbol_id)=1 THEN min(n.end_line)::BIGINT END AS end_line
      FROM nodes r LEFT JOIN nodes n ON n.corpus=r.corpus AND n.language=r.language AND CASE WHEN r.symbol_label LIKE 'class%' THEN n.symbol_id=r.symbol_id WHEN r.end_line > 30 THEN n.symbol_label = r.symbol_label || '!' ELSE n.symbol_label=r.symbol_label END GROUP BY r.symbol_id""", *NODES),
    "read_spans": V.sql(r"""SELECT request_id, total, a AS first_line, b AS last_line, CASE WHEN e IS NULL AND b < total THEN b+1 END AS next_start, md5(array_to_string(list_slice(ls, a, b), chr(10))) AS md5 FROM (
      SELECT *, CASE m WHEN 1 THEN least(3,total) ELSE 1 END AS a, CASE m WHEN 0 THEN least(total,10) WHEN 1 THEN least(least(3,total)+9,total) WHEN 2 THEN least(12,total) ELSE least(7,total) END AS b, CASE WHEN m >= 2 THEN 1 END AS e FROM (
      SELECT request_id, m, ls, len(ls) AS total FROM (SELECT doc_id AS request_id, doc_id % 4 AS m, CASE WHEN l[len(l)] = '' THEN list_slice(l,1,len(l)-1) ELSE l END AS ls FROM (SELECT doc_id, regexp_split_to_array(content, '\r?\n') AS l FROM files))))""", "files"),
}
SQL |= {"graph_sync_nodes": SQL["symbol_nodes"], "graph_sync_edges": SQL["resolve_edges"], "graph_sync_notes": SQL["unresolved_notes"], "graph_stored_traverse": SQL["graph_traverse"]}
