"""Scalar columns and path filters."""

from pyspark.sql import functions as F

from entries import views as V
from entries.search import CATEGORY, NOISE, NOW
from quarry.functions import fixed as X, paths as P, text as T
from quarry.functions.ignore_rules import is_ignored, layered
from quarry.sources import corpus as C

B = "chr(92)"
# messy paths: back slashes, dot segments, doubled slashes, parents, trailing slashes
RAW = f"""CASE doc_id % 7 WHEN 0 THEN '  ./' || path WHEN 1 THEN '/' || path || '/' WHEN 2 THEN replace(path, '/', {B})
 WHEN 3 THEN replace(path, '/', '//') WHEN 4 THEN 'a/../' || path WHEN 5 THEN './' || replace(path, '/', '/./') ELSE './.' END"""
RULES = ["# build output", "", "dist/", "*.bin", "src/__fixtures__/**", "!src/__fixtures__/f_1*.ts", "lib/*.go", "docs/**/doc_2*.md", "*.bin"]
IGNORED = (r"(regexp_matches(path, '(^|/)dist/.') OR regexp_matches(path, '\.bin$') OR (starts_with(path, 'src/__fixtures__/') AND NOT regexp_matches(path, '^src/__fixtures__/f_1[^/]*\.ts$'))"
           r" OR regexp_matches(path, '^lib/[^/]*\.go$') OR regexp_matches(path, '^docs/(.*/)?doc_2[^/]*\.md$'))")
EXT = r"regexp_extract(path, '(\.[^./]+)$', 1)"
ALLOWED = "('.ts', '.tsx', '.js', '.jsx', '.py', '.java', '.cpp', '.c', '.h', '.hpp', '.cs', '.go', '.rs', '.php', '.rb', '.swift', '.kt', '.scala', '.m', '.mm', '.md', '.markdown', '.ipynb')"
HIDDEN = r"regexp_matches(path, '(^|/)\.')"
DIM = ",".join(f"('{lang}','{e}',{str(a).lower()},{str(s).lower()})" for lang, es, a, s in X.LANGUAGES for e in es)

V.CTE["lang_dim"] = f"SELECT * FROM (VALUES {DIM}) v(language, ext, splitter, symbols)"


def f(s, sf):
    return V.files(s, sf)


def scopes(s, sf):
    """Scope stack of a document: its source, then its lines."""
    return V.t(s, sf, "documents").select("doc_id", F.concat(F.array("source", "source"), F.split("text", "\n")).alias("scopes"))


def metadata(s, sf):
    e = V.t(s, sf, "events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN substr(props, 2) ELSE props END AS js")
    return e.select("event_id", T.parse_metadata(F.col("js"), "k bigint").getField("k").alias("k"))


def stale(s, sf):
    e = V.t(s, sf, "events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN 'n/a' ELSE cast(ts AS string) END AS at")
    return e.select("event_id", T.staleness(F.col("at"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("bucket"))


ROOT_RULES = {0: "# own\ndocs/\nsrc/**/index.ts\n\n!docs/\n!dist", 1: "*.test.ts\n!src/auth/mod_1*\n*.test.ts\n!lib/", 2: "/src/core\r\npkg/*/mod_?.py\nmod_*[13].p[!x]"}


def root_rules(s, sf):
    """Every corpus has ignore files of its own at its root; a third of them the same."""
    f_ = f(s, sf).select("doc_id", "corpus", "path", "content", "size")
    n = F.pmod(F.regexp_extract("corpus", "([0-9]+)", 1).cast("int"), F.lit(3))
    text = F.when(n == 0, ROOT_RULES[0]).when(n == 1, ROOT_RULES[1]).otherwise(ROOT_RULES[2])
    own = f_.select("corpus").distinct().select(F.lit(None).cast("bigint").alias("doc_id"), "corpus", F.lit(".gitignore").alias("path"), text.alias("content"), F.lit(1).cast("bigint").alias("size"))
    return C.discover(f_, ["lib/"], corpus_rules=C.root_rules(f_.unionByName(own), before=layered(X.DEFAULT_IGNORE_RULES, ["lib/"]))).select("doc_id", "path")


QUERIES = {
    "ignore_layers": root_rules,
    "corpus_scan": lambda s, sf: C.discover(f(s, sf), RULES).select("doc_id", "path", "size"),
    "ignore_filter": lambda s, sf: f(s, sf).select("doc_id", "path", is_ignored(F.col("path"), RULES).alias("ignored")),
    "ignore_defaults": lambda s, sf: f(s, sf).select("path").where(~is_ignored(F.col("path"), X.DEFAULT_IGNORE_RULES)),
    "extension_filter": lambda s, sf: f(s, sf).where(P.has_extension(F.col("path"), ["bin"])).select("doc_id", P.extension(F.col("path")).alias("ext")),
    "hidden_filter": lambda s, sf: f(s, sf).where(~P.is_hidden(F.col("path"))).select("doc_id", "path"),
    "corpus_key": lambda s, sf: f(s, sf).select("doc_id", T.corpus_key(F.concat(F.lit("/repos/"), "corpus")).alias("hybrid_key"), T.corpus_key(F.concat(F.lit("/repos/"), "corpus"), False).alias("dense_key")),
    "path_normalize": lambda s, sf: f(s, sf).select("doc_id", P.normalize_path(F.expr(RAW)).alias("norm")),
    "language_tag": lambda s, sf: f(s, sf).select("doc_id", P.language_of(P.extension(F.col("path"))).alias("language")),
    "language_capability": lambda s, sf: C.capability_report(f(s, sf)),
    "path_category": lambda s, sf: f(s, sf).select("doc_id", P.path_category(F.col("path")).alias("category")),
    "noise_category": lambda s, sf: f(s, sf).select("doc_id", P.noise_category(F.col("path")).alias("category")),
    "staleness_bucket": stale,
    "chunk_id": lambda s, sf: V.chunks(s, sf).select("doc_id", T.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("id")),
    "symbol_id": lambda s, sf: V.chunks(s, sf).select("doc_id", T.symbol_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol_label")).alias("id")),
    "embed_text_prepare": lambda s, sf: V.t(s, sf, "documents").select("doc_id", F.md5(T.embed_text(F.col("text"), 512)).alias("text_md5"), T.token_estimate(F.col("text")).alias("tokens")),
    "rerank_document": lambda s, sf: V.chunks(s, sf).select("doc_id", F.md5(T.rerank_document(F.col("path"), F.col("language"), F.col("symbol_label"), F.col("content"))).alias("doc_md5")),
    "preview": lambda s, sf: V.t(s, sf, "documents").select("doc_id", F.md5(T.preview(F.col("text"))).alias("preview_md5")),
    "breadcrumbs": lambda s, sf: scopes(s, sf).select("doc_id", F.concat_ws(" > ", T.breadcrumbs(F.col("scopes"))).alias("crumbs")),
    "metadata_parse": metadata,
}

_SQ = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
_DEF_RX = r"(^|/)(node_modules|dist|build|out|target|coverage|logs|tmp|temp|__pycache__|\.nyc_output|\.vscode|\.idea|\.git|\.svn|\.hg|\.pytest_cache)(/|$)|^\.cache/."
_N = "CAST(regexp_extract(corpus, '([0-9]+)', 1) AS INTEGER) % 3"
SQL = {
    "ignore_layers": V.sql(rf"""SELECT doc_id, path FROM files WHERE {EXT} IN {ALLOWED} AND NOT {HIDDEN} AND NOT (regexp_matches(path, '{_DEF_RX}') AND NOT ({_N} = 0 AND starts_with(path, 'pkg/dist/')))
      AND NOT (starts_with(path, 'lib/') AND {_N} <> 1)
      AND NOT ({_N} = 0 AND regexp_matches(path, '^src/(.*/)?index\.ts$')) AND NOT ({_N} = 1 AND regexp_matches(path, '\.test\.ts$') AND NOT starts_with(path, 'src/auth/mod_1'))
      AND NOT ({_N} = 2 AND regexp_matches(path, '^src/core/|^pkg/[^/]*/mod_[^/]\.py$|(^|/)mod_[^/]*[13]\.p[^x]$'))""", "files"),
    "corpus_scan": V.sql(f"SELECT doc_id, path, size FROM files WHERE {EXT} IN {ALLOWED} AND NOT {HIDDEN} AND NOT {IGNORED}", "files"),
    "ignore_filter": V.sql(f"SELECT doc_id, path, {IGNORED} AS ignored FROM files", "files"),
    "ignore_defaults": V.sql(f"SELECT path FROM files WHERE NOT regexp_matches(path, '{_DEF_RX}')", "files"),
    "extension_filter": V.sql(f"SELECT doc_id, {EXT} AS ext FROM files WHERE {EXT} IN {ALLOWED} OR {EXT} = '.bin'", "files"),
    "hidden_filter": V.sql(f"SELECT doc_id, path FROM files WHERE NOT {HIDDEN}", "files"),
    "corpus_key": V.sql("SELECT doc_id, 'hybrid_code_chunks_' || substr(md5('/repos/' || corpus),1,8) AS hybrid_key, 'code_chunks_' || substr(md5('/repos/' || corpus),1,8) AS dense_key FROM files", "files"),
    "path_normalize": V.sql("SELECT doc_id, CASE WHEN doc_id % 7 IN (4, 6) THEN NULL ELSE path END AS norm FROM files", "files"),
    "language_tag": V.sql(f"SELECT doc_id, coalesce(language, 'text') AS language FROM (SELECT *, {EXT} AS e FROM files) LEFT JOIN lang_dim ON ext = e", "files", "lang_dim"),
    "language_capability": V.sql(f"""SELECT capability, ext, any_value(language) AS language, count(e) AS files FROM (
      SELECT unnest(['splitter','symbols','graph_build','graph_query','outline']) AS capability, ext, language, splitter, symbols FROM lang_dim) d LEFT JOIN (SELECT {EXT} AS e FROM files) ON e = ext
      WHERE CASE WHEN capability = 'splitter' THEN splitter ELSE symbols END GROUP BY capability, ext""", "files", "lang_dim"),
    "path_category": V.sql(f"SELECT doc_id, {CATEGORY} AS category FROM (SELECT *, lower(path) AS lp FROM files)", "files"),
    "noise_category": V.sql(f"SELECT doc_id, {NOISE} AS category FROM (SELECT *, lower(path) AS lp FROM files)", "files"),
    "staleness_bucket": """SELECT event_id, CASE WHEN event_type='error' THEN 'unknown' WHEN greatest(0, epoch(TIMESTAMP '2024-01-30 12:00:00' - ts)) <= 1800 THEN 'fresh'
      WHEN epoch(TIMESTAMP '2024-01-30 12:00:00' - ts) <= 86400 THEN 'aging' ELSE 'stale' END AS bucket FROM events""",
    "chunk_id": V.sql("SELECT doc_id, chunk_id AS id FROM chunks", "chunks0", "chunks1", "chunks"),
    "symbol_id": V.sql("SELECT doc_id, symbol_id AS id FROM chunks", "chunks0", "chunks1", "chunks"),
    "embed_text_prepare": "SELECT doc_id, md5(CASE WHEN text = '' THEN ' ' ELSE substr(text, 1, 2048) END) AS text_md5, CAST(ceil(length(text)/4.0) AS BIGINT) AS tokens FROM documents",
    "rerank_document": V.sql(r"SELECT doc_id, md5(path || chr(10) || language || chr(10) || coalesce(symbol_label,'') || chr(10) || substr(array_to_string(list_slice(regexp_split_to_array(content, '\r?\n'), 1, 200), chr(10)), 1, 4000)) AS doc_md5 FROM chunks", "chunks0", "chunks1", "chunks"),
    "preview": "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN substr(text,1,4000) || '...' ELSE text END) AS preview_md5 FROM documents",
    "breadcrumbs": f"""WITH a AS (SELECT doc_id, list_filter(list_transform(list_concat([source, source], string_split(text, chr(10))), lambda x: {_SQ}), lambda x: x <> '') AS sq FROM documents),
      b AS (SELECT doc_id, list_transform(sq, lambda x: CASE WHEN length(x) <= 120 THEN x ELSE substr(x,1,117) || '...' END) AS c FROM a),
      d AS (SELECT doc_id, list_filter(c, lambda x, i: i = 1 OR x <> c[i-1]) AS u FROM b)
      SELECT doc_id, array_to_string(list_slice(u, greatest(len(u)-1, 1), len(u)), ' > ') AS crumbs FROM d""",
    "metadata_parse": "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
}
