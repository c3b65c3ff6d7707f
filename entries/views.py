"""Views over the given tables, once as Spark DataFrames and once as DuckDB CTEs.

The tables hold prose; the views give every document a path, a symbol and a history, so
that the operators meet every case. Everything is derived from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.session import spread

PATH_CASE = """CASE CAST((doc_id - doc_id % 20) / 20 AS BIGINT) % 10
 WHEN 0 THEN 'docs/' || lang || '/doc_' || doc_id || '.md'
 WHEN 1 THEN 'src/auth/mod_' || doc_id || '.test.ts'
 WHEN 2 THEN 'src/core/mod_' || doc_id || '.ts'
 WHEN 3 THEN 'pkg/dist/mod_' || doc_id || '.js'
 WHEN 4 THEN 'src/app_' || doc_id || '/index.ts'
 WHEN 5 THEN 'pkg/src/mod_' || doc_id || '.py'
 WHEN 6 THEN 'lib/mod_' || doc_id || '.go'
 WHEN 7 THEN 'src/__fixtures__/f_' || doc_id || '.ts'
 WHEN 8 THEN '.hidden/mod_' || doc_id || '.ts'
 ELSE 'tools/run_' || doc_id || '.bin' END"""


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name == "documents" else df


# --- Spark side -----------------------------------------------------------------------------
def files(spark, sf):
    return t(spark, sf, "documents").selectExpr(
        "doc_id", "source AS corpus", f"{PATH_CASE} AS path", "text AS content", "n_chars AS size",
        "1700000000000 + doc_id * 1000 AS mtime", "sha2(text, 256) AS content_hash", "lang")


def prev_files(spark, sf):
    """An older snapshot: one source not there yet, French files changed, German ones only touched,
    and files gone since for documents labelled low quality."""
    f = files(spark, sf).drop("content").where("corpus <> 'src3'")
    old = f.selectExpr(
        "doc_id", "corpus", "path",
        "CASE WHEN lang = 'fr' THEN size + 1 ELSE size END AS size",
        "CASE WHEN lang = 'de' THEN mtime - 1 ELSE mtime END AS mtime",
        "CASE WHEN lang = 'fr' THEN md5(content_hash) ELSE content_hash END AS content_hash")
    gone = (files(spark, sf).drop("content").join(t(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id")
            .selectExpr("doc_id", "corpus", "'gone/doc_' || doc_id || '.ts' AS path", "size", "mtime", "content_hash"))
    return old.unionByName(gone)


FIRST_WORD = r"regexp_extract(text, '([A-Za-z]+)', 1)"


def chunks(spark, sf):
    """One chunk per document, with a symbol for most of them."""
    d = t(spark, sf, "documents").selectExpr(
        "doc_id", "source AS corpus", f"{PATH_CASE} AS path", "text AS content", "lang", "n_chars",
        r"cast(length(text) - length(replace(text, chr(10), '')) + 1 AS int) AS end_line",
        r"regexp_extract(text, '([A-Za-z]+)', 1) AS w1")
    d = d.selectExpr(
        "doc_id", "corpus", "path", "content", "1 AS start_line", "end_line",
        "CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.py' "
        "THEN 'python' WHEN path LIKE '%.go' THEN 'go' ELSE 'text' END AS language",
        "CASE WHEN lang = 'en' AND w1 <> '' THEN 'function ' || lower(w1) || '()' "
        "WHEN lang = 'fr' AND w1 <> '' THEN 'class ' || w1 END AS symbol_label",
        "CASE WHEN lang = 'es' THEN NULL ELSE '2026-01-' || lpad(cast(1 + doc_id % 28 AS string), 2, '0') || 'T00:30:00' END AS indexed_at")
    return d.selectExpr(
        "doc_id", "'chunk_' || substring(sha2(concat_ws(':', path, start_line, end_line, content), 256), 1, 16) AS chunk_id",
        "corpus", "path", "start_line", "end_line", "language", "content",
        "CASE WHEN symbol_label IS NOT NULL THEN 'sym_' || substring(sha1(concat_ws(':', path, start_line, end_line, symbol_label)), 1, 16) END AS symbol_id",
        "symbol_label", "indexed_at")


def queries(spark, sf):
    """Every benchmark passage as a query, some of them with operators in front."""
    return t(spark, sf, "benchmark").selectExpr(
        "item_id AS query_id",
        r"""CASE item_id % 6 WHEN 1 THEN 'lang:typescript lang:go ' || text
            WHEN 2 THEN 'path:src/** -path:"src/auth/**" ' || text
            WHEN 3 THEN 'must:"the" ' || text
            WHEN 4 THEN 'where is ' || text
            WHEN 5 THEN 'exclude:zz must:a ' || text ELSE text END AS raw""",
        "CASE item_id % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'mixed' ELSE 'docs' END AS scope",
        "CASE item_id % 2 WHEN 0 THEN 'symbol' ELSE 'file' END AS group_by",
        "cast(3 + item_id % 5 AS int) AS result_limit")


def vectors(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))


def query_vectors(spark, sf):
    return (t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
            .join(vectors(spark, sf), F.col("query_id") == F.col("vec_id")).select("query_id", "vector"))


# --- DuckDB side ----------------------------------------------------------------------------
CTE: dict[str, str] = {}
CTE["files"] = (f"SELECT doc_id, source AS corpus, {PATH_CASE} AS path, text AS content, n_chars AS size, "
                "1700000000000 + doc_id * 1000 AS mtime, sha256(text) AS content_hash, lang FROM documents")
CTE["prev_files"] = """SELECT doc_id, corpus, path, CASE WHEN lang='fr' THEN size+1 ELSE size END AS size,
  CASE WHEN lang='de' THEN mtime-1 ELSE mtime END AS mtime,
  CASE WHEN lang='fr' THEN md5(content_hash) ELSE content_hash END AS content_hash
  FROM files WHERE corpus <> 'src3'
  UNION ALL SELECT f.doc_id, corpus, 'gone/doc_' || f.doc_id || '.ts', size, mtime, content_hash
  FROM files f JOIN labels l ON l.doc_id = f.doc_id WHERE l.quality = 0"""
CTE["chunks0"] = f"""SELECT doc_id, source AS corpus, {PATH_CASE} AS path, text AS content, lang, n_chars, 1 AS start_line,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS end_line,
  regexp_extract(text, '([A-Za-z]+)', 1) AS w1 FROM documents"""
CTE["chunks1"] = """SELECT doc_id, corpus, path, content, start_line, end_line,
  CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.py'
   THEN 'python' WHEN path LIKE '%.go' THEN 'go' ELSE 'text' END AS language,
  CASE WHEN lang='en' AND w1<>'' THEN 'function ' || lower(w1) || '()' WHEN lang='fr' AND w1<>'' THEN 'class ' || w1 END AS symbol_label,
  CASE WHEN lang='es' THEN NULL ELSE '2026-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR),2,'0') || 'T00:30:00' END AS indexed_at
  FROM chunks0"""
CTE["chunks"] = """SELECT doc_id, 'chunk_' || substr(sha256(path||':'||start_line||':'||end_line||':'||content),1,16) AS chunk_id,
  corpus, path, start_line, end_line, language, content,
  CASE WHEN symbol_label IS NOT NULL THEN 'sym_' || substr(sha1(path||':'||start_line||':'||end_line||':'||symbol_label),1,16) END AS symbol_id,
  symbol_label, indexed_at FROM chunks1"""
CTE["queries_v"] = r"""SELECT item_id AS query_id, CASE item_id % 6 WHEN 1 THEN 'lang:typescript lang:go ' || text
  WHEN 2 THEN 'path:src/** -path:"src/auth/**" ' || text WHEN 3 THEN 'must:"the" ' || text
  WHEN 4 THEN 'where is ' || text WHEN 5 THEN 'exclude:zz must:a ' || text ELSE text END AS raw,
  CASE item_id % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'mixed' ELSE 'docs' END AS scope,
  CASE item_id % 2 WHEN 0 THEN 'symbol' ELSE 'file' END AS group_by, CAST(3 + item_id % 5 AS INTEGER) AS result_limit FROM benchmark"""
CTE["query_vectors"] = "SELECT item_id AS query_id, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id"


def sql(body: str, *names: str, recursive: bool = False, instead: dict[str, str] | None = None) -> str:
    """A DuckDB statement: the named CTEs, in order, and then the body."""
    ctes = {**CTE, **(instead or {})}
    parts = [f"{n} AS ({ctes[n]})" for n in dict.fromkeys(names)]
    head = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else ""
    return head + body
