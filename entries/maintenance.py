"""Table maintenance and incremental sync queries."""

from pyspark.sql import functions as F

from entries import views as V
from entries.columns import IGNORED, RULES
from quarry.functions import fixed as X
from quarry.operators import chunking as C, incremental as I
from quarry.session import cut_lineage, shared_dir
from quarry.sources import tables as T

c = V.CTE
CHUNKS = ("chunks0", "chunks1", "chunks")
L = lambda x: F.col(x).cast("long").alias(x)
CAP = 4000

# --- chunk tables ---------------------------------------------------------------------------


def versioned(s, sf, where, v):
    return V.chunks(s, sf).where(where).withColumn("version", F.lit(v).cast("long"))


def upsert(s, sf):
    return T.upsert(versioned(s, sf, "corpus <> 'src3'", 1), versioned(s, sf, "language = 'typescript' OR corpus = 'src3'", 2)).select("chunk_id", "corpus", "path", "version")


def gone(s, sf):
    return V.files(s, sf).where("lang = 'fr'").selectExpr("corpus", "CASE WHEN size > 1000 THEN './' || path ELSE replace(path, '/', '//') END AS path")


def rebuild(s, sf):
    corpora = V.files(s, sf).where("corpus IN ('src3', 'src7')").select("corpus")
    return T.rebuild(versioned(s, sf, "language <> 'go'", 1), versioned(s, sf, "true", 2), corpora).groupBy("corpus", "version").agg(F.count(F.lit(1)).alias("chunks"))


def order_chunks(s, sf):
    """Orders as files and lines as chunks: three corpora, each a third of all rows."""
    return V.t(s, sf, "lineitem").selectExpr(
        "l_returnflag AS corpus", "lpad(cast(l_orderkey AS string), 10, '0') AS path", "l_linenumber AS start_line",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) AS bigint)) AS chunk_id")


def capped(s, sf):
    return T.cap_chunks(order_chunks(s, sf), CAP).select("corpus", "path", "chunk_id", "status")


def commits(s, sf):
    """Every order is a completion record of its customer's corpus; some are malformed."""
    return V.t(s, sf, "orders").selectExpr(
        "'corpus-' || o_custkey AS corpus", f"CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE '{X.MARKER_KIND}' END AS kind",
        "CASE WHEN o_orderstatus = 'P' THEN named_struct('provider','p','model','m1','dimension',1024,'store','s','schema_version','dense_v3') "
        "WHEN o_orderpriority <> '2-HIGH' THEN named_struct('provider','p','model','m1','dimension',1024,'store','s','schema_version','hybrid_v3') END AS fingerprint",
        "cast(o_totalprice / 1000 AS bigint) AS indexed_files", "cast(o_totalprice AS bigint) - 2000 AS total_chunks",
        "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'unknown' ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") END AS completed_at",
        "'run-' || lpad(cast(o_orderkey AS string), 12, '0') AS run_id")


c["commits"] = f"""SELECT 'corpus-' || o_custkey AS corpus, CASE WHEN o_orderpriority='5-LOW' THEN 'other' ELSE '{X.MARKER_KIND}' END AS kind,
  CASE WHEN o_orderstatus='P' THEN 'dense_v3' WHEN o_orderpriority <> '2-HIGH' THEN 'hybrid_v3' END AS schema_version,
  CAST(trunc(o_totalprice/1000) AS BIGINT) AS indexed_files, CAST(trunc(o_totalprice) AS BIGINT) - 2000 AS total_chunks,
  CASE WHEN o_orderpriority='4-NOT SPECIFIED' AND o_orderstatus='F' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS completed_at,
  'run-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id FROM orders"""


def run_commit(s, sf):
    c = commits(s, sf)
    last = T.latest_commits(c, only_valid=True).select("corpus", "run_id", "indexed_files", "total_chunks")
    bad = c.groupBy("corpus").agg(F.count_if(~T.valid_commit()).alias("rejected"))
    return bad.join(last, "corpus", "left")


# --- snapshots ------------------------------------------------------------------------------
def files(s, sf):
    return V.files(s, sf)


def diff(s, sf):
    return I.snapshot_diff(V.prev_files(s, sf), files(s, sf).select("corpus", "path", "content_hash"))


def reuse(s, sf):
    return I.snapshot_with_reuse(files(s, sf).drop("content_hash"), V.prev_files(s, sf)).select("corpus", "path", "content_hash", "hashed")


def cadence(s, sf):
    return V.t(s, sf, "customer").select("c_custkey", I.full_hash_due(F.col("c_custkey") + 1, F.col("c_nationkey") - 2).alias("due"))


UNREADABLE = "corpus = 'src5' AND lang = 'en'"


def preserve(s, sf):
    f = files(s, sf)
    blocked = f"({UNREADABLE}) OR path LIKE 'pkg/%' OR path LIKE 'docs/de/%'"
    unscanned = f.select("corpus").distinct().withColumn("prefix", F.explode(F.array(*map(F.lit, ["pkg/", "./docs/de", "pkg/src", "src/a", "docs//de/"]))))
    return I.preserve_unscanned(V.prev_files(s, sf), f.where(f"NOT ({blocked})"), f.where(UNREADABLE), unscanned, ["*.bin"]).select(
        "corpus", "path", "content_hash", "preserved")


def prefixes(s, sf):
    return files(s, sf).selectExpr("corpus", "CASE WHEN lang = 'de' THEN './' || path WHEN lang = 'es' THEN regexp_replace(path, '/.*', '') ELSE regexp_replace(path, '/[^/]*$', '/') END AS prefix")


def gate(s, sf):
    split = lambda df: df.withColumn("corpus", F.concat("lang", F.lit("-"), "corpus"))
    cur = split(files(s, sf))
    prev = split(files(s, sf).drop("content")).selectExpr("corpus", "path", "size", "CASE WHEN lang = 'de' AND size > 2000 THEN mtime - 1 ELSE mtime END AS mtime",
                                                          "CASE WHEN lang = 'fr' THEN md5(content_hash) ELSE content_hash END AS content_hash")
    state = I.snapshot_with_reuse(cur.drop("content_hash"), prev)
    meta = cur.groupBy("corpus").agg((F.max("size") > 8000).alias("partial"), F.lit(False).alias("was_partial"),
                                     F.when(F.max("corpus").endswith("src1"), 2).otherwise(1).alias("counter"), F.lit(1).alias("was_counter"))
    return I.write_gate(I.snapshot_diff(prev, cur), state, meta).select("corpus", "changes", "hashed", "write")


def splitter(f):
    return C.finish_chunks(C.chunk_windows(f, 1000)).select("chunk_id", "corpus", "path", "start_line", "end_line")


def delta(s, sf):
    """The chunk table of the older snapshot, brought up to date; old chunks carry no text here."""
    old = V.prev_files(s, sf).selectExpr("'old_' || content_hash || '_' || path AS chunk_id", "corpus", "path", "1 AS start_line", "1 AS end_line")
    return I.apply_delta(old, cut_lineage(diff(s, sf), "delta"), files(s, sf).select("corpus", "path", "content"), splitter).select("chunk_id", "corpus", "path", L("start_line"), L("end_line"))


NEW_RULES = ["*.bin", "src/auth/", "docs/en/**"]
OLD_RULES = ["pkg/dist/", "src/auth/mod_1*", "*.bin"]


def reconcile(s, sf):
    m = files(s, sf).where("path NOT LIKE 'pkg/dist/%' AND path NOT LIKE '.hidden%' AND path NOT LIKE '%.bin'")
    return I.reconcile_rules(m, files(s, sf), OLD_RULES, NEW_RULES).groupBy("corpus", "action").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("newly_ignored").alias("newly_ignored"))


def controls(s, sf):
    """Go files stand for one control file, hidden ones for the other: the latest per corpus counts."""
    f = files(s, sf).selectExpr("lang || '-' || corpus AS corpus", "CASE WHEN path LIKE 'lib/%' THEN '.gitignore' WHEN path LIKE '.hidden/%' THEN '.indexignore' ELSE path END AS path", "size", "mtime")
    newest = f.groupBy("corpus", "path").agg(F.max_by(F.struct("size", "mtime"), F.struct("mtime", "size")).alias("m")).select("corpus", "path", "m.size", "m.mtime")
    return I.control_signature(newest, f)


STATUS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'indexed' WHEN 'AUTOMOBILE' THEN 'sync_completed' WHEN 'MACHINERY' THEN 'indexing' WHEN 'HOUSEHOLD' THEN 'indexfailed' ELSE 'requires_reindex' END"


def preflight(s, sf):
    st = V.t(s, sf, "customer").selectExpr("'corpus-' || c_custkey AS corpus", f"{STATUS} AS status", "c_acctbal > 0 AS allowed", "c_nationkey <> 7 AS probed")
    ch = V.t(s, sf, "orders").selectExpr(
        "'corpus-' || o_custkey AS corpus", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '.gitignore' WHEN o_orderpriority = '3-MEDIUM' THEN '.indexignore' ELSE 'src/a.ts' END AS path")
    return I.preflight(st, ch)


STATUS_LINE = """CASE event_type WHEN 'click' THEN ' M src/u' || user_id || '/f' || event_id || '.ts' WHEN 'view' THEN '?? new/u' || user_id || '.ts  '
 WHEN 'purchase' THEN 'R  old/a' || event_id || '.ts -> src/b' || user_id || '.ts' WHEN 'signup' THEN ' A "dir with \"q\"/x' || user_id || '.ts"' ELSE '!! ignored/' || event_id END"""


def changed(s, sf):
    return I.changed_paths(V.t(s, sf, "events").selectExpr("user_id AS corpus", STATUS_LINE.replace('\\"', '\\\\"') + " AS line"))


def rebuild_due(s, sf):
    return I.graph_rebuild_due(files(s, sf).selectExpr("lang || '-' || corpus AS corpus", "path"))


def built(s, sf, sync=False):
    """Build the index in the shared folder, then (for sync) move it from an older state of the files."""
    from quarry.functions.embedders import keyword_vector
    from quarry.operators.state import fingerprint
    from quarry.plans import index
    root, now = shared_dir(s, "built"), F.lit("2026-01-01 00:00:00").cast("timestamp")
    f = files(s, sf).select("corpus", "path", "content", "size", "mtime", "lang")
    fp = fingerprint({"provider": "native", "model": "keywords", "dimension": 4, "store": "parquet", "schema_version": "hybrid_v3"})
    first = f.where("lang <> 'es'").withColumn("content", F.when(F.col("lang") == "fr", F.upper("content")).otherwise(F.col("content"))).withColumn(
        "mtime", F.when(F.col("lang") == "fr", F.col("mtime") - 1).otherwise(F.col("mtime"))) if sync else f
    index.build(first.drop("lang"), root, keyword_vector, fp, now, "run-1", ["*.bin"])
    if sync:
        delta = index.sync(f.drop("lang"), root, keyword_vector, fp, now + F.expr("INTERVAL 1 HOUR"), "run-2", ["*.bin"])
        return delta.groupBy("change").agg(F.count(F.lit(1)).alias("files"))
    chunks, last = index.load(s, root)
    n = chunks.groupBy("corpus").agg(F.count_distinct("path").alias("files"), F.sum(F.size("vector")).alias("numbers"))
    return n.join(last.select("corpus", "indexed_files", "run_id"), "corpus")


def _index(s, sf):
    from quarry.functions.embedders import keyword_vector
    from quarry.operators.state import fingerprint
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    fp = fingerprint({"provider": "native", "model": "keywords", "dimension": 4, "store": "parquet", "schema_version": "hybrid_v3"})
    return shared_dir(s, "index"), keyword_vector, fp, now, files(s, sf).select("corpus", "path", "content", "size", "mtime")


def touched(s, sf):
    """Every file gets a new time and the same text: nothing changes, and a second sync reads nothing again."""
    from quarry.plans import index
    root, embed, fp, now, f = _index(s, sf)
    index.build(f, root, embed, fp, now, "run-1", ["*.bin"])
    later = f.withColumn("mtime", F.col("mtime") + 1)
    first = index.sync(later, root, embed, fp, now, "run-2", ["*.bin"])
    snapshot = T.read_table(s, f"{root}/snapshot")
    again = I.hash_needed(later.select("corpus", "path", "size", "mtime").join(snapshot.select("corpus", "path"), ["corpus", "path"], "left_semi"), snapshot)
    return again.groupBy("corpus").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("reused_hash").isNull()).alias("to_read")).crossJoin(
        first.agg(F.count(F.lit(1)).alias("changes")))


def partial(s, sf):
    """A scan without the folder pkg and without the French files of src5, which could not be read: only real removals go."""
    from quarry.plans import index
    root, embed, fp, now, f = _index(s, sf)
    index.build(f, root, embed, fp, now, "run-1", ["*.bin"])
    lost = files(s, sf).where("corpus = 'src5' AND lang = 'fr'").select("corpus", "path")
    seen = f.where("path NOT LIKE 'pkg/%' AND path NOT LIKE 'lib/%'").join(lost, ["corpus", "path"], "left_anti")
    folder = f.select("corpus").distinct().withColumn("prefix", F.lit("pkg"))
    index.sync(seen, root, embed, fp, now, "run-2", ["*.bin"], unreadable=lost, unscanned=folder)
    return index.load(s, root)[0].select("corpus", "path").distinct()


def listed(s, sf):
    """A sync that is given names, sizes and times, and fetches texts by path: per corpus what was fetched, and the changes."""
    from quarry.plans import index
    root, embed, fp, now, f = _index(s, sf)
    odd = F.pmod(F.length("content"), F.lit(3)) == 0
    index.build(f.withColumn("mtime", F.when(odd, F.col("mtime") - 1).otherwise(F.col("mtime"))).withColumn(
        "content", F.when(odd, F.upper("content")).otherwise(F.col("content"))), root, embed, fp, now, "run-1", ["*.bin"])
    asked = []

    def fetch(paths):
        asked.append(cut_lineage(paths, "asked"))
        return f.select("corpus", "path", "content").join(paths, ["corpus", "path"], "left_semi")

    delta = index.sync(f.drop("content"), root, embed, fp, now + F.expr("INTERVAL 1 HOUR"), "run-2", ["*.bin"], fetch=fetch)
    fetched = asked[-1].groupBy("corpus").agg(F.count(F.lit(1)).alias("fetched"))
    return fetched.join(delta.groupBy("corpus").agg(F.count(F.lit(1)).alias("changes")), "corpus", "left").na.fill(0, ["changes"])


def interrupted(s, sf):
    """Three builds: one that ends, one that dies after its proof, one that dies before: what recovery makes of them, and the gate."""
    from quarry.plans import index, lifecycle
    root, embed, fp, now, f = _index(s, sf)
    kind = lambda k: f.where(F.pmod(F.ascii(F.substring("corpus", -1, 1)), F.lit(3)) == k)
    lifecycle.build(kind(0), root, embed, fp, now, "run-1", rules=["*.bin"])
    lifecycle.begin(kind(1), root, fp, now, "run-2")
    index.build(kind(1), root, embed, fp, now, "run-2", ["*.bin"])
    lifecycle.begin(kind(2), root, fp, now, "run-3")
    done = lifecycle.recover(s, root, fp, now + F.expr("INTERVAL 1 HOUR"))
    return (lifecycle.current(s, root).select("corpus", "status", F.coalesce("indexed_files", F.lit(0)).alias("files"))
            .join(done.select("corpus", "action"), "corpus", "left").na.fill("none", ["action"]).join(lifecycle.gate(s, root, fp).select("corpus", "open"), "corpus"))


def build_capped(s, sf):
    """With a cap, what was cut is named in the commit and taken up by the next sync."""
    from quarry.plans import index
    root, embed, fp, now, f = _index(s, sf)
    index.build(f, root, embed, fp, now, "run-1", ["*.bin"], cap=60)
    status = index.load(s, root)[1].select("corpus", "status", F.col("total_chunks").alias("capped"))
    status = cut_lineage(status, "status")
    index.sync(f, root, embed, fp, now + F.expr("INTERVAL 1 HOUR"), "run-2", ["*.bin"])
    whole = index.load(s, root)[0].groupBy("corpus").agg(F.count(F.lit(1)).alias("chunks"))
    return whole.join(status, "corpus")


QUERIES = {
    "index_sync_touch": touched,
    "index_sync_partial": partial,
    "index_sync_listed": listed,
    "index_recovery": interrupted,
    "index_build_capped": build_capped,
    "index_build": built,
    "index_sync": lambda s, sf: built(s, sf, True),
    "chunk_upsert": upsert,
    "chunk_delete_by_path": lambda s, sf: T.delete_paths(V.chunks(s, sf), gone(s, sf)).select("chunk_id", "corpus", "path"),
    "chunk_delete_counts": lambda s, sf: T.deleted_counts(V.chunks(s, sf), gone(s, sf)),
    "chunk_query": lambda s, sf: T.query(V.chunks(s, sf), "language = 'typescript' AND end_line > 3", ["chunk_id", "path", "symbol_label"]),
    "chunk_query_default": lambda s, sf: T.query(order_chunks(s, sf), "", ["chunk_id", "corpus"], X.QUERY_LIMIT),
    "index_rebuild": rebuild,
    "chunk_cap": capped,
    "run_commit": run_commit,
    "file_snapshot": lambda s, sf: I.file_snapshot(files(s, sf)),
    "hash_reuse": reuse,
    "full_hash_cadence": cadence,
    "snapshot_diff": diff,
    "partial_scan_preserve": preserve,
    "prefix_compress": lambda s, sf: I.compress_prefixes(prefixes(s, sf)),
    "merkle_root": lambda s, sf: I.merkle_root(files(s, sf), 2),
    "snapshot_write_gate": gate,
    "apply_delta": delta,
    "ignore_reconcile": reconcile,
    "manifest": lambda s, sf: I.manifest(V.chunks(s, sf)),
    "control_signature": controls,
    "reindex_preflight": preflight,
    "changed_files": changed,
    "graph_rebuild_policy": rebuild_due,
}

c["diff"] = """SELECT coalesce(p.corpus, f.corpus) AS corpus, coalesce(p.path, f.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM prev_files p FULL JOIN files f ON p.corpus=f.corpus AND p.path=f.path WHERE p.content_hash IS DISTINCT FROM f.content_hash"""
c["gone"] = "SELECT corpus, path FROM files WHERE lang='fr'"
c["px"] = "SELECT DISTINCT corpus, CASE WHEN lang='de' THEN path WHEN lang='es' THEN split_part(path,'/',1) ELSE regexp_replace(path, '/[^/]*$', '') END AS prefix FROM files"
_ORD = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
c["oc"] = """SELECT l_returnflag AS corpus, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS path, l_linenumber AS start_line,
  l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||CAST(round(l_extendedprice*100) AS BIGINT) AS chunk_id FROM lineitem"""
_WIN = "SELECT 'chunk_' || substr(sha256(path||':'||start_line||':'||end_line||':'||content),1,16) AS chunk_id, corpus, path, start_line, end_line FROM win1"
_SET = f"CASE WHEN regexp_matches(path, '\\.bin$') OR path LIKE 'src/auth/%' OR path LIKE 'docs/en/%' THEN 1 ELSE 0 END"
_OLDI = "(path LIKE 'pkg/dist/%' OR path LIKE 'src/auth/mod_1%' OR path LIKE '%.bin')"
_MAN = "(path NOT LIKE 'pkg/dist/%' AND path NOT LIKE '.hidden%' AND path NOT LIKE '%.bin')"


def _win(size):
    from entries.chunking import SIZE, WIN
    return WIN, lambda q: q.replace(str(SIZE), str(size))


def _delta_sql():
    names, resize = _win(1000)
    q = V.sql(f"""SELECT 'old_' || content_hash || '_' || path AS chunk_id, corpus, path, 1::BIGINT AS start_line, 1::BIGINT AS end_line FROM prev_files p
      WHERE NOT EXISTS (SELECT 1 FROM diff d WHERE d.corpus=p.corpus AND d.path=p.path AND change <> 'added')
      UNION ALL SELECT w.* FROM ({_WIN}) w JOIN diff d ON d.corpus=w.corpus AND d.path=w.path WHERE change <> 'removed'""", *names, "prev_files", "diff", recursive=True)
    return resize(q)


_EXTS = "('.ts', '.tsx', '.js', '.jsx', '.py', '.java', '.cpp', '.c', '.h', '.hpp', '.cs', '.go', '.rs', '.php', '.rb', '.swift', '.kt', '.scala', '.m', '.mm', '.md', '.markdown', '.ipynb')"
c["found"] = rf"SELECT * FROM files WHERE regexp_extract(path, '(\.[^./]+)$', 1) IN {_EXTS} AND path NOT LIKE '.%' AND path NOT LIKE '%/dist/%' AND trim(content) <> ''"


def _build_sql():
    """Chunk counts follow from the declaration oracle; here the texts as they are."""
    return V.sql(r"""SELECT corpus, count(*) AS files, CAST(sum(4 * parts) AS BIGINT) AS numbers, count(*) AS indexed_files, 'run-1' AS run_id FROM (
      SELECT f.corpus, f.path, p.parts FROM found f JOIN (SELECT doc_id, count(*) AS parts FROM bp GROUP BY doc_id) p ON p.doc_id = f.doc_id) GROUP BY corpus""", *_PARTS, "found", recursive=True)


# lines packed to 2500 characters, longer ones cut; the test texts hold no declaration headers
c["bl0"] = "SELECT doc_id, length(content) AS total, string_split(content, chr(10)) AS ls FROM files"
c["bl1"] = "SELECT doc_id, total, unnest(range(1, len(ls)+1)) AS i, len(ls) AS nl, ls FROM bl0"
c["bla"] = "SELECT doc_id, total, i AS line, length(ls[i]) + CASE WHEN i < nl THEN 1 ELSE 0 END AS n FROM bl1"
c["blb"] = "SELECT doc_id, total, line, n, unnest(range(0, greatest(1, CAST(ceil(n/2500.0) AS INTEGER)))) AS j FROM bla"
c["bl2"] = "SELECT doc_id, total, row_number() OVER (PARTITION BY doc_id ORDER BY line, j) AS i, greatest(0, least(2500, n - j*2500)) AS n FROM blb"
c["blp"] = """SELECT doc_id, i, n AS cur, 0 AS part, total FROM bl2 WHERE i = 1 UNION ALL
  SELECT u.doc_id, u.i, CASE WHEN p.cur > 0 AND p.cur + u.n > 2500 THEN u.n ELSE p.cur + u.n END, p.part + CASE WHEN p.cur > 0 AND p.cur + u.n > 2500 THEN 1 ELSE 0 END, u.total FROM blp p JOIN bl2 u ON u.doc_id = p.doc_id AND u.i = p.i + 1"""
c["bp"] = "SELECT DISTINCT doc_id, CASE WHEN total > 2500 THEN part ELSE 0 END AS part FROM blp"
_PARTS = ("files", "bl0", "bl1", "bla", "blb", "bl2", "blp", "bp")

SQL = {
    "index_sync_touch": V.sql("SELECT corpus, count(*) AS files, 0::BIGINT AS to_read, 0::BIGINT AS changes FROM found GROUP BY corpus", "files", "found"),
    "index_sync_partial": V.sql("SELECT corpus, path FROM found WHERE path NOT LIKE 'lib/%' OR (corpus = 'src5' AND lang = 'fr')", "files", "found"),
    "index_build_capped": V.sql("""SELECT corpus, count(*) AS chunks, CASE WHEN count(*) >= 60 THEN 'limit_reached' ELSE 'completed' END AS status, least(count(*), 60)::BIGINT AS capped
      FROM found f JOIN bp ON bp.doc_id = f.doc_id GROUP BY corpus""", *_PARTS, "found", recursive=True),
    "index_build": _build_sql(),
    "index_sync_listed": V.sql("SELECT corpus, count(*) AS fetched, count(*) FILTER (upper(content) <> content) AS changes FROM found WHERE length(content) % 3 = 0 GROUP BY corpus", "files", "found"),
    "index_recovery": V.sql("""SELECT corpus, CASE k WHEN 2 THEN 'indexfailed' ELSE 'indexed' END AS status, CASE k WHEN 2 THEN 0 ELSE n END::BIGINT AS files,
      CASE k WHEN 0 THEN 'none' WHEN 1 THEN 'promote_indexed' ELSE 'mark_failed' END AS action, k <> 2 AS open
      FROM (SELECT corpus, ascii(right(corpus, 1)) % 3 AS k, count(p) AS n FROM (SELECT a.corpus, b.path AS p FROM files a LEFT JOIN found b ON b.corpus = a.corpus AND b.path = a.path) GROUP BY corpus)""", "files", "found"),
    "index_sync": V.sql("SELECT CASE WHEN lang = 'es' THEN 'added' ELSE 'modified' END AS change, count(*) AS files FROM found WHERE lang IN ('es', 'fr') AND (lang = 'es' OR upper(content) <> content) GROUP BY 1", "files", "found"),
    "chunk_upsert": V.sql("SELECT chunk_id, corpus, path, CASE WHEN language='typescript' OR corpus='src3' THEN 2 ELSE 1 END::BIGINT AS version FROM chunks", *CHUNKS),
    "chunk_delete_by_path": V.sql("SELECT chunk_id, corpus, path FROM chunks WHERE (corpus, path) NOT IN (SELECT corpus, path FROM gone)", "files", *CHUNKS, "gone"),
    "chunk_delete_counts": V.sql("SELECT corpus, count(*) AS paths, count(*) AS chunks FROM gone GROUP BY corpus", "files", "gone"),
    "chunk_query": V.sql("SELECT chunk_id, path, symbol_label FROM chunks WHERE language='typescript' AND end_line > 3", *CHUNKS),
    "chunk_query_default": V.sql("SELECT chunk_id, corpus FROM oc ORDER BY chunk_id LIMIT 16384", "oc"),
    "index_rebuild": V.sql("SELECT corpus, v::BIGINT AS version, count(*) AS chunks FROM (SELECT corpus, CASE WHEN corpus IN ('src3','src7') THEN 2 ELSE 1 END AS v, language FROM chunks) WHERE v = 2 OR language <> 'go' GROUP BY ALL", *CHUNKS).replace("v::BIGINT AS version", "CAST(v AS INTEGER)::BIGINT AS version"),
    "chunk_cap": V.sql(f"SELECT corpus, path, chunk_id, CASE WHEN n >= {CAP} THEN 'limit_reached' ELSE 'completed' END AS status FROM (SELECT *, count(*) OVER (PARTITION BY corpus) AS n, row_number() OVER (PARTITION BY corpus ORDER BY path, start_line, chunk_id) AS i FROM oc) WHERE i <= {CAP}", "oc"),
    "run_commit": V.sql(f"""SELECT corpus, rejected, run_id, indexed_files, total_chunks FROM (SELECT corpus, count(*) FILTER (NOT ok) AS rejected FROM (SELECT *, {{ok}} AS ok FROM commits) GROUP BY corpus)
      LEFT JOIN (SELECT corpus, arg_max(run_id, completed_at || run_id) AS run_id, arg_max(indexed_files, completed_at || run_id) AS indexed_files, arg_max(total_chunks, completed_at || run_id) AS total_chunks FROM commits WHERE {{ok}} GROUP BY corpus) USING (corpus)""".format(
        ok=f"(kind='{X.MARKER_KIND}' AND indexed_files >= 0 AND total_chunks >= 0 AND completed_at <> 'unknown' AND schema_version IS NOT NULL)"), "commits"),
    "file_snapshot": V.sql("SELECT corpus, path, content_hash, size, mtime FROM files", "files"),
    "hash_reuse": V.sql("""SELECT f.corpus, f.path, f.content_hash, (p.path IS NULL OR p.size <> f.size OR p.mtime <> f.mtime) AS hashed FROM files f LEFT JOIN prev_files p ON p.corpus=f.corpus AND p.path=f.path""", "files", "prev_files"),
    "full_hash_cadence": "SELECT c_custkey, CASE WHEN c_nationkey - 2 <= 0 THEN false ELSE (c_custkey + 1) % (c_nationkey - 2) = 0 END AS due FROM customer",
    "snapshot_diff": V.sql("SELECT corpus, path, change FROM diff", "files", "prev_files", "diff"),
    "partial_scan_preserve": V.sql(f"""SELECT corpus, path, content_hash, false AS preserved FROM files WHERE NOT (({UNREADABLE}) OR path LIKE 'pkg/%' OR path LIKE 'docs/de/%') AND path NOT LIKE '.%' AND path NOT LIKE '%.bin'
      UNION ALL SELECT p.corpus, p.path, p.content_hash, true FROM prev_files p JOIN files f ON f.corpus=p.corpus AND f.path=p.path WHERE ((f.corpus='src5' AND f.lang='en') OR p.path LIKE 'pkg/%' OR p.path LIKE 'docs/de/%') AND p.path NOT LIKE '.%' AND p.path NOT LIKE '%.bin'""", "files", "prev_files"),
    "prefix_compress": V.sql("SELECT a.corpus, a.prefix FROM px a WHERE NOT EXISTS (SELECT 1 FROM px b WHERE b.corpus=a.corpus AND starts_with(a.prefix, b.prefix || '/'))", "files", "px"),
    "merkle_root": V.sql("""SELECT corpus, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(b || ':' || d || chr(10), '' ORDER BY b)) AS root FROM (
      SELECT corpus, substr(sha256(path),1,2) AS b, count(*) AS n, sha256(string_agg(path || chr(0) || content_hash || chr(10), '' ORDER BY path)) AS d FROM files GROUP BY corpus, b) GROUP BY corpus""", "files"),
    "snapshot_write_gate": V.sql("""SELECT corpus, changes, hashed, changes > 0 OR hashed > 0 OR partial OR corpus LIKE '%src1' AS write FROM (
      SELECT lang || '-' || corpus AS corpus, count(*) FILTER (lang='fr') AS changes, count(*) FILTER (lang='de' AND size > 2000) AS hashed, max(size) > 8000 AS partial FROM files GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY lang || '-' || corpus"), "files"),
    "apply_delta": _delta_sql(),
    "ignore_reconcile": V.sql(f"""SELECT corpus, action, count(*) AS files, count(*) FILTER (man AND ni AND NOT oi) AS newly_ignored FROM (SELECT corpus, {_MAN} AS man, {_SET} = 1 AS ni, {_OLDI} AS oi,
      CASE WHEN {_MAN} THEN CASE WHEN {_SET} = 1 THEN 'delete' ELSE 'keep' END WHEN {_SET} = 0 AND path NOT LIKE '.%' THEN 'add' END AS action FROM files) WHERE action IS NOT NULL GROUP BY corpus, action""", "files"),
    "manifest": V.sql("SELECT DISTINCT corpus, path FROM chunks", *CHUNKS),
    "control_signature": V.sql("""SELECT corpus, coalesce('.gitignore:' || g, '.gitignore:missing') || '|' || coalesce('.indexignore:' || h, '.indexignore:missing') AS signature FROM (
      SELECT lang || '-' || corpus AS corpus, arg_max(mtime || ':' || size, mtime) FILTER (path LIKE 'lib/%') AS g, arg_max(mtime || ':' || size, mtime) FILTER (path LIKE '.hidden/%') AS h FROM files GROUP BY lang || '-' || corpus)""", "files"),
    "reindex_preflight": f"""SELECT corpus, outcome, CASE WHEN outcome IN ('reindex_required','reindex_unnecessary_ignore_only') THEN 'high' ELSE 'low' END AS confidence FROM (
      SELECT 'corpus-' || c_custkey AS corpus, CASE WHEN {STATUS} = 'requires_reindex' OR c_acctbal <= 0 THEN 'reindex_required' WHEN c_nationkey = 7 THEN 'probe_failed' WHEN n IS NULL THEN 'unknown'
       WHEN only_ctl AND {STATUS} IN ('indexed','sync_completed') THEN 'reindex_unnecessary_ignore_only' ELSE 'unknown' END AS outcome FROM customer
      LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_and(o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM')) AS only_ctl FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)""",
    "changed_files": """SELECT DISTINCT user_id AS corpus, CASE event_type WHEN 'click' THEN 'src/u' || user_id || '/f' || event_id || '.ts' WHEN 'purchase' THEN 'src/b' || user_id || '.ts'
      ELSE 'dir with "q"/x' || user_id || '.ts' END AS path FROM events WHERE event_type IN ('click','purchase','signup')""",
    "graph_rebuild_policy": V.sql(r"SELECT lang || '-' || corpus AS corpus, bool_or(regexp_matches(path, '\.(ts|tsx|js|jsx|mjs|cjs|py)$')) AS rebuild FROM files GROUP BY lang || '-' || corpus", "files"),
}
