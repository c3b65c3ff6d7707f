"""Streaming queries: the given tables are replayed as streams until they are used up."""

from pyspark.sql import functions as F

from entries import views as V
from entries.columns import RULES
from entries.maintenance import STATUS
from quarry.functions import fixed as X
from quarry.operators import chunking as C
from quarry.session import shared_dir
from quarry.streaming import ingest, watch

QUIET_HOURS = 2
THROTTLE = 6 * 3600
PATH = """CASE event_type WHEN 'click' THEN 'src/f' || event_id || '.ts' WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN '.hidden/x' ELSE 'lib/f' || event_id || '.go' END
 WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN '.gitignore' ELSE '.indexignore' END WHEN 'signup' THEN '../outside' || event_id ELSE 'pkg/dist/f.js' END"""
L = lambda x: F.col(x).cast("long").alias(x)


def event_stream(s, sf):
    schema = V.t(s, sf, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf)
    return raw.selectExpr("event_id", "user_id", "'corpus-' || user_id AS corpus", "cast(ts AS timestamp) AS ts", f"{PATH} AS path", "event_type = 'error' AS is_control")


def replay(s, df, name, mode="append"):
    """Run a stream until its input is used up; the rows it wrote."""
    out, ck = shared_dir(s, name), shared_dir(s, name + "-ck")
    q = df.writeStream.format("parquet").option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return s.read.schema(df.schema).parquet(out)


def state(s, sf):
    return V.t(s, sf, "customer").selectExpr("'corpus-' || c_custkey AS corpus", f"{STATUS} AS status")


def event_filter(s, sf):
    e = watch.event_filter(event_stream(s, sf).drop("is_control"), state(s, sf), RULES)
    return replay(s, e.select("event_id", "corpus", "path", "is_control"), "filter")


def debounce(s, sf):
    """A closing row far behind the last event lets the watermark pass every burst."""
    e = event_stream(s, sf).select("corpus", "ts", "is_control")
    mark = shared_dir(s, "mark")
    (V.t(s, sf, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
     .select(F.lit("end of replay").alias("corpus"), "ts", F.lit(False).alias("is_control")).write.parquet(mark))
    closing = s.readStream.schema("corpus string, ts timestamp, is_control boolean").parquet(mark)
    d = replay(s, watch.debounce(e.unionByName(closing), f"{QUIET_HOURS} hours", "1 day"), "debounce")
    return d.where("corpus <> 'end of replay'").select("corpus", F.col("first_event").cast("string").alias("first_event"), F.col("fires_at").cast("string").alias("fires_at"), "events", "control_edits")


def throttle(s, sf):
    r = event_stream(s, sf).select("corpus", F.col("event_id").alias("request_id"), "ts")
    return replay(s, watch.throttle(r, THROTTLE), "throttle").select("corpus", "request_id", "mode", F.col("last_sync").cast("string").alias("last_sync"))


def versions(s, sf):
    return V.files(s, sf).selectExpr("corpus", "path", "content", "mtime", "false AS deleted", "lang")


def split(f):
    return C.finish_chunks(C.chunk_windows(f, 600)).select("chunk_id", "corpus", "path", "start_line", "end_line")


def ingest_files(s, sf):
    """Two deliveries of the files: the first has other French texts and files that the second
    one deletes; then only what differs is read again."""
    src, root, ck = (shared_dir(s, n) for n in ("deliveries", "index", "ingest-ck"))
    now = versions(s, sf)
    gone = now.where("lang = 'de'").selectExpr("corpus", "'gone/' || path AS path", "content", "mtime", "deleted", "lang")
    first = now.where("corpus <> 'src3'").withColumn("content", F.when(F.col("lang") == "fr", F.upper("content")).otherwise(F.col("content"))).unionByName(gone)
    second = now.withColumn("mtime", F.col("mtime") + 1).unionByName(gone.withColumn("mtime", F.col("mtime") + 1).withColumn("deleted", F.lit(True)).withColumn("content", F.lit(None).cast("string")))
    for delivery in (first, second):
        delivery.drop("lang").write.mode("append").parquet(src)
        stream = s.readStream.schema(delivery.drop("lang").schema).parquet(src)
        ingest.start(stream, root, ck, split, available_now=True).awaitTermination()
    return ingest.current_chunks(s, root).select("chunk_id", "corpus", "path", L("start_line"), L("end_line"))


QUERIES = {"stream_ingest": ingest_files, "stream_debounce": debounce, "stream_throttle": throttle, "stream_event_filter": event_filter}


def _ingest_sql():
    from entries.chunking import WIN
    return V.sql("SELECT 'chunk_' || substr(sha256(path||':'||start_line||':'||end_line||':'||content),1,16) AS chunk_id, corpus, path, start_line, end_line FROM win1", *WIN, recursive=True)


_STR = lambda e: f"regexp_replace(regexp_replace(strftime({e}, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '')"
SQL = {
    "stream_ingest": _ingest_sql(),
    "stream_event_filter": f"""SELECT event_id, e.corpus, path, path IN ('.gitignore', '.indexignore') AS is_control FROM (SELECT event_id, 'corpus-' || user_id AS corpus, {PATH} AS path FROM events) e
      JOIN (SELECT 'corpus-' || c_custkey AS corpus, {STATUS} AS status FROM customer) c ON c.corpus = e.corpus WHERE status IN ('indexed', 'sync_completed') AND (path IN ('.gitignore', '.indexignore') OR path LIKE 'src/f%')""",
    "stream_debounce": f"""SELECT corpus, {_STR('min(ts)')} AS first_event, {_STR(f'max(ts) + INTERVAL {QUIET_HOURS} HOURS')} AS fires_at, count(*) AS events, count(*) FILTER (event_type='error') AS control_edits FROM (
      SELECT *, sum(b) OVER (PARTITION BY corpus ORDER BY ts) AS g FROM (SELECT 'corpus-' || user_id AS corpus, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL {QUIET_HOURS} HOURS THEN 0 ELSE 1 END AS b FROM events)) GROUP BY corpus, g""",
    "stream_throttle": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      r AS (SELECT user_id, event_id, i, ts AS last_ts, 'synced' AS mode FROM e WHERE i = 1 UNION ALL
       SELECT e.user_id, e.event_id, e.i, CASE WHEN epoch(e.ts - r.last_ts) >= {THROTTLE} THEN e.ts ELSE r.last_ts END, CASE WHEN epoch(e.ts - r.last_ts) >= {THROTTLE} THEN 'synced' ELSE 'skipped_recent' END FROM r JOIN e ON e.user_id=r.user_id AND e.i=r.i+1)
      SELECT 'corpus-' || user_id AS corpus, event_id AS request_id, mode, {_STR('last_ts')} AS last_sync FROM r""",
}
