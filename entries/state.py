"""Index state queries. Customers are corpora, orders their completion records."""

from pyspark.sql import functions as F

from entries import views as V
from entries.maintenance import STATUS, commits
from entries.search import NOW
from quarry.functions import fixed as X
from quarry.operators import state as S
from quarry.session import cut_lineage

c = V.CTE
RUNTIME = {"provider": "p", "model": "m1", "dimension": 1024, "store": "s", "schema_version": "hybrid_v3"}
L = lambda x: F.col(x).cast("long").alias(x)
# minutes since the last update, from seconds to days; some are unknown
AGE = "CAST(abs(c_acctbal) * 7 AS BIGINT) % 1900"
UPDATED = "CASE WHEN c_nationkey = 3 THEN 'unknown' ELSE {} END"
_BASE = ("'corpus-' || c_custkey AS corpus", f"{STATUS} AS status", "round(abs(c_acctbal) / 100, 1) AS pct")


def state(s, sf):
    at = "date_format(timestampadd(SECOND, -cast({} AS int), timestamp '{}'), \"yyyy-MM-dd'T'HH:mm:ss\")".format(AGE, NOW.replace("T", " "))
    return V.t(s, sf, "customer").selectExpr(
        *_BASE, "CAST(NULL AS BIGINT) AS indexed_files", "CAST(NULL AS BIGINT) AS total_chunks", "CASE WHEN c_nationkey < 5 THEN 'disk full' END AS error",
        "CASE WHEN c_mktsegment = 'FURNITURE' AND c_nationkey < 20 THEN 'fingerprint_mismatch' END AS reason",
        "CASE WHEN c_nationkey < 2 THEN NULL WHEN c_nationkey < 6 THEN named_struct('provider','p','model','m0','dimension',1024,'store','s','schema_version','hybrid_v3') "
        "ELSE named_struct('provider','p','model','m1','dimension',1024,'store','s','schema_version','hybrid_v3') END AS fingerprint",
        "CASE WHEN c_nationkey IN (1, 9) THEN 'assumed_v2' ELSE 'verified' END AS fingerprint_source", f"{UPDATED.format(at)} AS last_updated")


c["state"] = f"""SELECT {", ".join(_BASE)}, CASE WHEN c_nationkey < 5 THEN 'disk full' END AS error, CASE WHEN c_mktsegment='FURNITURE' AND c_nationkey < 20 THEN 'fingerprint_mismatch' END AS reason,
  CASE WHEN c_nationkey < 2 THEN NULL WHEN c_nationkey < 6 THEN 'm0' ELSE 'm1' END AS model, c_nationkey IN (1, 9) AS legacy, c_nationkey,
  CASE WHEN c_nationkey = 3 THEN NULL ELSE {AGE.replace("CAST(abs(c_acctbal) * 7 AS BIGINT)", "CAST(trunc(abs(c_acctbal) * 7) AS BIGINT)")} END AS age FROM customer"""
_VALID = f"(kind='{X.MARKER_KIND}' AND indexed_files >= 0 AND total_chunks >= 0 AND completed_at <> 'unknown' AND schema_version IS NOT NULL)"
c["last_commit"] = f"""SELECT *, {_VALID} AS ok FROM commits QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY CASE WHEN completed_at='unknown' THEN NULL ELSE completed_at END DESC NULLS LAST, run_id DESC) = 1"""
c["proof"] = f"""SELECT s.*, CASE WHEN m.corpus IS NULL THEN 'missing_marker_doc' WHEN kind <> '{X.MARKER_KIND}' THEN 'invalid_marker_kind' WHEN schema_version IS NULL OR completed_at='unknown' THEN 'invalid_payload'
  WHEN schema_version <> 'hybrid_v3' THEN 'fingerprint_mismatch' END AS proof_reason FROM state s LEFT JOIN last_commit m ON m.corpus=s.corpus"""
c["proof1"] = "SELECT *, CASE WHEN proof_reason IS NULL THEN 'valid' WHEN proof_reason='fingerprint_mismatch' THEN 'fingerprint_mismatch' ELSE 'stale_local' END AS proof FROM proof"
c["gate"] = """SELECT corpus, CASE WHEN status='requires_reindex' THEN coalesce(reason, 'requires_reindex') WHEN status NOT IN ('indexed','sync_completed') THEN 'not_ready:' || status
  WHEN legacy THEN 'legacy_unverified_fingerprint' WHEN model IS NULL THEN 'missing_fingerprint' WHEN model <> 'm1' THEN 'fingerprint_mismatch' WHEN proof <> 'valid' THEN proof_reason END AS reason FROM proof1"""
PROOF = ("commits", "state", "last_commit", "proof", "proof1")


def runtime():
    return S.fingerprint(RUNTIME)


def now():
    return F.lit(NOW).cast("timestamp")


def disk(s, sf):
    """The stored side: statuses turned by one, some corpora missing, other times and progress."""
    nxt = F.element_at(F.create_map(*[F.lit(x) for kv in zip(_RING, _RING[1:] + _RING[:1]) for x in kv]), F.col("status"))
    d = state(s, sf).withColumn("n", F.regexp_extract("corpus", "([0-9]+)$", 1).cast("int"))
    return (d.where("pct < 95").withColumn("status", F.when(F.col("pct") < 40, nxt).otherwise(F.col("status")))
            .withColumn("pct", F.when(F.col("pct") > 60, 50.0).otherwise(F.col("pct")))
            .withColumn("last_updated", F.when(F.col("error") == "disk full", F.lit("2026-01-28T23:52:00")).otherwise(F.col("last_updated"))).drop("n"))


_RING = ["indexed", "indexing", "indexfailed", "sync_completed", "requires_reindex"]


def merge(s, sf):
    st = state(s, sf)
    dead = st.where("reason IS NOT NULL").select("corpus")
    return S.state_merge(st.where("pct > 5"), disk(s, sf), dead, now()).select("corpus", "status", "pct", "winner")


_NX = "CASE status " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_RING, _RING[1:] + _RING[:1])) + " END"
c["disk"] = f"SELECT corpus, CASE WHEN pct < 40 THEN {_NX} ELSE status END AS status, CASE WHEN pct > 60 THEN 50.0::DOUBLE ELSE pct END AS pct, CASE WHEN error='disk full' THEN 480 ELSE age END AS age FROM state WHERE pct < 95 AND reason IS NULL"
_CL = lambda x: f"CASE WHEN {x}='indexing' THEN 3 WHEN {x} IN ('indexfailed','requires_reindex') THEN 2 ELSE 1 END"
c["mrg"] = f"""SELECT coalesce(l.corpus, d.corpus) AS corpus, l.status AS ls, d.status AS ds, l.pct AS lp, d.pct AS dp, l.age AS la, d.age AS da, {_CL('l.status')} AS cl, {_CL('d.status')} AS cd,
  l.status='indexing' AND coalesce(l.age > 600, true) AS lst, d.status='indexing' AND coalesce(d.age > 600, true) AS dst, l.corpus IS NULL AS nol, d.corpus IS NULL AS nod
  FROM (SELECT * FROM state WHERE pct > 5) l FULL JOIN disk d ON d.corpus=l.corpus"""
c["mrg1"] = """SELECT *, CASE WHEN nod THEN 'local' WHEN nol THEN 'disk'
  WHEN cl <> cd AND ls <> 'indexing' AND ds = 'indexing' AND la < da THEN 'local' WHEN cl <> cd AND ls = 'indexing' AND ds <> 'indexing' AND da < la THEN 'disk'
  WHEN cl <> cd AND lst AND ds <> 'indexing' THEN 'disk' WHEN cl <> cd AND dst AND ls <> 'indexing' THEN 'local' WHEN cl <> cd THEN CASE WHEN cl > cd THEN 'local' ELSE 'disk' END
  WHEN ls='indexing' AND ds='indexing' AND lst <> dst THEN CASE WHEN lst THEN 'disk' ELSE 'local' END WHEN ls='indexing' AND ds='indexing' AND lp <> dp THEN CASE WHEN lp > dp THEN 'local' ELSE 'disk' END
  WHEN la IS NOT NULL AND da IS NOT NULL THEN CASE WHEN da < la THEN 'disk' ELSE 'local' END WHEN la IS NULL AND da IS NOT NULL THEN 'disk' ELSE 'local' END AS winner FROM mrg"""


def roots(s, sf):
    """Folders of the corpora tree as tracked roots, orders as request paths below them."""
    return V.t(s, sf, "customer").selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN '/r/n' || c_nationkey WHEN 1 THEN '/r/n' || c_nationkey || '/c' || c_custkey ELSE '/r/n' || c_nationkey || '/c' || c_custkey || '/pkg' END AS corpus", f"{STATUS} AS status").groupBy("corpus").agg(F.min("status").alias("status"))


def resolve(s, sf):
    req = V.t(s, sf, "orders").join(V.t(s, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS request_id", "'/r/n' || c_nationkey || '/c' || c_custkey || CASE WHEN o_orderstatus = 'P' THEN '/pkg/src/a.ts' WHEN o_orderstatus = 'F' THEN '' ELSE '/pkgs/b.ts' END AS path")
    return S.root_resolve(req, roots(s, sf), ["indexed", "sync_completed", "indexing", "requires_reindex"])


def events(s, sf, *more):
    return V.t(s, sf, "events").selectExpr(
        *more,
        "event_type AS profile", "CASE user_id % 3 WHEN 0 THEN 'synced' WHEN 1 THEN 'skipped_recent' END AS freshness_mode", "value AS latency_ms",
        "cast(value AS bigint) + 5 AS results_before", "cast(value AS bigint) AS results_after", "least(cast(value AS bigint), 10) AS results_returned",
        "CASE WHEN value > 50 THEN 1 ELSE 0 END AS pass_failures", "user_id % 2 = 0 AS reranker_used", "CASE WHEN event_type = 'error' AND value > 20 THEN 'timeout' END AS error")


def telemetry(s, sf):
    return S.search_telemetry(events(s, sf)).withColumn("avg_latency", F.round("avg_latency", 4))


def rolled(s, sf):
    """Parts of each hour, merged to days and these to one row a group; the sums are exact, percentiles are within 3 % of rank."""
    ev = events(s, sf, "ts")
    days = S.merge_telemetry(S.telemetry_parts(ev).withColumn("day", F.to_date("bucket")), ["profile", "freshness_mode", "day"])
    all_ = S.read_telemetry(S.merge_telemetry(days, ["profile", "freshness_mode"])).withColumn("avg_latency", F.round("avg_latency", 4))
    found = all_.select(F.col("profile").alias("p"), F.col("freshness_mode").alias("m"), "p50_latency", "p95_latency")
    each = ev.join(F.broadcast(found), (F.col("profile") == F.col("p")) & F.col("freshness_mode").eqNullSafe(F.col("m")))
    part = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    x = F.col("latency_ms")
    ok = [((part(x <= F.col(f"p{q}_latency")) >= q / 100 - 0.03) & (part(x < F.col(f"p{q}_latency")) <= q / 100 + 0.03)).alias(f"p{q}_ok") for q in (50, 95)]
    near = each.groupBy("p", "m").agg(*ok)
    return all_.join(near, (F.col("profile") == F.col("p")) & F.col("freshness_mode").eqNullSafe(F.col("m"))).drop("p", "m", "p50_latency", "p95_latency")


def run_events(s, sf):
    from entries.search import cands
    from quarry.operators import grouping, scoring
    from quarry.plans.search import choose_attempt
    c = cut_lineage(choose_attempt(cands(s, sf)), "chosen")
    att = scoring.attribution(c, ["query_id"])
    kept = c.where("reason IS NULL").withColumn("changed_mult", F.lit(1.0))
    found = grouping.group_hits(scoring.rank_candidates(scoring.score_candidates(kept)), now())
    found = grouping.diversify(grouping.rank_groups(grouping.collapse_declarations(found)))
    return S.search_events(found, att, V.queries(s, sf), "standard").select(
        "query_id", L("query_length"), L("limit_requested"), L("results_before"), L("results_after"), L("results_returned"), L("excluded"), "profile")


QUERIES = {
    "fingerprint_check": lambda s, sf: S.fingerprint_check(state(s, sf), runtime()).select("corpus", "allowed", "gate_reason", "changed"),
    "completion_proof": lambda s, sf: S.completion_proof(state(s, sf), commits(s, sf), runtime()).select("corpus", "proof", "proof_reason"),
    "recover_interrupted": lambda s, sf: S.recover_interrupted(state(s, sf), commits(s, sf), runtime(), now()).select("corpus", "status", "action", "reason", "indexed_files", "total_chunks"),
    "state_merge": merge,
    "state_report": lambda s, sf: S.state_report(state(s, sf), commits(s, sf), runtime()).select(L("bucket_order"), "bucket", "corpus", "detail"),
    "state_report_totals": lambda s, sf: S.report_totals(S.state_report(state(s, sf), commits(s, sf), runtime())).select("bucket", "corpora"),
    "root_resolve": resolve,
    "search_telemetry": telemetry,
    "telemetry_rollup": rolled,
    "search_gate": lambda s, sf: S.search_gate(state(s, sf), commits(s, sf), runtime()),
    "search_refused": lambda s, sf: S.refused(V.t(s, sf, "orders").selectExpr("o_orderkey AS query_id", "'corpus-' || (o_custkey + 20) AS corpus"), S.search_gate(state(s, sf), commits(s, sf), runtime())),
    "search_events": run_events,
}
_REPORT = """SELECT o::BIGINT AS bucket_order, ['Ready','Indexing','Requires Reindex','Failed'][o+1] AS bucket, corpus,
  CASE WHEN status='indexing' THEN printf('%.1f', pct) || '%' WHEN status='requires_reindex' THEN coalesce(reason,'unknown') WHEN status='indexfailed' THEN coalesce(error,'unknown')
   WHEN proof='fingerprint_mismatch' THEN 'completion_proof_fingerprint_mismatch' WHEN proof='stale_local' THEN 'stale_local:' || proof_reason END AS detail FROM (
  SELECT *, CASE WHEN status IN ('indexed','sync_completed') AND proof='valid' THEN 0 WHEN status='indexing' THEN 1 WHEN status='requires_reindex' OR (status IN ('indexed','sync_completed') AND proof='fingerprint_mismatch') THEN 2 ELSE 3 END AS o FROM proof1)"""


def _run_events_sql():
    from entries.search import GROUPED, SCORED
    return V.sql("""SELECT q.query_id, length(q.raw) AS query_length, q.result_limit::BIGINT AS limit_requested, coalesce(b,0) AS results_before, coalesce(a,0) AS results_after, coalesce(r,0) AS results_returned,
      greatest(0, coalesce(b,0)-coalesce(a,0)) AS excluded, 'standard' AS profile FROM queries_v q LEFT JOIN (SELECT c.query_id, count(*) AS b, count(*) FILTER (reason IS NULL) AS a FROM cand c JOIN att ON att.query_id=c.query_id AND use=attempt GROUP BY c.query_id) x ON x.query_id=q.query_id
      LEFT JOIN (SELECT query_id, count(*) AS r FROM ranked_div GROUP BY query_id) y ON y.query_id=q.query_id""", *SCORED, *GROUPED)


SQL = {
    "fingerprint_check": V.sql("""SELECT corpus, NOT (status='requires_reindex' OR gate_reason IS NOT NULL) AS allowed, gate_reason, gate_reason IS NOT NULL AND status <> 'requires_reindex' AS changed FROM (
      SELECT *, CASE WHEN status='requires_reindex' THEN reason WHEN status IN ('indexed','sync_completed') THEN CASE WHEN legacy THEN 'legacy_unverified_fingerprint' WHEN model IS NULL THEN 'missing_fingerprint' WHEN model <> 'm1' THEN 'fingerprint_mismatch' END END AS gate_reason FROM state)""", "state"),
    "completion_proof": V.sql("SELECT corpus, proof, proof_reason FROM proof1", *PROOF),
    "recover_interrupted": V.sql("""SELECT s.corpus, CASE WHEN st AND w='valid_marker' THEN 'indexed' WHEN st THEN 'indexfailed' ELSE status END AS status, CASE WHEN st AND w='valid_marker' THEN 'promote_indexed' WHEN st THEN 'mark_failed' ELSE 'none' END AS action,
      CASE WHEN st THEN w ELSE reason END AS reason, CASE WHEN st AND w='valid_marker' THEN indexed_files END AS indexed_files, CASE WHEN st AND w='valid_marker' THEN total_chunks END AS total_chunks FROM (
      SELECT s.*, m.indexed_files, m.total_chunks, status='indexing' AND coalesce(age > 120, true) AS st, CASE WHEN m.corpus IS NULL THEN 'missing_marker' WHEN NOT ok THEN 'invalid_marker_payload' WHEN schema_version <> 'hybrid_v3' THEN 'fingerprint_mismatch' ELSE 'valid_marker' END AS w
      FROM state s LEFT JOIN last_commit m ON m.corpus=s.corpus) s""", "commits", "state", "last_commit"),
    "state_merge": V.sql("SELECT corpus, CASE WHEN winner='local' THEN ls ELSE ds END AS status, CASE WHEN winner='local' THEN lp ELSE dp END AS pct, winner FROM mrg1", "state", "disk", "mrg", "mrg1"),
    "state_report": V.sql(_REPORT, *PROOF),
    "state_report_totals": V.sql(f"SELECT bucket, count(*) AS corpora FROM ({_REPORT}) GROUP BY bucket", *PROOF),
    "root_resolve": f"""WITH roots AS (SELECT corpus, min(status) AS status FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN '/r/n' || c_nationkey WHEN 1 THEN '/r/n' || c_nationkey || '/c' || c_custkey ELSE '/r/n' || c_nationkey || '/c' || c_custkey || '/pkg' END AS corpus, {STATUS} AS status FROM customer) GROUP BY corpus),
      req AS (SELECT o_orderkey AS request_id, '/r/n' || c_nationkey || '/c' || c_custkey || CASE WHEN o_orderstatus='P' THEN '/pkg/src/a.ts' WHEN o_orderstatus='F' THEN '' ELSE '/pkgs/b.ts' END AS path FROM orders JOIN customer ON o_custkey=c_custkey),
      hit AS (SELECT request_id, arg_max(corpus, length(corpus)) AS root, arg_max(status, length(corpus)) AS status FROM req JOIN roots ON path = corpus OR starts_with(path, corpus || '/') WHERE status <> 'indexfailed' GROUP BY request_id)
      SELECT request_id, path, root, status FROM req LEFT JOIN hit USING (request_id)""",
    "search_gate": V.sql("SELECT corpus, reason IS NULL AS open, reason FROM gate", *PROOF, "gate"),
    "search_refused": V.sql("""SELECT o_orderkey AS query_id, 'corpus-' || (o_custkey + 20) AS corpus, CASE WHEN g.corpus IS NULL THEN 'not_indexed' ELSE reason END AS reason
      FROM orders LEFT JOIN gate g ON g.corpus = 'corpus-' || (o_custkey + 20) WHERE g.corpus IS NULL OR reason IS NOT NULL""", *PROOF, "gate"),
    "search_telemetry": """SELECT event_type AS profile, CASE user_id % 3 WHEN 0 THEN 'synced' WHEN 1 THEN 'skipped_recent' END AS freshness_mode, count(*) AS searches, round(avg(value),4) AS avg_latency, max(value) AS max_latency, quantile_disc(value, 0.5) AS p50_latency, quantile_disc(value, 0.95) AS p95_latency,
      CAST(sum(CAST(trunc(value) AS BIGINT)+5) AS BIGINT) AS before, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS after, CAST(sum(least(CAST(trunc(value) AS BIGINT),10)) AS BIGINT) AS returned, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS pass_failures,
      round(avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0 END),6) AS rerank_rate, round(avg(CASE WHEN event_type='error' AND value > 20 THEN 1.0 ELSE 0 END),6) AS error_rate FROM events GROUP BY 1, 2""",
    "search_events": _run_events_sql(),
}
SQL["telemetry_rollup"] = SQL["search_telemetry"].replace("quantile_disc(value, 0.5) AS p50_latency, quantile_disc(value, 0.95) AS p95_latency", "true AS p50_ok, true AS p95_ok")
