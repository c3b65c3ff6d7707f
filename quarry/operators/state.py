"""Index state per corpus: gates, proofs, recovery, merging, reports, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import fixed as X
from quarry.functions.paths import ancestors
from quarry.sources.tables import FINGERPRINT, latest_commits, valid_commit

SEARCHABLE = ["indexed", "sync_completed"]


def fingerprint(values: dict) -> Column:
    """The running system's fingerprint as a struct."""
    types = {"dimension": "int"}
    return F.struct(*[F.lit(values[k]).cast(types.get(k, "string")).alias(k) for k in FINGERPRINT])


def same_fingerprint(a: Column, b: Column) -> Column:
    return F.coalesce(F.forall(F.array(*[a[k].eqNullSafe(b[k]) for k in FINGERPRINT]), lambda x: x) & a.isNotNull(), F.lit(False))


def fingerprint_check(state: DataFrame, runtime: Column) -> DataFrame:
    """Adds allowed, and why not: an earlier verdict, legacy, missing or mismatch, in that order."""
    ready = F.col("status").isin(SEARCHABLE)
    found = (F.when(F.col("status") == "requires_reindex", F.col("reason"))
             .when(ready & (F.col("fingerprint_source") == "assumed_v2"), "legacy_unverified_fingerprint")
             .when(ready & F.col("fingerprint").isNull(), "missing_fingerprint")
             .when(ready & ~same_fingerprint(F.col("fingerprint"), runtime), "fingerprint_mismatch"))
    blocked = (F.col("status") == "requires_reindex") | found.isNotNull()
    return state.withColumn("allowed", ~blocked).withColumn("gate_reason", found).withColumn("changed", blocked & (F.col("status") != "requires_reindex"))


def completion_proof(state: DataFrame, commits: DataFrame, runtime: Column) -> DataFrame:
    """Adds proof (valid, stale_local or fingerprint_mismatch) and proof_reason from the newest record."""
    last = latest_commits(commits)
    m = last.select("corpus", F.struct(*[c for c in last.columns if c != "corpus"]).alias("_m"))
    j = state.join(m, "corpus", "left")
    f = F.col("_m")
    shape = f["fingerprint"].isNull() | f["indexed_files"].isNull() | f["total_chunks"].isNull() | F.try_to_timestamp(f["completed_at"]).isNull()
    bad_path = (F.length(F.trim(f["marker_path"])) == 0) | f["marker_path"].isNull() if "marker_path" in commits.columns else F.lit(False)
    other = f["marker_path"] != F.col("corpus") if "marker_path" in commits.columns else F.lit(False)
    reason = (F.when(f.isNull(), "missing_marker_doc").when(~f["kind"].eqNullSafe(F.lit(X.MARKER_KIND)), "invalid_marker_kind")
              .when(bad_path | shape, "invalid_payload").when(other, "path_mismatch")
              .when(~same_fingerprint(f["fingerprint"], runtime), "fingerprint_mismatch"))
    return j.withColumn("proof_reason", reason).withColumn(
        "proof", F.when(F.col("proof_reason").isNull(), "valid").when(F.col("proof_reason") == "fingerprint_mismatch", "fingerprint_mismatch").otherwise("stale_local")).drop("_m")


def search_gate(state: DataFrame, commits: DataFrame, runtime: Column) -> DataFrame:
    """(corpus, open, reason): may a corpus be searched, and if not, why: its fingerprint, its status, its completion proof, in that order."""
    j = fingerprint_check(completion_proof(state, commits, runtime), runtime)
    reason = (F.when(~F.col("allowed"), F.coalesce("gate_reason", F.lit("requires_reindex")))
              .when(~F.col("status").isin(SEARCHABLE), F.concat(F.lit("not_ready:"), F.col("status")))
              .when(F.col("proof") != "valid", F.col("proof_reason")))
    return j.select("corpus", reason.isNull().alias("open"), reason.alias("reason"))


def refused(queries: DataFrame, gate: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries (key, corpus) that get no answer, with the reason; a corpus without a state is not indexed."""
    j = queries.select(key, "corpus").join(gate, "corpus", "left")
    return j.where(~F.coalesce("open", F.lit(False))).select(key, "corpus", F.when(F.col("open").isNull(), F.lit("not_indexed")).otherwise(F.col("reason")).alias("reason"))


def age_seconds(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.try_to_timestamp(at))) / F.lit(1e6)


def recover_interrupted(state: DataFrame, commits: DataFrame, runtime: Column, now: Column, grace: float = X.RECOVERY_GRACE_SECONDS) -> DataFrame:
    """Indexing rows without news for two minutes become indexed when their newest record proves it,
    else failed with a reason; all other rows pass. Adds action."""
    last = latest_commits(commits.withColumn("_ok", valid_commit()))
    m = last.select("corpus", F.col("_ok"), F.col("fingerprint").alias("_f"), F.col("indexed_files").alias("_files"), F.col("total_chunks").alias("_chunks"))
    age = age_seconds(F.col("last_updated"), now)
    stale = (F.col("status") == "indexing") & (age.isNull() | (age > grace))
    why = (F.when(F.col("_ok").isNull(), "missing_marker").when(~F.col("_ok"), "invalid_marker_payload")
           .when(~same_fingerprint(F.col("_f"), runtime), "fingerprint_mismatch").otherwise("valid_marker"))
    j = state.join(m, "corpus", "left").withColumn("_stale", stale).withColumn("_why", why)
    good = F.col("_stale") & (F.col("_why") == "valid_marker")
    return (j.withColumn("action", F.when(good, "promote_indexed").when(F.col("_stale"), "mark_failed").otherwise("none"))
            .withColumn("status", F.when(good, "indexed").when(F.col("_stale"), "indexfailed").otherwise(F.col("status")))
            .withColumn("reason", F.when(F.col("_stale"), F.col("_why")).otherwise(F.col("reason")))
            .withColumn("indexed_files", F.when(good, F.col("_files")).otherwise(F.col("indexed_files")))
            .withColumn("total_chunks", F.when(good, F.col("_chunks")).otherwise(F.col("total_chunks")))
            .drop("_ok", "_f", "_files", "_chunks", "_stale", "_why"))


def state_merge(local: DataFrame, disk: DataFrame, tombstones: DataFrame, now: Column) -> DataFrame:
    """One row per corpus from two state tables (corpus, status, pct, last_updated, …same columns).

    A stored corpus with a tombstone is gone unless it is known locally. Which side wins: a newer
    transition out of indexing, else the side that is not a stale indexing row, else the higher
    class (active, bad, searchable); within a class more progress, then the newer row.
    """
    cols = [c for c in local.columns if c != "corpus"]
    a = local.select("corpus", F.struct(*cols).alias("l"))
    b = disk.join(tombstones.select("corpus").distinct(), "corpus", "left_anti").select("corpus", F.struct(*cols).alias("d"))
    j = a.join(b, "corpus", "full_outer")
    lt, dt = F.try_to_timestamp(F.col("l.last_updated")), F.try_to_timestamp(F.col("d.last_updated"))
    li, di = F.col("l.status") == "indexing", F.col("d.status") == "indexing"
    cls = lambda s: F.when(F.col(s) == "indexing", 3).when(F.col(s).isin("indexfailed", "requires_reindex"), 2).otherwise(1)
    old = lambda s, is_idx: is_idx & F.coalesce(age_seconds(F.col(s), now) > X.INDEXING_STALE_SECONDS, F.lit(True))
    ls, ds = old("l.last_updated", li), old("d.last_updated", di)
    newer_l, newer_d = F.coalesce(lt > dt, F.lit(False)), F.coalesce(dt > lt, F.lit(False))
    cl, cd = cls("l.status"), cls("d.status")
    by_time = F.when(lt.isNotNull() & dt.isNotNull(), F.when(dt > lt, "d").otherwise("l")).when(dt.isNotNull() & lt.isNull(), "d").otherwise("l")
    winner = (
        F.when(F.col("d").isNull(), "l").when(F.col("l").isNull(), "d")
        .when((cl != cd) & ~li & di & newer_l, "l").when((cl != cd) & li & ~di & newer_d, "d")
        .when((cl != cd) & ls & ~di, "d").when((cl != cd) & ds & ~li, "l")
        .when(cl != cd, F.when(cl > cd, "l").otherwise("d"))
        .when(li & di & (ls != ds), F.when(ls, "d").otherwise("l"))
        .when(li & di & ~F.col("l.pct").eqNullSafe(F.col("d.pct")), F.when(F.col("l.pct") > F.col("d.pct"), "l").otherwise("d"))
        .otherwise(by_time))
    j = j.withColumn("_w", winner).withColumn("_r", F.when(F.col("_w") == "l", F.col("l")).otherwise(F.col("d")))
    return j.select("corpus", "_r.*", F.when(F.col("_w") == "l", "local").otherwise("disk").alias("winner"))


def state_report(state: DataFrame, commits: DataFrame, runtime: Column) -> DataFrame:
    """(bucket, bucket_order, corpus, detail): Ready, Indexing, Requires Reindex or Failed, after the
    completion proof of searchable corpora. Order by bucket_order and corpus to list them."""
    p = completion_proof(state, commits, runtime)
    ready = F.col("status").isin(SEARCHABLE)
    order = (F.when(ready & (F.col("proof") == "valid"), 0).when(F.col("status") == "indexing", 1)
             .when((F.col("status") == "requires_reindex") | (ready & (F.col("proof") == "fingerprint_mismatch")), 2).otherwise(3))
    names = F.array(*map(F.lit, ["Ready", "Indexing", "Requires Reindex", "Failed"]))
    detail = (F.when(F.col("status") == "indexing", F.format_string("%.1f%%", F.coalesce("pct", F.lit(0.0))))
              .when(F.col("status") == "requires_reindex", F.coalesce("reason", F.lit("unknown")))
              .when(F.col("status") == "indexfailed", F.coalesce("error", F.lit("unknown")))
              .when(F.col("proof") == "fingerprint_mismatch", "completion_proof_fingerprint_mismatch")
              .when(F.col("proof") == "stale_local", F.concat(F.lit("stale_local:"), "proof_reason")))
    return p.select(order.alias("bucket_order"), F.get(names, order).alias("bucket"), "corpus", detail.alias("detail"))


def report_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("bucket_order", "bucket").agg(F.count(F.lit(1)).alias("corpora"))


def root_resolve(requests: DataFrame, state: DataFrame, statuses: list[str]) -> DataFrame:
    """The longest tracked root that is the request path or a folder above it: an equi join on the
    path's own ancestors. Requests: (request_id, path)."""
    roots = state.where(F.col("status").isin(statuses)).select(F.col("corpus").alias("root"), "status")
    up = requests.select("request_id", "path", F.explode(ancestors(F.col("path"), include_self=True)).alias("root"))
    best = up.join(roots, "root").groupBy("request_id").agg(F.max_by(F.struct("root", "status"), F.length("root")).alias("r"))
    return requests.join(best, "request_id", "left").select("request_id", "path", F.col("r.root").alias("root"), F.col("r.status").alias("status"))


def search_telemetry(events: DataFrame) -> DataFrame:
    """Roll-up of search events by profile and freshness mode; percentiles are values that occur, exactly."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return events.groupBy("profile", "freshness_mode").agg(
        F.count(F.lit(1)).alias("searches"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"), F.max("latency_ms").alias("max_latency"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("p50_latency"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_latency"),
        F.sum("results_before").alias("before"), F.sum("results_after").alias("after"), F.sum("results_returned").alias("returned"),
        F.sum("pass_failures").alias("pass_failures"), share(F.col("reranker_used")).alias("rerank_rate"), share(F.col("error").isNotNull()).alias("error_rate"))


#: Size parameter of the quantile sketches; at 200 a value's rank is off by about 1.3 % of the rows with 99 % confidence.
SKETCH_K = 200
SUMS = ["searches", "timed", "latency", "before", "after", "returned", "pass_failures", "reranked", "errors"]


def telemetry_parts(events: DataFrame, time: str = "ts", every: str = "1 hour") -> DataFrame:
    """Mergeable roll-up rows by profile, freshness mode and time bucket: counts, sums, the maximum, a quantile sketch of the latency.

    A sketch has a bounded size whatever the rows, and parts are added up before the shuffle. ``merge_telemetry`` puts parts of any
    buckets, batches or streams together.
    """
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return events.groupBy("profile", "freshness_mode", F.window(time, every)["start"].alias("bucket")).agg(
        F.count(F.lit(1)).alias("searches"), F.count("latency_ms").alias("timed"), F.sum("latency_ms").alias("latency"), F.max("latency_ms").alias("max_latency"),
        F.sum("results_before").alias("before"), F.sum("results_after").alias("after"), F.sum("results_returned").alias("returned"),
        F.sum("pass_failures").alias("pass_failures"), flag(F.col("reranker_used")).alias("reranked"), flag(F.col("error").isNotNull()).alias("errors"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def merge_telemetry(parts: DataFrame, by: list[str]) -> DataFrame:
    """Parts put together by some of their columns; the result is parts again."""
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("max_latency").alias("max_latency"),
                                  F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def read_telemetry(parts: DataFrame) -> DataFrame:
    """Parts with the columns of ``search_telemetry``; percentiles are values that occur, within the sketch's error of rank."""
    n = F.col("searches")
    share = lambda c: F.round(F.col(c) / n, 6)
    at = lambda q: F.when(F.col("max_latency").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return parts.select(*[c for c in parts.columns if c not in (*SUMS, "max_latency", "sketch")], "searches", F.round(F.try_divide("latency", "timed"), 6).alias("avg_latency"), "max_latency",
                        at(0.5).alias("p50_latency"), at(0.95).alias("p95_latency"), "before", "after", "returned", "pass_failures",
                        share("reranked").alias("rerank_rate"), share("errors").alias("error_rate"))


def search_events(results: DataFrame, attribution: DataFrame, queries: DataFrame, profile: str, key: str = "query_id") -> DataFrame:
    """One telemetry row per query of a search run: sizes before and after filters, rows returned."""
    got = results.groupBy(key).agg(F.count(F.lit(1)).alias("results_returned"))
    return (queries.select(key, F.length("raw").alias("query_length"), F.col("result_limit").alias("limit_requested"))
            .join(attribution.select(key, F.col("before").alias("results_before"), F.col("after").alias("results_after")), key, "left")
            .join(got, key, "left").na.fill(0, ["results_before", "results_after", "results_returned"])
            .withColumn("excluded", F.greatest(F.lit(0), F.col("results_before") - F.col("results_after"))).withColumn("profile", F.lit(profile)))
