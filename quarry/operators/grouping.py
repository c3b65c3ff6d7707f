"""Group ranked candidates, collapse duplicate declarations, diversify, hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import fixed as X
from quarry.functions.ignore_rules import is_ignored, pattern_regex
from quarry.functions.paths import extension, graph_capable, noise_category, normalize_path
from quarry.functions.text import preview, staleness, trim_ws
from quarry.operators.scoring import blank_last

# --- fixed values: what a declaration looks like ---------------------------------------------
DECL_LABEL = r"^(?:(?:class|type|interface|enum|struct|function|def)(?:[^a-z0-9_]|$)|(?:const|let|var)\s+[a-z0-9_$]+\s*=)"
DECL_TEXT = (r"(?:^|[^a-z0-9_])(?:(?:class|type|interface|enum|struct|function|def)\s+[a-z0-9_]"
             r"|(?:const|let|var)\s+[a-z0-9_$]+\s*=\s*(?:(?:async\s+)?function(?:[^a-z0-9_]|$)"
             r"|(?:async\s*)?(?:\([^)]*\)|[a-z_$][a-z0-9_$]*)\s*=>))")


def group_hits(ranked: DataFrame, now: Column, key: str = "query_id") -> DataFrame:
    """One row per group: by file, by symbol, or by file and 25-line bucket.

    A query has at most 80 candidates, so a group is bounded; the best-ranked chunk speaks for it.
    """
    bucket = F.floor((F.greatest(F.lit(1), F.col("start_line")) - 1) / F.lit(X.LINE_BUCKET)).cast("string")
    has_symbol = F.length(F.coalesce(F.col("symbol_id"), F.lit(""))) > 0
    gkey = (F.when(F.col("group_by") == "file", F.concat(F.lit("file:"), F.col("path")))
            .when(has_symbol, F.concat(F.lit("symbol:"), F.col("symbol_id")))
            .otherwise(F.concat(F.lit("lines:"), F.col("path"), F.lit(":"), bucket)))
    rep = F.struct("path", "language", "symbol_id", "symbol_label", "final", "exact", "content", "pin", "reference_seeking",
                   "intent", "result_limit")
    at = F.try_to_timestamp(F.col("indexed_at"))
    g = (ranked.withColumn("_g", gkey).groupBy(key, "_g").agg(
        F.min_by(rep, "rank").alias("r"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.max_by("indexed_at", at).alias("indexed_at"), F.count(F.lit(1)).alias("chunks")))
    fallback = F.concat(F.lit("grp_"), F.substring(F.sha1(F.concat(
        F.col("r.path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"))), 1, 16))
    return g.select(
        key, F.coalesce(F.nullif(F.col("r.symbol_id"), F.lit("")), fallback).alias("group_id"), F.col("r.path").alias("path"),
        "start_line", "end_line", F.col("r.language").alias("language"), F.col("r.symbol_id").alias("symbol_id"),
        F.col("r.symbol_label").alias("symbol_label"), F.col("r.final").alias("final"), F.col("r.exact").alias("exact"),
        "indexed_at", staleness(F.col("indexed_at"), now).alias("staleness"), "chunks",
        preview(F.col("r.content")).alias("preview"), F.col("r.pin").alias("pin"),
        F.col("r.reference_seeking").alias("reference_seeking"), F.col("r.intent").alias("intent"),
        F.col("r.result_limit").alias("result_limit"))


def collapse_declarations(groups: DataFrame, key: str = "query_id") -> DataFrame:
    """For reference-seeking or identifier queries: one group per file and squeezed label among
    declaration-like groups; the best score stays."""
    label = F.lower(trim_ws(F.coalesce(F.col("symbol_label"), F.lit(""))))
    looks = label.rlike(DECL_LABEL) | F.lower(F.substring("preview", 1, 240)).rlike(DECL_TEXT)
    applies = (F.col("reference_seeking") | (F.col("intent") == "identifier")) & looks & (label != "")
    dkey = F.when(applies, F.concat(F.col("path"), F.lit("::"), F.regexp_replace(label, r"\s+", " "))).otherwise(
        F.concat(F.lit("unique:"), F.col("group_id")))
    w = W.partitionBy(key, "_d").orderBy(F.desc("final"), "path", "start_line", blank_last("symbol_label"), blank_last("symbol_id"), "group_id")
    return groups.withColumn("_d", dkey).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_d", "_n")


def rank_groups(groups: DataFrame, key: str = "query_id") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(F.col("pin") & F.col("exact")), F.desc("final"), "path", "start_line",
                                   blank_last("symbol_label"), blank_last("symbol_id"), "group_id")
    return groups.withColumn("rank", F.row_number().over(w))


def diversify(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """At most two groups per file; when that leaves places free, a third one per file.

    Adds place (1..limit), relaxed (the query needed the second round) and skipped_by_file, the
    number of times a group was passed over because of its file.
    """
    lim = F.col("result_limit")
    by_file = W.partitionBy(key, "path").orderBy("rank")
    order = W.partitionBy(key).orderBy("rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    r = ranked.withColumn("_f", F.row_number().over(by_file))
    first, third = F.col("_f") <= X.FILE_CAP, F.col("_f") == X.RELAXED_FILE_CAP
    count = lambda cond, w: F.coalesce(F.sum(cond.cast("int")).over(w), F.lit(0))
    r = (r.withColumn("_first_before", count(first, before)).withColumn("_third_before", count(third, before))
         .withColumn("_firsts", count(first, W.partitionBy(key))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))))
    s1 = F.least(lim, F.col("_firsts"))
    relaxed = s1 < F.least(lim, F.col("_n"))
    picked = (first & (F.col("_first_before") < lim)) | (relaxed & third & (s1 + F.col("_third_before") < lim))
    skipped = ((~first & (F.col("_first_before") < lim)).cast("int")
               + (relaxed & (F.col("_f") > X.RELAXED_FILE_CAP) & (s1 + F.col("_third_before") < lim)).cast("int"))
    r = (r.withColumn("relaxed", relaxed).withColumn("skipped_by_file", F.sum(skipped).over(W.partitionBy(key)))
         .withColumn("_picked", picked).withColumn("_round", F.when(first, 1).otherwise(2)).where("_picked"))
    r = r.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("_round", "rank")))
    return r.drop("_f", "_first_before", "_third_before", "_firsts", "_n", "_picked", "_round")


def noise_hint(results: DataFrame, ignore_rules: list[str] | None = None, key: str = "query_id", place: str = "place") -> DataFrame:
    """Queries whose top five files are at least 60 % noise, with shares and patterns to ignore."""
    cats = ["tests", "fixtures", "docs", "generated", "runtime"]
    top = results.where(F.col(place) <= X.NOISE_TOP).withColumn("_c", noise_category(F.col("path")))
    share = lambda c: F.count_if(F.col("_c") == c) / F.count(F.lit(1))
    noisy = F.col("_c") != "runtime"
    clean = normalize_path(F.col("path"))
    open_ = noisy & clean.isNotNull() if ignore_rules is None else noisy & clean.isNotNull() & ~is_ignored(clean, ignore_rules)
    found = [F.when(F.lit(True) if ignore_rules is None else F.bool_or(open_ & clean.rlike(pattern_regex(p))), F.lit(p)) for p in X.NOISE_PATTERNS]
    agg = top.groupBy(key).agg(
        F.count(F.lit(1)).alias("top"), *[F.round(share(c), 2).alias(c) for c in cats],
        F.count_if(noisy).alias("_noisy"), F.concat_ws(",", *found).alias("suggested"))
    return agg.where(F.col("_noisy") / F.col("top") >= X.NOISE_SHARE).drop("_noisy")


def nav_hint(groups: DataFrame, outline_ready: Column | None = None) -> DataFrame:
    """Graph support per group; otherwise a span to read, and an outline window where possible."""
    capable = graph_capable(F.coalesce(F.col("language"), F.lit("unknown")), extension(F.col("path")))
    has = F.length(F.coalesce(F.col("symbol_id"), F.lit(""))) > 0
    ok = has & capable
    start = F.greatest(F.lit(1), F.coalesce(F.col("start_line"), F.lit(1)))
    end = F.greatest(start, F.coalesce(F.col("end_line"), start))
    ext_ok = graph_capable(F.lit("unknown"), extension(F.col("path")))
    file = normalize_path(F.col("path"))
    fb = ~ok & file.isNotNull()
    return (groups.withColumn("graph_supported", ok)
            .withColumn("graph_reason", F.when(~has, "missing_symbol").when(~capable, "unsupported_language"))
            .withColumn("read_start", F.when(fb, start)).withColumn("read_end", F.when(fb, end))
            .withColumn("outline_window", fb & ext_ok & (F.lit(True) if outline_ready is None else outline_ready)))
