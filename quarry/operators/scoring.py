"""Filters, lexical evidence and final scores of candidates (one row per query and chunk)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import fixed as X
from quarry.functions.paths import in_scope, path_category
from quarry.functions.text import regex_escape, rerank_document

WORD = "[a-z0-9_]"
NOT_WORD = "[^a-z0-9_]"
SCORE_DIGITS = 12


# --- filters --------------------------------------------------------------------------------
def search_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")


def drop_reason(c: dict[str, str] | None = None) -> Column:
    """The first check a candidate fails, or null: scope, lang, path, not_path, must, exclude.

    Expects the query columns scope, lang, path_re, not_path_re, must, exclude next to the
    chunk columns path, language, symbol_label, content, category.
    """
    p = search_path(F.col("path"))
    has = lambda token: (F.coalesce(F.col("symbol_label"), F.lit("")).contains(token) | p.contains(token)
                         | F.coalesce(F.col("content"), F.lit("")).contains(token))
    language = F.lower(F.coalesce(F.col("language"), F.lit("unknown")))
    return (
        F.when(~in_scope(F.col("scope"), F.col("category")), "scope")
        .when((F.size("lang") > 0) & ~F.array_contains(F.col("lang"), language), "lang")
        .when((F.col("n_path") > 0) & ~F.exists("path_re", lambda r: F.rlike(p, r)), "path")
        .when(F.exists("not_path_re", lambda r: F.rlike(p, r)), "not_path")
        .when(~F.forall("must", has), "must")
        .when(F.exists("exclude", has), "exclude")
    )


def attribution(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """How many candidates each check removed; needs the ``reason`` column."""
    checks = ["scope", "lang", "path", "not_path", "must", "exclude"]
    return candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("before"),
        *[F.count_if(F.col("reason") == c).alias(f"removed_{c}") for c in checks],
        F.count_if(F.col("reason").isNull()).alias("after"))


# --- lexical evidence -----------------------------------------------------------------------
def _alone(term: Column, escaped: Column, word: str) -> tuple[Column, Column]:
    """What must hold before and after a literal term. The look-behind comes after the literal, so
    that the engine can search for the literal itself."""
    starts, ends = term.rlike(f"^{word}"), term.rlike(f"{word}$")
    before = F.concat(F.when(starts, f"(?<!{word}").otherwise(f"(?<={word}"), escaped, F.lit(")"))
    return before, F.when(ends, f"(?!{word})").otherwise(f"(?={word})")


def boundary(field: Column, term: Column) -> Column:
    """The term stands alone in a lower-cased field; "_" counts as a boundary here."""
    e = regex_escape(term)
    return F.rlike(field, F.concat(e, F.lit("(?<![a-z0-9]"), e, F.lit(")(?![a-z0-9])")))


def usage_kind(content: Column, term: Column) -> Column:
    """'executable', 'import' or null for a lower-cased text; "_" is a word character here."""
    e = regex_escape(term)
    before, after = _alone(term, e, WORD)
    starts, ends = term.rlike(f"^{WORD}"), term.rlike(f"{WORD}$")
    middle = F.when(starts, f"(?:.*{NOT_WORD})?").otherwise(f".*{WORD}")
    made = F.concat(F.lit(f"new(?<!{WORD}new)\\s+"), e, after)
    called = F.concat(e, before, F.lit(r"\s*\("))
    assigned = F.concat(e, before, F.lit(r"\s*="))
    imported = F.concat(F.lit(f"import(?<!{WORD}import)\\s+"), middle, e, after)
    # a usage needs the term in the text at all, which spares most of the pattern work
    return F.when(content.contains(term), F.when(
        F.rlike(content, made) | F.rlike(content, called) | (ends & F.rlike(content, assigned)), F.lit("executable"))
        .when(F.rlike(content, imported), F.lit("import")))


def may_declare(content: Column) -> Column:
    """Cheap test, once per text: there is a declaration keyword at all."""
    return content.rlike(r"(?:class|def|function|type|interface|enum|struct|const|let|var)\s")


def declares(content: Column, term: Column) -> Column:
    """The lower-cased text declares the term."""
    e = regex_escape(term)
    after = F.when(term.rlike(f"{WORD}$"), f"(?:{NOT_WORD}|$)").otherwise(WORD)
    named = F.concat(F.lit(f"(?:^|{NOT_WORD})(?:class|def|function|type|interface|enum|struct)\\s+"), e, after)
    bound = F.concat(F.lit(f"(?:^|{NOT_WORD})(?:const|let|var)\\s+"), e,
                     F.lit(rf"\s*=\s*(?:(?:async\s+)?function(?:{NOT_WORD}|$)|(?:async\s*)?(?:\([^)]*\)|[a-z_$][a-z0-9_$]*)\s*=>)"))
    return content.contains(term) & (F.rlike(content, named) | (term.rlike(f"{WORD}$") & F.rlike(content, bound)))


def term_tiers(terms: Column, reference_seeking: Column, strict: Column, label: Column, path: Column, content: Column,
               decl: Column) -> Column:
    """Per term the tier it reaches in one chunk: ARRAY<STRUCT<tier, declared, factor, whole>>.

    label, path and content must be lower-cased columns, so that this work is not repeated per term;
    ``decl`` says whether a declaration is to be looked for.
    """
    segments = F.split(path, "/")

    def one(t):
        v = t["value"]
        use = F.when(reference_seeking, usage_kind(content, v))
        declared = F.when(decl, declares(content, v)).otherwise(False)
        tier = (
            F.when((use == "executable") & ~declared, "executable")
            .when((use == "import") & ~declared, "import")
            .when(label.contains(v) & boundary(label, v), "label_boundary")
            .when(path.contains(v) & F.exists(segments, lambda s: boundary(s, v)), "path_boundary")
            .when(content.contains(v) & boundary(content, v), "content_boundary")
            .when(label.contains(v), "label_part")
            .when(path.contains(v), "path_part")
            .when(content.contains(v), "content_part")
        )
        return F.struct(tier.alias("tier"), declared.alias("declared"),
                        F.when(t["kind"] == "whole", 1.0).otherwise(strict).alias("factor"), (t["kind"] == "whole").alias("whole"))

    return F.transform(terms, one)


def tier_points(s: Column, reference_seeking: Column) -> Column:
    out = F.lit(0.0)
    for name, (normal, ref, ref_declared) in X.EVIDENCE_TIERS.items():
        val = F.lit(ref) if normal is None else F.when(
            reference_seeking, F.when(s["declared"], ref_declared).otherwise(ref)).otherwise(normal)
        out = F.when(s["tier"] == name, val).otherwise(out)
    return out * s["factor"]


def lexical_evidence(candidates: DataFrame) -> DataFrame:
    """Adds lexical (best tier over all terms, times the query's weight) and exact."""
    blank, ref = F.lit(""), F.col("reference_seeking")
    strict = F.when(ref | (F.col("intent") == "identifier"), X.FRAGMENT_FACTOR_STRICT).otherwise(X.FRAGMENT_FACTOR)
    c = candidates.withColumns({
        "_label": F.lower(F.coalesce("symbol_label", blank)), "_path": F.lower(F.coalesce("path", blank)),
        "_text": F.lower(F.coalesce("content", blank))})
    c = c.withColumn("_decl", F.when(ref, may_declare(F.col("_text"))).otherwise(False))
    c = c.withColumn("_seen", term_tiers(F.col("terms"), ref, strict, F.col("_label"), F.col("_path"), F.col("_text"), F.col("_decl")))
    best = F.coalesce(F.array_max(F.transform("_seen", lambda s: tier_points(s, ref))), F.lit(0.0))
    exact = F.exists("_seen", lambda s: s["whole"] & F.coalesce(s["tier"].isin("label_boundary", "path_boundary"), F.lit(False))) & ~ref
    return (c.withColumn("lexical", best * F.col("lexical_weight")).withColumn("exact", F.coalesce(exact, F.lit(False)))
            .drop("_label", "_path", "_text", "_decl", "_seen"))


# --- multipliers and final score ------------------------------------------------------------
def path_multiplier(scope: Column, category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for s, cats in X.SCOPE_MULTIPLIERS.items() for c, m in cats.items() for x in (f"{s}/{c}", m)])
    return F.element_at(table, F.concat(scope, F.lit("/"), category))


def changed_multiplier(candidates: DataFrame, changed: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    """Adds changed_mult: 1.10 for a changed path while 1 to 50 files changed, else 1.

    ``changed`` has the key columns; the count is taken per corpus when that is a key.
    """
    group = [k for k in keys if k != "path"]
    distinct = changed.select(*keys).distinct()
    counts = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else None
    if group:
        small = counts.where(F.col("_n") <= X.CHANGED_MAX_FILES).select(*group)
        marked = distinct.join(small, group, "left_semi")
    else:
        total = distinct.limit(X.CHANGED_MAX_FILES + 1).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
        marked = distinct.where(total <= X.CHANGED_MAX_FILES)
    return (candidates.join(marked.withColumn("_changed", F.lit(True)), keys, "left")
            .withColumn("changed_mult", F.when(F.col("_changed"), X.CHANGED_BOOST).otherwise(1.0)).drop("_changed"))


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Adds lexical, exact, path_mult and final to candidates with fusion and changed_mult."""
    c = lexical_evidence(candidates).withColumn("path_mult", path_multiplier(F.col("scope"), F.col("category")))
    return c.withColumn("final", final_score())


def final_score() -> Column:
    return F.round((F.col("fusion") + F.col("lexical")) * F.col("path_mult") * F.col("changed_mult"), SCORE_DIGITS)


def blank_last(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("")).asc_nulls_last()


def candidate_order(pinned: bool) -> list[Column]:
    order = [F.desc("final"), blank_last("path"), F.col("start_line").asc_nulls_last(), blank_last("symbol_label"),
             blank_last("symbol_id"), F.asc("chunk_id")]
    return ([F.desc(F.col("pin") & F.col("exact"))] if pinned else []) + order


def rank_candidates(scored: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds rank, and pinning_applied: pinning exact matches changed the exactness of the top row."""
    w = W.partitionBy(key)
    r = scored.withColumn("rank", F.row_number().over(w.orderBy(*candidate_order(True)))).withColumn(
        "_plain", F.row_number().over(w.orderBy(*candidate_order(False))))
    top = F.max(F.when(F.col("rank") == 1, F.col("exact"))).over(w)
    plain = F.max(F.when(F.col("_plain") == 1, F.col("exact"))).over(w)
    return r.withColumn("pinning_applied", F.col("pin") & (top != plain)).drop("_plain")


def rerank(ranked: DataFrame, ranks: DataFrame, key: str = "query_id") -> DataFrame:
    """Fuse an outside order of the top 50 into the scores and rank again.

    ``ranks`` has (key, idx, new_rank): idx is the zero-based place in the current order. Rows of
    queries that may not be reranked (docs scope, identifier intent), places outside the top 50
    and repeated places are left as they were; so is everything when ``ranks`` is empty.
    """
    ok = (ranks.where((F.col("idx") >= 0) & (F.col("idx") < X.RERANK_TOP))
          .groupBy(key, "idx").agg(F.min("new_rank").alias("new_rank")))
    j = ranked.withColumn("idx", F.col("rank") - 1).join(ok, [key, "idx"], "left")
    allowed = F.col("rerank_allowed") & (F.col("scope") != "docs")
    j = j.withColumn("fusion", F.when(allowed & F.col("new_rank").isNotNull(),
                                      F.col("fusion") + F.lit(1.0) / (F.lit(X.RERANK_RRF_K) + F.col("new_rank"))).otherwise(F.col("fusion")))
    return rank_candidates(j.withColumn("final", final_score()).drop("idx", "new_rank", "rank", "pinning_applied"), key)


def ranks_from_scores(ranked: DataFrame, score, key: str = "query_id") -> DataFrame:
    """(key, idx, new_rank) for ``rerank`` from a scorer ``(query Column, document Column) -> Column``,
    usually ``model_scorer``. Only the top 50 of queries that may be reranked are scored."""
    top = ranked.where((F.col("rank") <= X.RERANK_TOP) & F.col("rerank_allowed") & (F.col("scope") != "docs"))
    doc = rerank_document(F.col("path"), F.col("language"), F.col("symbol_label"), F.col("content"))
    s = top.select(key, (F.col("rank") - 1).alias("idx"), score(F.col("semantic"), doc).alias("_s")).where("_s IS NOT NULL")
    return s.withColumn("new_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_s"), "idx"))).drop("_s")


def model_scorer(load):
    """``load`` runs once per Python worker and gives a function over (queries, documents) lists."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, d in batches:
            yield pd.Series(model(q.tolist(), d.tolist()), index=q.index, dtype="float64")

    return run


def with_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", path_category(F.col("path")))
