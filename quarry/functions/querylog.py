"""Analysis of a table of raw queries: operators, intent, lexical terms, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import fixed as X
from quarry.functions.ignore_rules import glob_regex_column
from quarry.functions.text import trim_ws

# --- fixed values: patterns -----------------------------------------------------------------
TOKEN = r'((?:\\[\s\S]?|"(?:\\[\s\S]|[^"\\])*(?:"|\\?\z)|[^\s"\\])+)'
OPERATOR = r"^(lang|path|-path|must|exclude):"
REFERENCE_WORDS = (r"(?:^|[^A-Za-z0-9_])(?:used|uses|usage|reference|references|referenced|callers?|called|"
                   r"imports?|imported|instantiat(?:e|ed|ion))(?:[^A-Za-z0-9_]|$)")
REFERENCE_PHRASES = r"(?:^|[^A-Za-z0-9_])(?:where\s+is|who\s+uses)(?:[^A-Za-z0-9_]|$)"


def _unquote(v: Column) -> Column:
    t = trim_ws(v)
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    plain = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when((F.length(t) >= 2) & t.startswith('"') & t.endswith('"'), plain).otherwise(t)


def parse_operators(queries: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds semantic, lang, path, not_path, must and exclude columns to a query table.

    Operators are read from the prefix block only: the first 200 characters, or less when a
    blank line comes earlier. That window is part of the query language.
    """
    q = F.col(raw)
    window = F.substring(q, 1, X.OPERATOR_WINDOW)
    blank = F.instr(window, "\n\n")
    q2 = queries.withColumn("_prefix", F.when(blank > 0, F.substring(q, F.lit(1), blank - 1)).otherwise(window)).withColumn(
        "_suffix",
        trim_ws(F.when(blank > 0, F.substring(q, blank + 2, F.length(q))).otherwise(F.substring(q, X.OPERATOR_WINDOW + 1, 1 << 30))),
    )
    q2 = q2.withColumn("_tokens", F.regexp_extract_all("_prefix", F.lit(TOKEN), F.lit(1)))
    tokens = F.col("_tokens")

    def values(key):
        own = F.filter(tokens, lambda t: t.startswith(key + ":"))
        vals = F.transform(own, lambda t: _unquote(F.substring(t, F.lit(len(key) + 2), F.length(t))))
        return F.filter(vals, lambda v: F.length(v) > 0)

    literal = F.filter(tokens, lambda t: ~t.rlike(OPERATOR))
    residual = F.transform(
        literal, lambda t: F.when(t.startswith("\\") & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t))).otherwise(t))
    head = trim_ws(F.array_join(residual, " "))
    both = F.array_join(F.filter(F.array(head, F.col("_suffix")), lambda s: F.length(s) > 0), "\n")
    slashed = lambda c: F.transform(c, lambda v: F.replace(v, F.lit("\\"), F.lit("/")))
    out = (
        q2.withColumn("lang", F.transform(values("lang"), F.lower))
        .withColumn("path", slashed(values("path")))
        .withColumn("not_path", slashed(values("-path")))
        .withColumn("must", values("must"))
        .withColumn("exclude", values("exclude"))
        .withColumn("semantic", F.when(F.length(both) > 0, both).otherwise(trim_ws(q)))
    )
    return out.drop("_prefix", "_suffix", "_tokens")


def _identifier_like(t: Column) -> Column:
    return t.rlike(r"[A-Z0-9_/\\.:-]")


def analyze(queries: DataFrame, hybrid: bool = True) -> DataFrame:
    """Adds intent, confidence, reasons, reference_seeking, terms, mode, weight, pin, rerank_allowed."""
    stop = F.array(*[F.lit(w) for w in X.STOPWORDS])
    tokens = F.filter(F.split("semantic", r"\s+"), lambda t: t != "")
    q = queries.withColumn("_t", tokens)
    ident = F.filter("_t", _identifier_like)
    natural = F.filter("_t", lambda t: ~_identifier_like(t) & (F.array_contains(stop, F.lower(t)) | (F.length(t) >= 4)))
    q = q.withColumn("_ident", ident).withColumn("_n_nat", F.size(natural))
    low = F.lower("semantic")
    q = q.withColumn("reference_seeking", low.rlike(REFERENCE_WORDS) | low.rlike(REFERENCE_PHRASES))
    n, n_id = F.size("_t"), F.size("_ident")
    first = F.get("_t", 0)
    bare = (n == 1) & first.rlike("^[a-z][a-z0-9]{2,63}$") & ~F.array_contains(stop, F.lower(first))
    mixed, only_id = (n_id > 0) & (F.col("_n_nat") > 0), n_id > 0
    prose = (F.col("_n_nat") >= 2) | (n >= 4)
    q = (
        q.withColumn("intent", F.when(mixed, "mixed").when(only_id, "identifier").when(bare, "uncertain")
                     .when(prose, "semantic").otherwise("uncertain"))
        .withColumn("confidence",
                    F.when(mixed, F.when(n_id >= 2, "high").otherwise("medium"))
                    .when(only_id, F.when(n == n_id, "high").otherwise("medium"))
                    .when(bare, "medium").when(prose, "high").otherwise("low"))
        .withColumn("reasons", F.concat_ws(
            ",",
            F.when(mixed, "identifier_terms_present,natural_language_terms_present")
            .when(only_id, F.when(n == 1, "single_identifier_token").otherwise("identifier_tokens_present"))
            .when(bare, "single_term_lookup").when(prose, "natural_language_query").otherwise("ambiguous_short_query"),
            F.when(F.col("reference_seeking"), F.lit("reference_seeking_query"))))
    )
    q = q.withColumn("terms", lexical_terms(F.when(n_id > 0, F.col("_ident")).otherwise(F.col("_t"))))
    i, ref = F.col("intent"), F.col("reference_seeking")
    w = X.LEXICAL_WEIGHTS
    return (
        q.withColumn("mode", F.when(i == "identifier", "lexical").otherwise("hybrid") if hybrid else F.lit("dense"))
        .withColumn("lexical_weight", F.when(i == "identifier", w["identifier"])
                    .when(i == "mixed", F.when(ref, w["mixed_ref"]).otherwise(w["mixed"]))
                    .when(i == "uncertain", w["uncertain"]).otherwise(w["semantic"]))
        .withColumn("pin", (i != "semantic") & ~ref)
        .withColumn("rerank_allowed", i != "identifier")
        .drop("_t", "_ident", "_n_nat")
    )


def lexical_terms(tokens: Column) -> Column:
    """Up to eight distinct (value, kind) terms in first-seen order; a whole token beats a fragment."""
    clean = lambda c: F.lower(trim_ws(F.regexp_replace(F.regexp_replace(c, "^['\"`]+|['\"`]+$", ""), r"[(){}\[\],;]+", " ")))

    def expand(t):
        spaced = F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2")
        spaced = F.lower(F.regexp_replace(F.regexp_replace(spaced, r"[/\\._:-]+", " "), r"[(){}\[\],;]+", " "))
        parts = F.filter(F.split(spaced, r"\s+"), lambda p: F.length(p) >= 2)
        whole = F.struct(clean(t).alias("value"), F.lit("whole").alias("kind"))
        frags = F.transform(parts, lambda p: F.struct(clean(p).alias("value"), F.lit("fragment").alias("kind")))
        return F.concat(F.array(whole), frags)

    stop = F.array(*[F.lit(w) for w in X.STOPWORDS])
    every = F.flatten(F.transform(tokens, expand))
    whole = F.transform(F.filter(every, lambda t: t["kind"] == "whole"), lambda t: t["value"])
    order = F.filter(F.array_distinct(F.transform(every, lambda t: t["value"])),
                     lambda v: (v != "") & ~F.array_contains(stop, v))
    return F.transform(
        F.slice(order, 1, X.MAX_LEXICAL_TERMS),
        lambda v: F.struct(v.alias("value"), F.when(F.array_contains(whole, v), "whole").otherwise("fragment").alias("kind")))


def path_regexes(patterns: Column) -> Column:
    return F.filter(F.transform(patterns, lambda p: glob_regex_column(p)), lambda r: r.isNotNull())
