"""Columns over chunk text, ids and metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import fixed as X


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chunk_id(path, start, end, content) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", path, start, end, content), 256), 1, 16))


def symbol_id(path, start, end, label) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    named = F.concat(F.lit("sym_"), F.substring(F.sha1(F.concat_ws(":", clean, start, end, label)), 1, 16))
    return F.when(F.length(label) > 0, named)


def corpus_key(path: Column, hybrid: bool = True) -> Column:
    return F.concat(F.lit("hybrid_code_chunks_" if hybrid else "code_chunks_"), F.substring(F.md5(path), 1, 8))


def embed_text(text: Column, max_tokens: int) -> Column:
    """What a model is given: one blank for an empty text, at most four characters per token."""
    return F.when(F.length(text) == 0, F.lit(" ")).otherwise(F.substring(text, 1, max_tokens * 4))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4))


def preview(text: Column, n: int = X.PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def rerank_document(path, language, label, content) -> Column:
    head = F.array_join(F.slice(F.split(content, "\r?\n"), 1, X.RERANK_MAX_LINES), "\n")
    blank = F.lit("")
    return F.concat_ws("\n", F.coalesce(path, blank), F.coalesce(language, F.lit("unknown")),
                       F.coalesce(label, blank), F.substring(F.coalesce(head, blank), 1, X.RERANK_MAX_CHARS))


def breadcrumbs(scopes: Column) -> Column:
    """Squeezed scope labels, adjacent repeats dropped, the innermost ones kept; null when none."""
    squeezed = F.transform(scopes, lambda s: trim_ws(F.regexp_replace(s, r"\s+", " ")))
    n = X.BREADCRUMB_CHARS
    capped = F.transform(
        F.filter(squeezed, lambda s: s != ""),
        lambda s: F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("..."))),
    )
    # every label next to its predecessor, so that repeats fall out in one pass
    pairs = F.zip_with(capped, F.concat(F.array(F.lit(None).cast("string")), capped), lambda s, before: F.struct(s.alias("s"), before.alias("before")))
    distinct = F.transform(F.filter(pairs, lambda p: p["s"].isNotNull() & ~p["s"].eqNullSafe(p["before"])), lambda p: p["s"])
    last = F.slice(F.reverse(distinct), 1, X.BREADCRUMB_DEPTH)
    return F.when(F.size(last) > 0, F.reverse(last))


def staleness(indexed_at: Column, now: Column) -> Column:
    """Age bucket of an ISO timestamp string against ``now``; both without time zone."""
    at = F.try_to_timestamp(indexed_at)
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at)) / F.lit(1e6))
    return (
        F.when(at.isNull(), "unknown")
        .when(age <= X.FRESH_SECONDS, "fresh")
        .when(age <= X.AGING_SECONDS, "aging")
        .otherwise("stale")
    )


def parse_metadata(js: Column, schema: str) -> Column:
    """Fields of a JSON object string; every field null when the string is not JSON."""
    return F.from_json(js, schema, {"mode": "PERMISSIVE"})


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def regex_escape(term: Column) -> Column:
    return F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
