"""Columns over relative paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import fixed as X


def normalize_path(p: Column) -> Column:
    """Forward slashes, no empty or "." segments; null for an empty path or one with ".."."""
    segs = F.split(F.replace(F.regexp_replace(p, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(segs, lambda s: (s != "") & (s != "."))
    joined = F.nullif(F.array_join(kept, "/"), F.lit(""))
    return F.when(~F.array_contains(segs, ".."), joined)


def extension(p: Column) -> Column:
    """Last suffix with its dot; empty when there is none."""
    return F.regexp_extract(p, r"(\.[^./]+)$", 1)


def has_extension(p: Column, custom: list[str] | None = None) -> Column:
    allowed = list(X.SUPPORTED_EXTENSIONS) + [e if e.startswith(".") else "." + e for e in custom or []]
    return extension(p).isin(allowed)


def is_hidden(p: Column) -> Column:
    return p.rlike(r"(^|/)\.")


def language_of(ext: Column, fallback: str = "text") -> Column:
    known = F.create_map(*[F.lit(x) for lang, exts, _, _ in X.LANGUAGES for e in exts for x in (e, lang)])
    return F.coalesce(F.element_at(known, F.lower(ext)), F.lit(fallback))


def normalize_language(language: Column) -> Column:
    """Language id for an id or another name of it; unknown names stay, an empty one is text."""
    low = F.lower(F.trim(language))
    alias = F.create_map(*[F.lit(x) for kv in X.LANGUAGE_ALIASES.items() for x in kv])
    return F.when(F.coalesce(low, F.lit("")) == "", "text").otherwise(F.coalesce(F.element_at(alias, low), low))


def graph_capable(language: Column, ext: Column) -> Column:
    """Symbols, call graph and outline are available for this file."""
    ids = [lang for lang, _, _, sym in X.LANGUAGES if sym]
    exts = [e for _, es, _, sym in X.LANGUAGES if sym for e in es]
    return normalize_language(language).isin(ids) | F.lower(ext).isin(exts)


def _search_form(p: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/+", ""))


def _any_segment(p: Column, names: list[str]) -> Column:
    """A path that is, starts with, or passes through one of these segments."""
    return p.rlike("^(?:" + "|".join(names) + ")$") | p.rlike("(?:^|/)(?:" + "|".join(names) + ")/")


def _any(conds) -> Column:
    out = None
    for c in conds:
        out = c if out is None else out | c
    return out


def _docs(p):
    return _any_segment(p, X.DOC_SEGMENTS) | _any(p.endswith(s) for s in X.DOC_SUFFIXES)


def _tests(p):
    return _any_segment(p, X.TEST_SEGMENTS) | p.rlike(r"\.(?:test|spec)\.[^/]+$")


def _generated(p):
    return _any(p.contains(s) for s in X.GENERATED_INFIXES) | _any(p.endswith(s) for s in X.GENERATED_SUFFIXES)


def path_category(path: Column) -> Column:
    p = _search_form(path)
    base = F.element_at(F.split(p, "/"), -1)
    return (
        F.when(_docs(p), "docs")
        .when(_tests(p), "tests")
        .when(_generated(p), "generated")
        .when(_any(base.startswith(s) for s in X.ENTRY_PREFIXES), "entrypoint")
        .when(p.contains("/core/"), "core")
        .when(p.contains("/src/"), "srcRuntime")
        .otherwise("neutral")
    )


def noise_category(path: Column) -> Column:
    p = _search_form(path)
    return (
        F.when(_generated(p) | _any_segment(p, X.GENERATED_NOISE_SEGMENTS), "generated")
        .when(_tests(p), "tests")
        .when(_any_segment(p, X.FIXTURE_SEGMENTS), "fixtures")
        .when(_docs(p), "docs")
        .otherwise("runtime")
    )


def in_scope(scope: Column, category: Column) -> Column:
    quiet = category.isin("docs", "tests")
    return F.when(scope == "runtime", ~quiet).when(scope == "docs", quiet).otherwise(F.lit(True))


def ancestors(path: Column, include_self: bool = False) -> Column:
    """Segment prefixes of a path, shortest first."""
    segs = F.split(path, "/")
    n = F.size(segs) if include_self else F.size(segs) - 1
    steps = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(segs, 1, i), "/"))
