"""gitignore-style rules as Column expressions.

Rules are configuration: a short, ordered list known on the driver. Each rule becomes a
regular expression, and neighbouring rules of one sign become one alternation, so a list
without negations costs a single ``rlike`` per path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Rule:
    regex: str      # matches the path of an entry; directories are tested with a trailing "/"
    negate: bool


def _glob(body: str) -> str:
    """Regex text of one glob body without a leading or trailing slash."""
    parts = []
    segments = body.split("/")
    for i, seg in enumerate(segments):
        last = i == len(segments) - 1
        if seg == "**":
            parts.append(".+" if last else "(?:[^/]+/)*")
            continue
        if seg and not seg.strip("*"):      # a whole name, which is not empty: src/* is not src/ itself
            parts.append("[^/]+" + ("" if last else "/"))
            continue
        out, j = "", 0
        while j < len(seg):
            c = seg[j]
            if c == "\\" and j + 1 < len(seg):
                out += re.escape(seg[j + 1])
                j += 1
            elif c == "*":
                while seg[j + 1 : j + 2] == "*":
                    j += 1
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and "]" in seg[j + 2 :]:
                end = seg.index("]", j + 2)
                inner = seg[j + 1 : end]
                out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
                j = end
            else:
                out += re.escape(c)
            j += 1
        parts.append(out + ("" if last else "/"))
    return "".join(parts)


def compile_rules(patterns: list[str]) -> list[Rule]:
    """Ordered rules; comments and blank lines dropped, later duplicates kept once."""
    rules: list[Rule] = []
    seen = set()
    for raw in patterns:
        p = raw.rstrip()
        if not p or p.startswith("#") or p in seen:
            continue
        seen.add(p)
        negate = p.startswith("!")
        if negate or p.startswith(("\\#", "\\!")):
            p = p[1:]
        only_dir = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        p = p.lstrip("/")
        if not p:
            continue
        prefix = "" if anchored else "(?:.*/)?"
        rules.append(Rule(prefix + _glob(p) + ("/" if only_dir else "/?"), negate))
    return rules


def _runs(rules: list[Rule]) -> list[tuple[str, bool]]:
    runs: list[tuple[list[str], bool]] = []
    for r in rules:
        if runs and runs[-1][1] == r.negate:
            runs[-1][0].append(r.regex)
        else:
            runs.append(([r.regex], r.negate))
    return [("|".join(f"(?:{x})" for x in xs), neg) for xs, neg in runs]


def _verdict(entry: Column, runs: list[tuple[str, bool]]) -> Column:
    """Last matching rule decides about one entry (no look at its parents)."""
    out = None
    for regex, negate in reversed(runs):
        hit = entry.rlike(f"^(?:{regex})$")
        out = F.when(hit, F.lit(not negate)) if out is None else out.when(hit, F.lit(not negate))
    return out.otherwise(F.lit(False))


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """True when the path, or a directory above it, is ignored by the rule list."""
    rules = compile_rules(patterns)
    if not rules:
        return F.lit(False)
    runs = _runs(rules)
    if not any(r.negate for r in rules):
        # a matched ancestor directory ends in "/" and anything may follow
        dirs = "|".join(f"(?:{r.regex[:-2] if r.regex.endswith('/?') else r.regex[:-1]})/.+" for r in rules)
        return path.rlike(f"^(?:{runs[0][0]}|{dirs})$")
    return F.exists(entries(path), lambda e: _verdict(e, runs))


def entries(path: Column) -> Column:
    """The directories above a path, each with a trailing slash, and then the path itself."""
    segs = F.split(path, "/")
    n = F.size(segs)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.concat(F.array_join(F.slice(segs, 1, i), "/"), F.when(i < n, F.lit("/")).otherwise(F.lit(""))),
    )


def pattern_regex(pattern: str) -> str | None:
    """One pattern, taken alone, as a regex over whole paths (ancestors included)."""
    rules = compile_rules([pattern])
    if not rules or rules[0].negate:
        return None
    r = rules[0].regex
    stem = r[:-2] if r.endswith("/?") else r[:-1]
    return f"^(?:{stem}(?:/.+)?)$" if r.endswith("/?") else f"^(?:{stem}/.+)$"


def layered(*layers: list[str] | None) -> list[str]:
    """Rule lists one after the other, each rule once, at its first place."""
    return list(dict.fromkeys(r for layer in layers for r in layer or []))


def is_ignored_merged(path: Column, patterns: list[str], rules: Column) -> Column:
    """As ``is_ignored`` with a list that goes on in the data: ``patterns`` first, then an ordered array of (regex, negate).

    ``regex`` comes from ``glob_regex_column(..., entry=True)``. Of the whole list the last rule that matches an entry decides about
    it, so a rule of the data can bring back what ``patterns`` drop, and a path is ignored when it or a directory above it is.
    A null or empty array leaves ``patterns`` alone, at the cost of one expression.
    """
    runs = _runs(compile_rules(patterns))

    def verdict(entry):
        hits = F.filter(rules, lambda r: F.rlike(entry, r["regex"]))
        return F.coalesce(~F.element_at(F.when(F.size(hits) > 0, hits), -1)["negate"], _verdict(entry, runs) if runs else F.lit(False))

    return F.when(F.size(F.coalesce(rules, F.array())) > 0, F.exists(entries(path), verdict)).otherwise(is_ignored(path, patterns))


#: What a glob is made of: an escaped character, a class, stars, any other character.
_GLOB_TOKEN = r"(?s)\\[^/]|\[[^/][^/\]]*\]|\*+|."


def _glob_column(body: Column) -> Column:
    """``_glob`` for a column."""
    marked = F.regexp_replace(body, r"(^|/)\*\*$", "$1\u0001")               # trailing ** : anything below
    marked = F.regexp_replace(marked, r"(^|(?<=/))\*\*/", "\u0002")          # **/ : any directories
    marked = F.regexp_replace(marked, r"(^|(?<=[/\u0002]))\*+(?=/|$)", "\u0003")      # a whole name
    plain = lambda c: F.regexp_replace(c, r"([.+^$(){}|\[\]\\*?])", r"\\$1")

    def one(t):
        inner = F.substr(t, F.lit(2), F.length(t) - 2)
        members = F.when(inner.rlike("^[!^]"), F.concat(F.lit("^"), F.substr(inner, F.lit(2)))).otherwise(inner)
        return (F.when(t == "\u0001", ".+").when(t == "\u0002", "(?:[^/]+/)*").when(t == "\u0003", "[^/]+").when(t.startswith("*"), "[^/]*").when(t == "?", "[^/]")
                .when(t.startswith("[") & (F.length(t) > 2), F.concat(F.lit("["), members, F.lit("]")))
                .when(t.startswith("\\") & (F.length(t) == 2), plain(F.substr(t, F.lit(2)))).otherwise(plain(t)))

    return F.array_join(F.transform(F.regexp_extract_all(marked, F.lit(_GLOB_TOKEN), F.lit(0)), one), "")


def glob_regex_column(pattern: Column, entry: bool = False) -> Column:
    """``pattern_regex`` for a column of patterns (user queries), without a UDF.

    Handles anchoring, ``*``, ``**``, ``?``, classes, escapes and a trailing slash, as ``compile_rules`` does; a negated or
    empty pattern gives null. With ``entry`` the regex is for single entries (``entries``) instead of whole paths.
    """
    p = F.regexp_replace(pattern, r"\s+$", "")
    only_dir = p.endswith("/")
    body = F.regexp_replace(p, "/+$", "")
    anchored = F.instr(body, "/") > 0
    body = F.regexp_replace(body, "^/+", "")
    esc = _glob_column(body)
    head = F.concat(F.lit("^(?:"), F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?")), esc)
    if entry:
        return F.when((F.length(body) > 0) & ~p.startswith("!") & ~p.startswith("#"), F.concat(head, F.when(only_dir, F.lit("/)$")).otherwise(F.lit("/?)$"))))
    out = F.concat(
        F.lit("^(?:"), F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?")), esc,
        F.when(only_dir, F.lit("/.+)$")).otherwise(F.lit("(?:/.+)?)$")),
    )
    return F.when((F.length(body) > 0) & ~p.startswith("!") & ~p.startswith("#"), out)
