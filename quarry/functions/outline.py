"""Nested declarations of a source file: one pass over its brackets or indentation, strings and comments blanked out.

The unit of work is one file's text; ``operators.structure`` applies it to a column of files.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# --- fixed values: what is a string or comment, and what opens a declaration, by language -----
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_CHAR = r"'(?:\\[^'\n]{1,8}|[^'\\\n])'"          # not a lifetime
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
_TICKS = r"`(?:\\.|[^`\\])*`?"
BLANKED = {
    "typescript": [_C_COMMENT, _QUOTED, _SINGLE, _TICKS], "javascript": [_C_COMMENT, _QUOTED, _SINGLE, _TICKS],
    "python": [r"#[^\n]*", _TRIPLE, r"'''(?:\\.|.)*?(?:'''|\Z)", _QUOTED, _SINGLE],
    "java": [_C_COMMENT, _TRIPLE, _QUOTED, _CHAR], "csharp": [_C_COMMENT, r'@"(?:""|[^"])*"?', _QUOTED, _CHAR], "cpp": [_C_COMMENT, _QUOTED, _CHAR],
    "go": [_C_COMMENT, _QUOTED, r"`[^`]*`?", _CHAR], "rust": [_C_COMMENT, r'r#+".*?(?:"#+|\Z)', _QUOTED, _CHAR], "scala": [_C_COMMENT, _TRIPLE, _QUOTED, _CHAR],
}
_JS = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
_JS_FN = r"|" + _JS + r"(?:async\s+)?function\b|(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"
_MODS = r"(?:(?:public|private|protected|internal|static|final|sealed|abstract|partial)\s+)*"
_HOLDER = {
    "typescript": _JS + r"(?:class|interface|enum)\s+[\w$]", "javascript": _JS + r"class\s+[\w$]",
    "java": _MODS + r"(?:class|interface|enum|record)\s+\w", "csharp": _MODS + r"(?:class|interface|struct|enum|record|namespace)\s+\w",
    "cpp": r"(?:template\s*<[^;{}]*>\s*)?(?:class|struct|namespace|enum(?:\s+class)?)\s+\w[^;={}(]*\{", "go": r"(?!)",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:impl\b|(?:unsafe\s+)?(?:struct|enum|trait|mod)\s+\w)", "scala": r"(?:(?:case|abstract|sealed|final|implicit)\s+)*(?:class|object|trait)\s+\w",
}
_PLAIN = {
    "typescript": r"(?:export\s+)?(?:declare\s+)?type\s+[\w$]+[^=;\n]*=" + _JS_FN, "javascript": _JS_FN[1:], "java": r"(?!)", "csharp": r"(?!)",
    "cpp": r"(?:[\w:<>,*&\[\]]+[ \t]+[*&]*)*~?[A-Za-z_][\w:~]*\s*\([^;{}]*\)[^;{}()=]*\{", "go": r"(?:func|type|var|const)\b",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+\w", "scala": r"(?:(?:override|private|protected|final|implicit)\s+)*def\s+\S",
}
#: Only straight inside a holder.
_MEMBER = {
    "typescript": r"(?:(?:public|private|protected|static|override|readonly|abstract|async|get|set)\s+|\*\s*)*[#\w$]+\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?::[^;{}]+)?\{",
    "java": r"(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>\n]*>\s*)?(?:[\w<>\[\],.?]+\s+)?\w+\s*\([^;{}]*\)\s*(?:throws\s+[\w,.\s]+)?[{;]",
    "csharp": r"(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|extern|partial)\s+)*(?:[\w<>\[\],.?]+\s+)?\w+\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?:where[^{;]+)?(?:[{;]|=>)",
}
_MEMBER["javascript"] = _MEMBER["typescript"]
NOT_NAMES = r"(?!(?:if|for|foreach|while|switch|catch|return|with|new|else|do|throw|try|using|lock|case(?!\s+(?:class|object))|await|typeof|delete|yield|match)\b)"
#: A header of these languages may end with its line.
LINE_ENDS = {"typescript", "javascript", "go", "scala", "csharp"}
_OPENERS, _CLOSERS = "([{", ")]}"
_SPACE = re.compile(r"\s+")


def _kinds(language: str) -> list[tuple[str, re.Pattern]]:
    made = [("holder", _HOLDER[language]), ("plain", _PLAIN[language]), ("member", _MEMBER.get(language, r"(?!)"))]
    return [(k, re.compile(rf"^[ \t]*{NOT_NAMES}(?:{p})", re.MULTILINE)) for k, p in made]


_BLANKS = {k: re.compile("|".join(v), re.DOTALL) for k, v in BLANKED.items()}
_HEADS = {k: _kinds(k) for k in BLANKED if k != "python"}
_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(?:def|class)[ \t]+\w", re.MULTILINE)


def blanked(code: str, language: str) -> str:
    """The code with strings and comments as spaces; every other character keeps its place."""
    return _BLANKS[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _brackets(text: str) -> dict[int, int]:
    """Where each bracket closes; one that never does closes with the text."""
    stack, out = [], {}
    for m in re.finditer(r"[()\[\]{}]", text):
        kind = _OPENERS.find(m[0])
        if kind >= 0:
            stack.append((m.start(), _CLOSERS[kind]))
            continue
        if any(c == m[0] for _, c in stack[-8:]):       # a stray closing bracket is passed over
            while True:
                at, c = stack.pop()
                out[at] = m.start()
                if c == m[0]:
                    break
    return out | dict.fromkeys((at for at, _ in stack), len(text))


def _body(text: str, start: int, closes: dict[int, int], line_ends: bool) -> tuple[int, int]:
    """(end of the header, end of the declaration) that starts at ``start``."""
    at = start
    while m := re.compile(r"[(\[{;]|\n").search(text, at):
        c = m[0]
        if c == "{":
            return m.end(), closes[m.start()]
        if c == ";":
            return m.end(), m.start()
        if c == "\n":
            before, after = text[start:m.start()].rstrip(), text[m.end():m.end() + 400].lstrip()
            if line_ends and before and not before.endswith(("=", "|", "&", ",", ":", "=>")) and not after.startswith(("{", "|", "&", ".", "=", "?", ":", "extends ", "implements ")):
                return m.start(), m.start() - 1
            at = m.end()
        else:
            at = closes[m.start()] + 1
    return len(text), len(text)


def _braced(text: str, language: str) -> list[tuple[int, int, int, str]]:
    """(start, header's end, end, kind) of declarations in order, members and functions only where they can stand."""
    closes, found = _brackets(text), {}
    for kind, pattern in _HEADS[language]:
        for m in pattern.finditer(text):
            start = m.end() - len(m[0].lstrip())
            found.setdefault(start, kind)
    out, open_ = [], []
    for start in sorted(found):
        kind = found[start]
        while open_ and open_[-1][2] < start:
            open_.pop()
        inside = open_[-1] if open_ else None
        if inside and start < inside[1]:
            continue        # a part of the header before it
        if kind == "member" and (inside is None or inside[3] != "holder") or language in ("go", "cpp") and inside and inside[3] != "holder":
            continue
        head, end = _body(text, start, closes, language in LINE_ENDS)
        one = (start, head, end, kind)
        out.append(one)
        open_.append(one)
    return out


def _indented(text: str) -> list[tuple[int, int, int, str]]:
    closes = _brackets(text)
    hidden = sorted((a, b) for a, b in closes.items())
    lines, at, skip = [], 0, -1
    for line in text.split("\n"):           # (offset, indent) of lines that hold code and do not continue a bracket
        if line.strip() and at > skip:
            lines.append((at, len(line) - len(line.lstrip())))
        while hidden and hidden[0][0] <= at + len(line):
            skip = max(skip, hidden.pop(0)[1])
        at += len(line) + 1
    out, place = [], {a: i for i, (a, _) in enumerate(lines)}
    later: list[tuple[int, int]] = []       # lines after this one, the nearest first, that no nearer one of less indent hides
    follows = [len(text) + 1] * len(lines)
    for i in range(len(lines) - 1, -1, -1):
        while later and later[-1][1] > lines[i][1]:
            later.pop()
        follows[i] = later[-1][0] if later else len(text) + 1
        later.append(lines[i])
    for m in _DEF.finditer(text):
        i = place.get(m.start())
        if i is None:
            continue
        head = _python_head(text, m.end(), closes)
        end = m.start() + len(text[m.start():max(head, follows[i] - 1)].rstrip()) - 1
        while i and lines[i - 1][1] == len(m[1]) and text[lines[i - 1][0] + len(m[1])] == "@":
            i -= 1
        out.append((lines[i][0] + len(m[1]), head, end, "holder"))
    return out


def _python_head(text: str, at: int, closes: dict[int, int]) -> int:
    while m := re.compile(r"[(\[{:]").search(text, at):
        if m[0] == ":":
            return m.end()
        at = closes[m.start()] + 1
    return len(text)


def outline(code: str | None, language: str | None) -> list[tuple[int, int, list[str]]]:
    """(first line, last line, headers from the outermost to its own) of every declaration, nested ones too, by first line.

    Lines that no declaration covers come as ranges without headers. A text without declarations, or in a language without
    patterns, is one range. Lines count from 1.
    """
    code = code or ""
    n = code.count("\n") + 1
    if language not in BLANKED:
        return [(1, n, [])]
    text = blanked(code, language)
    found = _indented(text) if language == "python" else _braced(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    out, chain, covered = [], [], 0
    for start, head, end, _ in found:
        while chain and chain[-1][0] < start:
            chain.pop()
        first, last = bisect_right(starts, start), bisect_right(starts, max(start, min(end, len(code))))
        own = code[start:head]
        if language == "python":
            own = re.sub(r"\A(?:[ \t]*@[^\n]*\n)+", "", own)
        chain.append((end, _SPACE.sub(" ", own).strip()))
        if first > covered + 1:
            out.append((covered + 1, first - 1, []))
        covered = max(covered, last)
        out.append((first, last, [h for _, h in chain]))
    if covered < n:
        out.append((covered + 1, n, []))
    return out
