"""Personal data: patterns propose, checksums confirm, nearby words adjust the score (operator 10)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import documents, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

# --- fixed values: the patterns of the base kinds ---------------------------------------------
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried once, from its start: later starts in it fail or succeed alike
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# --- further kinds ----------------------------------------------------------------------------
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
#: Score of a confirmed span, and the words nearby that raise it by NEAR.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
WORDS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile"), "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"), "local_phone": ("phone", "tel", "call", "fax", "mobile"),
}
NEAR, REACH, THRESHOLD = 0.35, 40, 0.6
_NEARBY = {k: re.compile(r"(?<![a-z])(?:" + "|".join(w) + r")(?![a-z])") for k, w in WORDS.items()}
_SEPARATORS = str.maketrans("", "", " -")


def luhn(digits: str) -> bool:
    """Luhn's check over a string of digits."""
    odd = [int(c) for c in digits[-1::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN without separators."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().translate(_SEPARATORS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                yield m.span()


def _ibans(text: str):
    """The longest part of a match, cut at the end of a group of letters and digits, that passes."""
    for m in IBAN.finditer(text):
        ends = [e for e in range(m.end(), m.start() + 14, -1) if e == len(text) or not text[e].isalnum()]
        for end in ends:
            if text[end - 1] not in " -" and mod97(text[m.start():end].translate(_SEPARATORS)):
                yield m.start(), end
                break


_FINDERS = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans,
    "ssn": lambda t: (m.span() for m in SSN.finditer(t)), "local_phone": lambda t: (m.span() for m in LOCAL_PHONE.finditer(t)),
}


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; offsets are code points, ends exclusive.

    A base kind's confirmed match always counts. Another kind counts from a score of THRESHOLD and
    where it overlaps nothing found before. Null or empty text: nothing.
    """
    if not text:
        return []
    out: list[tuple[str, int, int, float]] = []
    for kind in KINDS:
        taken = [] if kind in BASE else list(out)
        for start, end in _FINDERS[kind](text):
            around = text[max(0, start - REACH):start] + " " + text[end:end + REACH]
            score = min(1.0, SCORES[kind] + (NEAR if _NEARBY[kind].search(around.lower()) else 0.0))
            if kind in BASE or (score >= THRESHOLD and not any(s < end and start < e for _, s, e, _ in taken)):
                out.append((kind, start, end, score))
    return out


def redact_text(text: str | None) -> str | None:
    """The text with each found span, overlapping ones as one, replaced by its (first) kind in brackets."""
    if text is None:
        return None
    parts, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in find_spans(text)):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; spans is an array of (kind, start, end, score).

    Null and empty texts have no spans, null ids stay, repeated rows are answered each. Other columns of
    the input are not read. A text is worked on whole, one row at a time, without any shuffle.
    """
    rows = documents(docs, doc_id, text)
    names = ("kind", "start", "end", "score")

    def run(batches):
        kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True))))
        for batch in slices(batches):
            found = [[dict(zip(names, s, strict=True)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, personal data in the text replaced by its kind in brackets; null stays null."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches):
            column = batch.column(at)
            yield batch.set_column(at, batch.schema.field(at), pa.array([redact_text(t) for t in column.to_pylist()], column.type))
    return docs.mapInArrow(run, docs.schema)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
