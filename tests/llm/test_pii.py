import hashlib
import re

import pytest

from quarry.llm import pii as P
from quarry.llm.queries import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


CASES = [
    None, "", "mail a.b@c.de, x@y, @z.com a@b@c.d.e %a@b-c.d@e.f", "a@b.c%d@e.f@g.h", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111113",
    "+1 (555) 123-4567 and +49.89.1234567890123456 ++1 2 +12", "9" * 4000 + "." + "1" * 3 + ".2.3", "x" * 20000 + "@", "a" * 3000 + "@b.c",
    "é😀 a@b.co 中 +1 206 555 0100 ٣.٣.٣.٣", "0000000000000 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_match_plain_patterns(text):
    assert [s[:3] for s in P.find_spans(text) if s[0] in P.BASE] == brute(text)


def test_generated_texts_match_plain_patterns():
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet="ab1.2@+- 4(%é9\n", max_size=60))
    def run(text):
        assert [s[:3] for s in P.find_spans(text) if s[0] in P.BASE] == brute(text)
    run()


def test_method_kinds():
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in P.find_spans(t)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("pay to GB82 WEST 1234 5698 7654 32 AND go")
    assert ("iban", "DE89370400440532013000") in kinds("DE89370400440532013000.")
    assert not kinds("DE89370400440532013001 and 219-09-9999 plain")
    assert ("ssn", "219-09-9999") in kinds("his SSN: 219-09-9999")
    assert ("local_phone", "(206) 555-0100") in kinds("call (206) 555-0100 now") and not kinds("code 206-555-0100")
    near = {k: s for k, _, _, s in P.find_spans("credit card 4111111111111111")}
    far = {k: s for k, _, _, s in P.find_spans("order 4111111111111111")}
    assert near["card"] > far["card"]
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB82WEST12345698765433")


def test_redaction():
    assert P.redact_text("to a@b.co, +1 206 555 0100!") == "to [EMAIL], [PHONE]!"
    assert P.redact_text(None) is None and P.redact_text("") == "" and P.redact_text("clean") == "clean"


def test_query(spark, docs, no_docs, clashing, folder):
    from tests.llm.conftest import doc_rows
    extra = spark.createDataFrame([(900 + i, t, "en", "z", 0) for i, t in enumerate(CASES)], docs.schema)
    out = QUERIES["op10_pii"](spark, folder(documents=docs.union(extra))).collect()
    texts = [(r[0], r[1]) for r in doc_rows()] + [(900 + i, t) for i, t in enumerate(CASES)]

    def row(d, t):
        spans = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        return (d, *[sum(s[0] == k for s in spans) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest())
    assert sorted(str(tuple(r)[:6]) for r in out) == sorted(str(row(d, t)) for d, t in texts)
    assert P.find_pii(no_docs).count() == 0 and P.find_pii(clashing).count() == len(doc_rows())
