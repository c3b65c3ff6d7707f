import random

import corpus_pipeline as P
from quarry.llm import near_copies as N
from tests.llm.conftest import SCHEMA


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def make(copies=6):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(3, 7)))
    rows, n = [], 0
    for _ in range(40):
        first = [word() for _ in range(random.randint(60, 300))]
        for c in range(copies):
            body = list(first)
            for _ in range(c * len(body) // 150):       # from none to about one word in 30 changed
                body[random.randrange(len(body))] = word()
            rows.append((n := n + 1, " ".join(body), "en", "a", 0))
    return rows


def check(rows, kept, exempt=()):
    """No pair that stays is near, and what went is joined to what stayed by near pairs."""
    sets = {r[0]: grams(r[1]) for r in rows}
    near = {d: [e for e in sets if e < d and alike(sets[d], sets[e]) >= 0.8] for d in sets}
    assert sum(map(len, near.values())) > 0
    for d in kept:
        assert not set(near[d]) & kept, d
    for d in set(sets) - kept - set(exempt):
        assert near[d], d


def test_near_copies_do_not_stay_in_the_pipeline(spark, folder):
    rows = make()
    kept = {r["doc_id"] for r in P.run(spark, folder(documents=spark.createDataFrame(rows, SCHEMA))).select("doc_id").distinct().collect()}
    sets = [grams(r[1]) for r in rows if r[0] in kept]
    assert len(sets) >= 20 and not any(alike(a, b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i])


def test_large_groups_are_led_by_one_row_at_a_time(spark):
    rows = make(12)
    df = spark.createDataFrame([*rows, rows[0], (None, rows[0][1], "en", "a", 0), (10**6, "", "en", "a", 0), (10**6 + 1, None, "en", "a", 0)], SCHEMA)
    want = None
    for group_rows in (2, 32):
        got = [r["doc_id"] for r in N.drop_near_copies(df, group_rows=group_rows).collect()]
        assert got.count(1) == 2 and None in got and {10**6, 10**6 + 1} <= set(got)
        kept = {d for d in got if d is not None and d < 10**6}
        check(rows, kept)
        want = want or kept
    assert 40 <= len(want)


def test_near_is_the_shared_part_of_the_union():
    a = "one two three four five six seven eight nine ten"
    for b in (a, a.upper(), a + " more", "zero " + a + " more", "one two three", "", None):
        assert N.near(N.shingles(a), N.shingles(b)) == (alike(grams(a), grams(b)) >= 0.8)
