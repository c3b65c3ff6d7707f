import re
from collections import Counter, defaultdict

from quarry.llm import quality as Q
from quarry.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def norm(line):
    return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", line).strip(" ").lower()


def brute_kept(rows, share=Q.MAX_SHARE, least=Q.MIN_TEXTS):
    texts, held = defaultdict(set), defaultdict(set)
    for _, t, _, host, _ in rows:
        texts[host].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                held[host, norm(line)].add(t or "")
    often = {k for k, v in held.items() if len(v) > least and len(v) > share * len(texts[k[0]])}
    out = []
    for d, t, _, host, _ in rows:
        lost = sum(len(WORD.findall(line)) for line in (t or "").split("\n") if (host, norm(line)) in often)
        base = brute_base(t)
        rest = base[0] - lost
        out.append((d, *base, not base[5] and rest >= Q.LEAST_LEFT * base[0] and rest >= Q.LEAST_WORDS, lost))
    return out


def got(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words").collect())))


def test_edge_rows_match_brute_force(spark, docs, clashing, no_docs, folder):
    from tests.llm.conftest import doc_rows
    want = sorted(map(str, brute_kept(doc_rows())))
    assert got(QUERIES["op8_quality_rules"](spark, folder(documents=docs))) == want
    assert got(Q.judge(clashing)) == want
    assert Q.judge(no_docs).count() == 0 and Q.clean(no_docs).count() == 0


def test_given_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got(QUERIES["op8_quality_rules"](spark, sf)) == sorted(map(str, brute_kept(rows)))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    own = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".replace("a", f"a{i}") for i in range(30)]
    rows = [(i, f"Read More  HERE now\n{t}", "en", "h", 0) for i, t in enumerate(own)]
    rows += [(100, "read more here now\nread more here now\nread more here now\nten more words in a line that stand only right here", "en", "h", 0)]
    rows += [(200 + i, "a copy of one text keeps all of its words in this table", "en", "h", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in Q.clean(df).collect()}
    assert out[0] == own[0] and 100 not in out
    assert len(out) == 90 and out[200].startswith("a copy")
    assert Q.clean(df).columns == df.columns


def test_a_repeated_line_goes_from_a_large_host_too(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(400)]
    rows = [(i, ("Subscribe to our letter\n" if i < 12 else "a line of ten\n" if i < 22 else "") + t, "en", "h", 0) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in Q.clean(df).collect()}
    assert len(out) == 400 and all(out[i] == (own[i] if i < 12 or i >= 22 else "a line of ten\n" + own[i]) for i in out)
