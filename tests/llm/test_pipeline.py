from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from quarry.llm import pii
from tests.llm.conftest import doc_rows
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check as check_packing, tokenizer  # noqa: F401
from tests.llm.test_quality import WORD, brute_kept, norm
from tests.llm.test_simhash import brute_components, brute_print
from quarry.llm import quality as Q


def clean_brute(rows):
    """Kept rows without their host's frequent lines."""
    texts, held = defaultdict(set), defaultdict(set)
    for _, t, _, host, _ in rows:
        texts[host].add(t or "")
        for line in (t or "").split("\n"):
            if norm(line):
                held[host, norm(line)].add(t or "")
    often = {k for k, v in held.items() if len(v) > Q.MIN_TEXTS and len(v) > Q.MAX_SHARE * len(texts[k[0]])}
    out = []
    for r, verdict in zip(rows, brute_kept(rows), strict=True):
        if verdict[7]:
            lines = (r[1] or "").split("\n")
            rest = [x for x in lines if (r[3], norm(x)) not in often]
            out.append((r[0], "\n".join(rest), r[2], r[3], len("\n".join(rest))))
    return out


def dedup_brute(rows):
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_components(prints)
    best = {}
    for r, h in zip(rows, prints, strict=True):
        k = (r[0] is None, r[0] or 0)
        if roots[h] not in best or k < best[roots[h]][0]:
            best[roots[h]] = (k, r)
    return [r for _, r in best.values()]


def rows_of(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def run_and_check(spark, docs, sf, tokenizer):  # noqa: F811
    rows = rows_of(docs)
    for _, stage in P.STAGES[:1]:
        got = stage(spark, docs, sf)
        assert got.columns == P.COLUMNS and got.schema == docs.select(*P.COLUMNS).schema
    rows = clean_brute(rows)
    assert Counter(rows_of(got)) == Counter(rows)
    docs, rows = P.cut(got, "t"), dedup_brute(rows)
    got = P.STAGES[1][1](spark, docs, sf)
    assert got.columns == P.COLUMNS
    assert sorted(str(r[0]) for r in rows_of(got)) == sorted(str(r[0]) for r in rows)
    docs, rows = P.cut(got, "t"), rows_of(got)
    got = P.STAGES[2][1](spark, docs, sf)
    assert Counter(rows_of(got)) == Counter((d, pii.redact_text(t), lang, s, len(pii.redact_text(t))) for d, t, lang, s, _ in rows)
    docs, rows = P.cut(got, "t"), rows_of(got)
    got = P.STAGES[3][1](spark, docs, sf)
    assert got.columns == P.COLUMNS
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    taken, times = Counter(), Counter()
    for r in rows_of(got):
        taken[r[3]] += size(r[1])
        times[r] += 1
    assert set(times) <= set(rows) and max(times.values(), default=0) <= 3 * max(Counter(rows).values(), default=1)
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= max([size(r[1]) for r in rows if r[3] == s])
    docs, rows = P.cut(got, "t"), rows_of(got)
    check_packing(P.STAGES[4][1](spark, docs, sf).collect(), [r[:2] for r in rows], tokenizer)


def test_stages_on_edge_rows(spark, docs, tokenizer):  # noqa: F811
    run_and_check(spark, docs, "", tokenizer)


def test_stages_on_given_table(spark, tokenizer):  # noqa: F811
    sf = "/root/testdata/sf0.001"
    run_and_check(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, tokenizer)


def test_run_and_empty_table(spark, no_docs, folder):
    from quarry.llm.queries import QUERIES
    assert QUERIES["pipeline"](spark, folder(documents=no_docs)).count() == 0
    out = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_clashing_columns(spark, clashing):
    out = P.near_dedup(spark, P.quality_rules(spark, clashing, ""), "")
    assert out.columns == P.COLUMNS and out.count() <= len(doc_rows())


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES[:4]])
def test_stage_of_nothing(spark, no_docs, stage):
    assert stage(spark, no_docs, "").count() == 0
