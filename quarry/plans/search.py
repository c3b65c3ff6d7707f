"""The whole search for a table of queries, as one plan.

queries -> operators and intent -> two passes of hybrid retrieval -> fusion -> filters ->
scores -> (rerank) -> groups -> diversity. Each stage is a DataFrame and can be used alone. The
analysed queries are written to the shared folder once, since every stage joins them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import fixed as X
from quarry.functions.querylog import analyze, parse_operators, path_regexes
from quarry.operators import grouping as G, retrieval as R, scoring as S
from quarry.session import cut_lineage
from quarry.sources import inverted as N

CHUNK_COLS = ["chunk_id", "path", "start_line", "end_line", "language", "content", "symbol_id", "symbol_label", "indexed_at"]


def prepare(queries: DataFrame) -> DataFrame:
    """Parsed and analysed queries with path patterns as regexes and candidate limits per attempt.

    A query with ``must`` gets up to three growing limits; the first one with enough survivors
    is kept later on. All of them are cut from the same 80-row lists.
    """
    q = analyze(parse_operators(queries))
    q = (q.withColumn("path_re", path_regexes(F.col("path"))).withColumn("not_path_re", path_regexes(F.col("not_path")))
         .withColumn("n_path", F.size("path")).drop("path", "not_path"))
    base = F.least(F.lit(X.MAX_CANDIDATES), F.greatest(F.col("result_limit") * X.CANDIDATES_PER_RESULT, F.lit(X.MIN_CANDIDATES)))
    grown = [F.least(F.lit(X.MAX_CANDIDATES), base * (2 ** i)) for i in range(X.MUST_RETRIES + 1)]
    return q.withColumn("limits", F.when(F.size("must") > 0, F.array_distinct(F.array(*grown))).otherwise(F.array(base)))


def expand_passes(prepared: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, pass, text): the query itself and the query with the expansion line."""
    scope = ["corpus"] if "corpus" in prepared.columns else []
    return prepared.select(key, *scope, F.explode(F.array(
        F.struct(F.lit("primary").alias("pass"), F.col("semantic").alias("semantic")),
        F.struct(F.lit("expanded").alias("pass"), F.concat("semantic", F.lit(X.EXPANSION)).alias("semantic")))).alias("p")).select(
        key, *scope, "p.pass", "p.semantic")


def pass_lists(prepared: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], key: str = "query_id",
               lexical: N.Inverted | None = None) -> DataFrame:
    """(key, pass, source, chunk_id, rank): the 80 best of each pass, dense and sparse.

    Queries with a corpus column see that corpus alone, with its own term statistics. With the stored index of the
    same chunks (``lexical``) the sparse half reads no text.
    """
    within = "corpus" if "corpus" in prepared.columns else None
    ktype = prepared.schema[key].dataType
    p = expand_passes(prepared, key).withColumn("_qp", F.concat_ws(":", "pass", key))
    p = p.withColumn("vector", embed(F.col("semantic")))
    c = chunks if "vector" in chunks.columns else chunks.withColumn("vector", embed(F.col("content")))
    dense = R.dense_topk(c, p, X.MAX_CANDIDATES, "chunk_id", "vector", "_qp", within=within)
    if lexical is None:
        sparse = R.bm25_topk(c, p, X.MAX_CANDIDATES, "chunk_id", "content", "_qp", "semantic", within)
    else:
        sparse = N.topk(lexical, p, X.MAX_CANDIDATES, "chunk_id", "_qp", "semantic", within)
    both = dense.withColumn("source", F.lit("dense")).unionByName(sparse.withColumn("source", F.lit("sparse")))
    return both.select(F.regexp_extract("_qp", "^[a-z]+:(.*)$", 1).cast(ktype).alias(key),
                       F.regexp_extract("_qp", "^([a-z]+):", 1).alias("pass"), "source", "chunk_id", "rank")


def cut_and_fuse(prepared: DataFrame, lists: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, attempt, pass, chunk_id, score, rank): store fusion for each candidate limit."""
    limits = prepared.select(key, F.posexplode("limits").alias("attempt", "cap"))
    cut = lists.join(limits, key).where(F.col("rank") <= F.col("cap"))
    fused = cut.groupBy(key, "attempt", "cap", "pass", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(X.STORE_RRF_K) + F.col("rank"))), 12).alias("score"))
    w = W.partitionBy(key, "attempt", "pass").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("cap")).drop("cap")


def fuse_passes(hits: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """One candidate per path, span and language, with the sum over passes; the first pass to
    show it keeps the payload."""
    narrow = hits.join(chunks.select("chunk_id", "path", "start_line", "end_line", "language"), "chunk_id")
    fused = narrow.groupBy(key, "attempt", "path", "start_line", "end_line", F.coalesce("language", F.lit("unknown")).alias("_l")).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(X.PASS_RRF_K) + F.col("rank"))), 12).alias("fusion"),
        F.max("score").alias("backend"), F.count(F.lit(1)).alias("n_passes"),
        F.min_by("chunk_id", F.struct(F.when(F.col("pass") == "primary", 0).otherwise(1), F.col("rank"))).alias("chunk_id"))
    return fused.select(key, "attempt", "chunk_id", "fusion", "backend", "n_passes")


def pass_status(prepared: DataFrame, lists: DataFrame, key: str = "query_id") -> DataFrame:
    """Which passes gave rows; one missing is a warning, both missing an error."""
    seen = lists.groupBy(key).agg(F.max((F.col("pass") == "primary").cast("int")).alias("p"),
                                  F.max((F.col("pass") == "expanded").cast("int")).alias("e"))
    j = prepared.select(key).join(seen, key, "left").na.fill(0, ["p", "e"])
    n = F.col("p") + F.col("e")
    return j.select(key, n.cast("int").alias("n_ok"), (2 - n).cast("int").alias("n_failed"),
                    F.when(n == 0, "error").when(n == 1, "degraded").otherwise("ok").alias("status"),
                    F.when((n == 1) & (F.col("p") == 0), "primary").when(n == 1, "expanded").alias("missing_pass"))


#: So many candidate ids are sent to every task (some tens of MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def fetch_chunks(chunks: DataFrame, ids: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``chunks`` with one of the ids, written out. The ids are counted first: while they are few, no text is shuffled."""
    ids = cut_lineage(ids.select("chunk_id").distinct(), "ids")
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    return cut_lineage(chunks.select(*CHUNK_COLS).join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi"), "payload")


def candidates(prepared: DataFrame, chunks: DataFrame, embed, key: str = "query_id", lists: DataFrame | None = None,
               lexical: N.Inverted | None = None) -> DataFrame:
    """Fused candidates of every attempt next to their chunk and query columns, with the reason
    for which a filter drops them (null: kept)."""
    lists = pass_lists(prepared, chunks, embed, key, lexical) if lists is None else lists
    hits = cut_lineage(cut_and_fuse(prepared, lists, key), "hits")
    payload = fetch_chunks(chunks, hits)
    full = fuse_passes(hits, payload, key).join(payload, "chunk_id").join(prepared, key)
    return S.with_category(full).withColumn("reason", S.drop_reason())


def choose_attempt(cands: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows of the first attempt with at least ``result_limit`` survivors, else of the last one."""
    kept = F.count_if(F.col("reason").isNull()).over(W.partitionBy(key, "attempt"))
    c = cands.withColumn("_kept", kept)
    enough = F.min(F.when(F.col("_kept") >= F.col("result_limit"), F.col("attempt"))).over(W.partitionBy(key))
    return c.withColumn("_use", F.coalesce(enough, F.size("limits") - 1)).where("attempt = _use").drop("_kept", "_use")


def scored(prepared: DataFrame, chunks: DataFrame, embed, changed: DataFrame | None = None, key: str = "query_id",
           lexical: N.Inverted | None = None) -> DataFrame:
    """Ranked survivors of the chosen attempt."""
    c = choose_attempt(candidates(prepared, chunks, embed, key, lexical=lexical), key).where("reason IS NULL")
    c = c.withColumn("changed_mult", F.lit(1.0)) if changed is None else S.changed_multiplier(
        c, changed, ["corpus", "path"] if "corpus" in prepared.columns else ["path"])
    return S.rank_candidates(S.score_candidates(c), key)


def search_batch(queries: DataFrame, chunks: DataFrame, embed, now: Column, changed: DataFrame | None = None,
                 scorer=None, key: str = "query_id", gate: DataFrame | None = None, lexical: N.Inverted | None = None) -> DataFrame:
    """Grouped results for every query, at most ``result_limit`` each.

    ``changed``: files to prefer (corpus, path). ``scorer``: a reranking model, see
    ``scoring.model_scorer``; it sees the top 50 of each query. ``gate`` (corpus, open), see ``state.search_gate``:
    queries of a corpus that is not open get no rows; ``state.refused`` says why. ``lexical``: the stored inverted
    index of ``chunks`` (``index.load_postings``); without it terms are counted from the text in each search.
    """
    if gate is not None:
        queries = queries.join(gate.where("open").select("corpus").distinct(), "corpus", "left_semi")
    prepared = cut_lineage(prepare(queries), "queries")
    if "corpus" in queries.columns:         # only the asked corpora's chunks are read further
        chunks = chunks.join(prepared.select("corpus").distinct(), "corpus", "left_semi")
    ranked = scored(prepared, chunks, embed, changed, key, lexical)
    if scorer is not None:
        ranked = cut_lineage(ranked, "ranked")      # read by the model and again for the fusion
        ranked = S.rerank(ranked, S.ranks_from_scores(ranked, scorer, key), key)
    return G.diversify(G.rank_groups(G.collapse_declarations(G.group_hits(ranked, now, key), key), key), key)


def search_raw(queries: DataFrame, chunks: DataFrame, embed, changed: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """Ungrouped results: the best ``result_limit`` candidates per query."""
    return scored(cut_lineage(prepare(queries), "queries"), chunks, embed, changed, key).where(F.col("rank") <= F.col("result_limit"))
