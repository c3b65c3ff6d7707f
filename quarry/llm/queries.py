"""The registered queries of this subpackage, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import alignment, block_names, chaining, conversation_trie, mixing, packing, pii, prefix_tree, quality, sharding, simhash, substring_bwt, vptree
from quarry.llm.common import word_count
from quarry.llm.tokens import public_vocabulary


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf, "documents"), public_vocabulary(), with_ids=False)
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    sized = table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    planned = mixing.plan(sized)
    return planned.join(mixing.taken(planned), "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "copies", "first_position")


def op4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return vptree.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_shared_passages(spark: SparkSession, sf: str) -> DataFrame:
    return chaining.shared_passages(table(spark, sf, "documents"))


def op6_chat_tree(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{prefix_tree.FINISH}{prefix_tree.START}assistant ok"
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    stream, paths, _ = prefix_tree.build(rows.union(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)), ranks)
    return prefix_tree.read_back(stream, paths, ranks)


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = substring_bwt.remove_repeats(table(spark, sf, "documents"), keep_text=False)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf, "documents").select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"], 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf, "documents"))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *count, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.scored(table(spark, sf, "documents"), *alignment.public_tokenizers_paths()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_nearest": op4_nearest,
    "op5_shared_passages": op5_shared_passages,
    "op6_chat_tree": op6_chat_tree,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": corpus_pipeline.run,
}

# CRC32 of a decimal number, a byte and a bit at a time
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
        lambda a, x: list_reduce(list_concat([xor(a, x)], list_transform(range(8), lambda i: 0::UBIGINT)),
          lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT)))), 4294967295::UBIGINT)"""

SQL: dict[str, str] = {
    "op4_nearest": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op12_conversation_trie": f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank FROM conversations WHERE conv_id IS NOT NULL),
      c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, n, CAST({_CRC} % 9 AS BIGINT) AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
      g AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS given FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
      r AS (SELECT g.conv_id, rank AS d, role, text FROM g JOIN t ON t.conv_id = g.base AND rank <= given
        UNION ALL SELECT g.conv_id, rank - h + given, role, text FROM g JOIN t ON t.conv_id = g.conv_id AND rank > h),
      p AS (SELECT conv_id, d, list(struct_pack(r := role, x := text)) OVER (PARTITION BY conv_id ORDER BY d) AS k, strlen(text) AS bytes FROM r
        UNION ALL SELECT conv_id, 0, [], 0 FROM c),
      m AS (SELECT conv_id, d, bytes, min(conv_id) OVER w AS node, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p WINDOW w AS (PARTITION BY d, k)),
      nodes AS (SELECT d, node, count(*) AS n, min(bytes) AS bytes, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last) AS ends FROM m GROUP BY d, node),
      up AS (SELECT x.d, x.node, a.d AS ad, a.node AS an, x.n, x.bytes FROM nodes AS x JOIN m AS a ON a.conv_id = x.node AND a.d <= x.d),
      kids AS (SELECT ad AS d, an AS node, count(*) AS n FROM up WHERE d = ad + 1 GROUP BY 1, 2),
      below AS (SELECT ad, an, sum((up.n - 1) * bytes) AS saved, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves FROM up LEFT JOIN kids USING (d, node) GROUP BY 1, 2)
      SELECT nodes.node AS conv_id, nodes.d AS depth, up.an AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
        CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
      FROM nodes JOIN below ON ad = nodes.d AND below.an = nodes.node LEFT JOIN kids ON kids.d = nodes.d AND kids.node = nodes.node
        LEFT JOIN up ON up.d = nodes.d AND up.node = nodes.node AND up.ad = nodes.d - 1""",
    "op13_exact_dedup": """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
      SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n""",
}
