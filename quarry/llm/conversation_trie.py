"""Prefix trie of rebuilt conversations (operator 12).

A node is a distinct sequence of first turns. Its digest combines the hashes of its turns; that no digest stands for
two sequences is verified on the data, and with a clash all are digested anew, wider.

Only nodes that conversations share need sums over their subtrees: a node with one member has one leaf below it and
nothing to save. Shared nodes are dealt to shards by whole subtrees of a bounded size. A shard gives each of its digests a
slot of a minimal perfect hash, scatters the counts into flat arrays by slot and adds each depth to its parents' slots,
the deepest first. Nodes of larger subtrees are few by the choice of the bound; they come last, with the sums of the shards.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm.common import cut, join_counted
from quarry.llm.slots import SlotTable

# --- fixed values: how a conversation is rebuilt ----------------------------------------------
GROUP, HEADS = 5, 9
#: Nodes of a subtree that one shard may hold, and of a shard on average.
SHARD_ROWS = 250_000
#: At most so many nodes have larger subtrees than a shard holds; the bound on subtrees grows for it.
HEAVY_NODES = 100_000
#: A text's first characters take part in the range sort, so that one turn number of one conversation can be split.
SORT_CHARS = 16
PART_BITS = 33      # of monotonically_increasing_id, below the partition


def _placed(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with ``part`` and ``rank`` (1-based in the conversation), range-sorted, so that a long conversation lies in many tasks."""
    t = conversations.select(F.col(conv_id).cast("bigint").alias("cid"), F.col(turn).alias("turn"),
                             F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("cid IS NOT NULL")
    order = ["cid", "turn", "role", "text"]
    placed = cut(t.repartitionByRange("cid", "turn", "role", F.left("text", F.lit(SORT_CHARS))).sortWithinPartitions(*order)
                 .withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("at", PART_BITS).cast("int"))
    heads = placed.groupBy("cid", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("cid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = cut(heads.select("cid", "part", "first", "n", before.alias("before")), "heads")
    ranked = placed.join(heads.drop("n"), ["cid", "part"]).select("cid", "part", (F.col("before") + F.col("at") - F.col("first") + 1).alias("rank"), "role", "text")
    return ranked, heads


def rebuild(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c with the first h turns of conversation c - c % group for its own first h.

    h is crc32 of the decimal c, modulo ``heads``. turns: cid, depth (from 1), last (the conversation's depth), part, role,
    text; conversations: cid, last. ``part`` grows with depth, and no (cid, part) is larger than a task of the sort. Turns are ordered
    by turn (null first), role, text; null roles and texts are empty. Rows with a null id belong to no conversation.
    """
    ranked, spans = _placed(conversations, conv_id, turn, role, text)
    sizes = spans.groupBy("cid").agg(F.sum("n").alias("own"))
    h = F.crc32(F.col("cid").cast("string").cast("binary")) % heads
    convs = sizes.select("cid", "own", h.cast("int").alias("h"), (F.col("cid") - F.col("cid") % group).alias("base"))
    convs = convs.join(sizes.select(F.col("cid").alias("base"), F.col("own").alias("in_base")), "base", "left")
    convs = convs.withColumn("given", F.least(F.col("h").cast("bigint"), F.coalesce("in_base", F.lit(0))))
    convs = cut(convs.select("cid", "base", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("last")), "conversations")
    of_part = spans.select("cid", "part").join(convs, "cid").select("cid", "part", "h", "given", "last")      # a row per conversation and task
    own = ranked.join(of_part, ["cid", "part"]).where("rank > h").select("cid", (F.col("rank") - F.col("h") + F.col("given")).alias("depth"), "last", "part", "role", "text")
    first = ranked.where(F.col("rank") < heads).select(F.col("cid").alias("base"), "rank", "role", "text")
    borrowed = convs.where("given > 0").join(first, "base").where("rank <= h").select(
        "cid", F.col("rank").alias("depth"), "last", F.lit(-1).alias("part"), "role", "text")
    return cut(own.unionByName(borrowed), "turns"), convs.select("cid", "last")


def _hashed(turns: DataFrame, seed: int, bits: int) -> DataFrame:
    def short(*cols) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 64 - bits) if bits < 64 else F.xxhash64(F.lit(seed), *cols)
    return turns.withColumn("h1", short(F.lit("a"), "depth", "role", "text")).withColumn("h2", short("text", "role", "depth", F.lit("b")))


def _paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """cid, depth, last, bytes, h1, h2, and the digest k1, k2 of the path down to it; depth 0 has digest 0."""
    light = turns.select("cid", "depth", "last", "part", F.octet_length("text").cast("bigint").alias("bytes"), "h1", "h2")
    sums = light.groupBy("cid", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    before = W.partitionBy("cid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    carried = sums.select("cid", "part", zero(F.bit_xor("x1").over(before)).alias("c1"), zero(F.bit_xor("x2").over(before)).alias("c2"))
    within = W.partitionBy("cid", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = [F.bit_xor(f"h{i}").over(within).bitwiseXOR(F.col(f"c{i}")).alias(f"k{i}") for i in (1, 2)]
    deep = light.join(carried, ["cid", "part"]).select("cid", "depth", "last", "bytes", "h1", "h2", *run)
    none = F.lit(0).cast("bigint")
    return deep.unionByName(convs.select("cid", none.alias("depth"), "last", none.alias("bytes"), *[none.alias(c) for c in ("h1", "h2", "k1", "k2")]))


def digested(turns: DataFrame, convs: DataFrame, digest_bits: int = 128) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes) under digests of which none stands for two turns or two sequences of turns.

    A turn's hash must belong to one (depth, role, text), and a path's digest to one turn's hash and depth. Then a digest has one
    parent digest too, and so, from the root down, one sequence.
    """
    for attempt in count():
        hashed = _hashed(turns, attempt, min(64, (digest_bits // 2) << attempt))
        paths = cut(_paths(hashed, convs), "paths")
        ends = [f(c).alias(f"{n}_{c}") for c in ("h1", "h2", "depth") for n, f in (("min", F.min), ("max", F.max))]
        nodes = cut(paths.groupBy("k1", "k2").agg(*ends, F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"), F.min("cid").alias("owner"),
                                                  F.sum(F.col("last") - F.col("depth") + 1).alias("weight")), "nodes")
        clash = nodes.where("min_h1 <> max_h1 OR min_h2 <> max_h2 OR min_depth <> max_depth")
        twice = hashed.groupBy("h1", "h2", "depth", "role", "text").agg(F.count(F.lit(1))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if clash.isEmpty() and twice.isEmpty():
            parent = [F.col(f"k{i}").bitwiseXOR(F.col(f"min_h{i}")).alias(f"p{i}") for i in (1, 2)]
            return paths, nodes.select("k1", "k2", *parent, F.col("min_depth").alias("depth"), "owner", "n_convs", "bytes", "weight")


SUMS = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, inner boolean, saved bigint, leaves bigint"


def accumulate(frame: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of a shard's nodes (k1, k2, p1, p2, depth, saved, leaves); ``inner``: the parent is in the shard too."""
    key = {c: frame[c].to_numpy(np.int64) for c in ("k1", "k2", "p1", "p2", "depth", "saved", "leaves")}
    table = SlotTable(key["k1"], key["k2"])
    flat = {c: np.zeros(table.size, np.int64) for c in ("depth", "saved", "leaves", "parent")}
    root = (key["depth"] == 0)
    up = np.where(root, -1, table.find(key["p1"], key["p2"]))
    for c, values in (*((c, key[c]) for c in ("depth", "saved", "leaves")), ("parent", up)):
        flat[c][table.slots] = values
    order = np.argsort(-flat["depth"], kind="stable")
    order = order[flat["parent"][order] >= 0]
    _, begin = np.unique(-flat["depth"][order], return_index=True)
    for level in np.split(order, begin[1:]):
        for c in ("saved", "leaves"):
            np.add.at(flat[c], flat["parent"][level], flat[c][level])
    out = frame[["k1", "k2", "p1", "p2"]].copy()
    out["inner"] = up >= 0
    out["saved"], out["leaves"] = flat["saved"][table.slots], flat["leaves"][table.slots]
    return out


def subtree_sums(paths: DataFrame, shared: DataFrame, shard_rows: int = SHARD_ROWS, heavy_nodes: int = HEAVY_NODES) -> DataFrame:
    """(k1, k2, saved, leaves) over the subtrees of nodes that carry ``weight``, a bound on their subtree's nodes, and their own saved and leaves.

    ``weight`` sums to at least (bound + 1) times the number of nodes above the bound, so at most ``heavy_nodes`` are.
    """
    total, rows = shared.agg(F.sum("weight"), F.count(F.lit(1))).first()
    bound = max(shard_rows, (total or 0) // heavy_nodes)
    heavy, light = shared.where(F.col("weight") > bound), shared.where(F.col("weight") <= bound)
    few = F.broadcast(heavy.select("k1", "k2"))
    tops = (paths.select("cid", "depth", "k1", "k2").join(few, ["k1", "k2"], "left_anti").join(light.select("k1", "k2"), ["k1", "k2"], "left_semi")
            .groupBy(F.col("cid").alias("owner")).agg(F.min_by(F.struct("k1", "k2"), "depth").alias("top")))      # where the path enters a light subtree
    shards = max(1, -(-rows // shard_rows))
    value = ["k1", "k2", "p1", "p2", "depth", "saved", "leaves"]
    dealt = light.join(tops, "owner").select(*value, F.pmod(F.xxhash64("top"), F.lit(shards)).alias("shard"))
    low = cut(dealt.groupBy("shard").applyInPandas(lambda frame: accumulate(frame), SUMS), "shard-sums")
    given = low.where("NOT inner").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    high = heavy.join(given, ["k1", "k2"], "left").select(
        "k1", "k2", "p1", "p2", "depth", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")])
    done = high.withColumn("shard", F.lit(0)).groupBy("shard").applyInPandas(lambda frame: accumulate(frame), SUMS)       # at most heavy_nodes rows
    return low.union(done).select("k1", "k2", "saved", "leaves")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the ids in each group, streamed in order: a digest is all that is held of a group."""
    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for k1, k2, cid in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "cid")], strict=True):
                if now != (k1, k2):
                    if state is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (k1, k2), hashlib.sha256(str(cid).encode())
                else:
                    state.update(b",%d" % cid)
            if out:
                yield table(out)
        if state is not None:
            yield table([(*now, state.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])
    return ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "cid").mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         shard_rows: int = SHARD_ROWS, heavy_nodes: int = HEAVY_NODES, digest_bits: int = 128, hot_rows: int | None = None) -> DataFrame:
    """A row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rebuild`` says how conversations are made and what nulls and ties mean. Without conversations there is no node, not even
    the root. Other columns are not read. Two conversations that are equal for millions of turns form a shared chain,
    which one shard holds, at about 60 bytes a turn; no other group comes together in a task.
    """
    hot = {} if hot_rows is None else {"hot_rows": hot_rows}
    turns, convs = rebuild(conversations, conv_id, turn, role, text)
    paths, nodes = digested(turns, convs, digest_bits)
    below = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum(F.when(F.col("n_convs") == 1, 1).otherwise(0)).alias("alone"))
    full = cut(nodes.join(below, ["k1", "k2"], "left").fillna(0, ["n_children", "alone"]), "trie")
    own = [((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves")]
    shared = full.where("n_convs > 1").select("k1", "k2", "p1", "p2", "depth", "owner", "weight", *own)
    sums = cut(subtree_sums(paths, shared, shard_rows, heavy_nodes), "subtree-sums")
    ends = _end_digests(paths.where("depth = last").select("k1", "k2", "cid"))
    told = full.join(sums, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "p1", "p2")
    parents = full.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"), F.col("n_children").alias("n"))
    told = cut(told, "told")
    linked = join_counted(told.where("depth > 0"), parents, ["p1", "p2"], "n", **hot)
    top = told.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return linked.select(*columns).unionByName(top.select(*columns)).withColumns({c: F.col(c).cast("bigint") for c in columns[:-1]})
