"""Chat formatting into a prefix tree (operator 6).

Conversations that share their first turns share the nodes of a tree. Every node's tokens are emitted
once, in depth-first order, in one stream; a node carries its position ids and the stream intervals of
its ancestors that it may attend to. A conversation is a list of stream intervals.

A node belongs to the least conversation that passes through it, so a conversation owns a run at the end
of its path, and the runs, not the single nodes, are put in order: a run is followed by the runs that
branch off it, the deepest first, which is depth-first order.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm.common import cut

# --- fixed values: the template ---------------------------------------------------------------
START, FINISH = "<|im_start|>", "<|im_end|>"
START_ID, FINISH_ID = 50257, 50258
LOSS_ROLE = "assistant"
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    """No control string can stand in the result: every backslash is doubled and ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As for texts; line ends, which end the role in the template, become a backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str, role: bool = False) -> str:
    return _BACK.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The worker's own byte-level encoder for a rank file."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={START: START_ID, FINISH: FINISH_ID})
    return _ENCODERS[path]


def _paths(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """A row per turn: cid, depth, the path's 128-bit hash (k1, k2) up to it, role and text.

    Turns are ordered by turn (null first), role, text. Null roles and texts are empty ones.
    """
    t = conversations.select(
        F.col(conv_id).alias("conv_id"), F.coalesce(F.col(conv_id).cast("string"), F.lit("\x00")).alias("cid"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = W.partitionBy("cid").orderBy("turn", "role", "text")
    t = t.withColumn("depth", F.row_number().over(order))
    t = t.withColumn("h1", F.xxhash64(F.lit(11), "depth", "role", "text")).withColumn("h2", F.xxhash64("text", "role", "depth", F.lit(23)))
    so_far = W.partitionBy("cid").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    return t.select("conv_id", "cid", "depth", F.bit_xor("h1").over(so_far).alias("k1"), F.bit_xor("h2").over(so_far).alias("k2"), "role", "text")


def _encoded(nodes: DataFrame, ranks: str) -> DataFrame:
    """nodes with ``ids``, ``n_tokens`` and the loss interval inside the node (empty where no loss is taken)."""
    def run(batches):
        enc = encoder(ranks)
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            ids, lows, highs = [], [], []
            for head, body, scored in zip(cols["head"].to_pylist(), cols["body"].to_pylist(), cols["scored"].to_pylist(), strict=True):
                first, middle = enc.encode_ordinary(head + "\n"), enc.encode_ordinary(body)
                ids.append([START_ID, *first, *middle, FINISH_ID, *enc.encode_ordinary("\n")])
                lows.append(1 + len(first))
                highs.append(1 + len(first) + (len(middle) if scored else 0))
            keep = [cols[n] for n in ("k1", "k2", "owner", "depth")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())],
                names=["k1", "k2", "owner", "depth", "ids", "n_tokens", "loss_start", "loss_end"])
    return nodes.mapInArrow(run, "k1 bigint, k2 bigint, owner string, depth int, ids array<int>, n_tokens bigint, loss_start bigint, loss_end bigint")


def _run_starts(runs: DataFrame) -> DataFrame:
    """(owner, run_start): where each run begins in the stream, by its place in depth-first order.

    The runs are range-sorted; what a partition holds is summed, and the sums give where each partition begins.
    """
    placed = cut(runs.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "runs")
    sums = placed.groupBy("part").agg(F.sum("own").alias("n"))
    begin = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))   # a row per partition
    within = W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    return (placed.withColumn("before", F.coalesce(F.sum("own").over(within), F.lit(0))).join(begin, "part")
            .select("owner", (F.col("begin") + F.col("before")).alias("run_start"), "ahead"))


def build(conversations: DataFrame, ranks: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stream, paths, members).

    stream: a row per different prefix: ids, n_tokens, stream_start, position_start, loss_start and loss_end inside
    the node, ancestors (array of stream intervals), owner, depth, k1, k2. paths: conv_id, cid, depth, k1, k2 per
    turn. members: conv_id, cid, n_turns and the conversation's stream intervals, in order.

    Null ids are one conversation; rows that repeat are turns of their own; empty tables give empty results.
    Other columns are not read. A conversation is ordered by one task, as its turns depend on one another; what many
    conversations share is summed up before it is joined.
    """
    paths = cut(_paths(conversations, conv_id, turn, role, text), "paths")
    light = paths.select("conv_id", "cid", "depth", "k1", "k2")
    owners = light.groupBy("k1", "k2").agg(F.min("cid").alias("owner"))
    own = paths.join(owners, ["k1", "k2"]).where("cid = owner").select(
        "k1", "k2", "owner", "depth", escape_role(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("scored"))
    nodes = cut(_encoded(own, ranks), "nodes")
    parts = cut(light.join(nodes.select("k1", "k2", "owner", "n_tokens"), ["k1", "k2"]).groupBy("cid", "owner").agg(
        F.max("depth").alias("last"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"), F.first("conv_id").alias("conv_id")), "path-parts")
    ordered = parts.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("last", "owner", "tokens"))).alias("on_path"))     # one for each branch that the path took
    key = F.transform("on_path", lambda p, i: F.struct(F.when(i == 0, 0).otherwise(-F.get(F.col("on_path"), i - 1)["last"]).alias("off"), p["owner"].alias("owner")))
    ahead = F.aggregate(F.filter("on_path", lambda p: p["owner"] != F.col("cid")), F.lit(0).cast("bigint"), lambda a, p: a + p["tokens"])
    runs = ordered.where(F.element_at("on_path", -1)["owner"] == F.col("cid")).select(
        F.col("cid").alias("owner"), key.alias("key"), F.element_at("on_path", -1)["tokens"].alias("own"), ahead.alias("ahead"))
    starts = cut(_run_starts(runs), "run-starts")
    spans = parts.join(starts.select("owner", "run_start"), "owner").groupBy("cid").agg(
        F.sort_array(F.collect_list(F.struct("last", F.col("run_start").alias("start"), (F.col("run_start") + F.col("tokens")).alias("end"), "owner"))).alias("spans"),
        F.sum("turns").alias("n_turns"), F.first("conv_id").alias("conv_id"))
    spans = cut(spans, "spans")
    bare = lambda column: F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    members = spans.select("conv_id", "cid", "n_turns", bare(F.col("spans")).alias("intervals"))
    before = W.partitionBy("owner").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    upward = spans.select(F.col("cid").alias("owner"), bare(F.filter("spans", lambda s: s["owner"] != F.col("cid"))).alias("ancestors"))
    stream = (nodes.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(starts, "owner").join(upward, "owner")
              .withColumn("own_start", F.col("run_start")).withColumn("stream_start", F.col("run_start") + F.col("before"))
              .withColumn("position_start", F.col("ahead") + F.col("before"))
              .withColumn("ancestors", F.when(F.col("before") > 0, F.concat("ancestors", F.array(F.struct(F.col("own_start").alias("start"), F.col("stream_start").alias("end"))))).otherwise(F.col("ancestors")))
              .drop("before", "run_start", "ahead", "own_start"))
    return stream, light, members


def read_back(stream: DataFrame, paths: DataFrame, ranks: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from the stream's tokens.

    The tokens of the nodes on a conversation's path are decoded and parsed in order; a digest runs over the turns, so
    a long conversation is never held whole.
    """
    rows = paths.join(stream.select("k1", "k2", "ids", "loss_start", "loss_end"), ["k1", "k2"]).select("conv_id", "cid", "depth", "ids", "loss_start", "loss_end")
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        enc, now, state = encoder(ranks), None, None
        form = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(FINISH) + r"\n", re.DOTALL)

        def close():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or r["cid"] != now:
                    if state is not None:
                        out.append(close())
                    now, state = r["cid"], [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = enc.decode_bytes(r["ids"]).decode()
                m = form.fullmatch(formatted)
                scored = unescape(enc.decode_bytes(r["ids"][r["loss_start"]:r["loss_end"]]).decode())
                state[1] += 1
                state[2].update(f"{unescape(m[1], True)}\n{unescape(m[2])}\n".encode())
                state[3] += len(scored)
                state[4].update(scored.encode())
                state[5] += len(formatted)
            if out:
                yield table(out)
        if state is not None:
            yield table([close()])

    def table(rows):
        types = [to_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    to_arrow = to_arrow_type(kind)
    return rows.repartition("cid").sortWithinPartitions("cid", "depth").mapInArrow(run, schema)
