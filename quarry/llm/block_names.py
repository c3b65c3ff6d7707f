"""Exact dedup by deterministic block naming (operator 13).

A text is cut into blocks of a fixed size. Different blocks are sorted and numbered; then adjacent pairs of
numbers are sorted and numbered, level by level, until each text has one number. Two texts have the same
number on the same level if and only if they are equal byte by byte.

Blocks travel once, each different one from each task, to be compared under its digest; after that only
numbers do. A digest that stands for two different blocks is found there, and all blocks are digested anew.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm.common import cut, documents, join_counted, slices

BLOCK_BYTES = 4096
#: Names of a level are sorted and numbered in so many buckets, each a task's work.
BUCKETS = 4096
#: A bucket's names lie this many bits apart.
NAME_BITS = 40


def _digest(block: bytes, seed: int, bits: int) -> tuple[int, int]:
    """128 bits as two signed numbers; fewer bits only for the test of what happens to clashes."""
    both = xxhash.xxh3_128_intdigest(block, seed) & ((1 << bits) - 1)
    return tuple(np.array([both & (2**64 - 1), both >> 64], np.uint64).view(np.int64).tolist())


def _blocks(text: str | None, size: int) -> list[bytes]:
    data = (text or "").encode().lower()      # of bytes: A-Z only
    return [data[i:i + size] for i in range(0, len(data), size)] or [b""]


def _digested(rows: DataFrame, size: int, seed: int, bits: int) -> DataFrame:
    """row, doc_id, the normalised text's SHA-256 and its blocks' digests; no text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            digests, shas = [], []
            for text in batch.column("text").to_pylist():
                blocks = _blocks(text, size)
                digests.append([dict(zip(("h1", "h2"), _digest(b, seed, bits), strict=True)) for b in blocks])
                sha = hashlib.sha256()
                for b in blocks:
                    sha.update(b)
                shas.append(sha.hexdigest())
            pair = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(digests, pa.list_(pair))],
                                             names=["row", "doc_id", "text_sha256", "digests"])
    return rows.mapInArrow(run, f"row bigint, doc_id {kind}, text_sha256 string, digests array<struct<h1: bigint, h2: bigint>>")


def _contents(rows: DataFrame, size: int, seed: int, bits: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, 64):
            blocks = [b for text in batch.column("text").to_pylist() for b in _blocks(text, size)]
            pairs = [_digest(b, seed, bits) for b in blocks]
            for at in range(0, len(blocks), 1024):
                part = slice(at, at + 1024)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs[part]], pa.int64()), pa.array([p[1] for p in pairs[part]], pa.int64()),
                                                  pa.array(blocks[part], pa.binary())], names=["h1", "h2", "block"])
    return rows.select("text").mapInArrow(run, "h1 bigint, h2 bigint, block binary")


def _numbered(keys: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Different keys with ``name``, an integer by their sorted place in a bucket: the same on every run."""
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(*order)).cast("bigint")
    return keys.withColumn("bucket", bucket).withColumn("name", F.shiftleft(F.col("bucket").cast("bigint"), NAME_BITS) + rank).drop("bucket")


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, digest_bits: int = 128) -> DataFrame:
    """(row, doc_id, text_sha256, level, name): (level, name) is the same for equal normalised texts only.

    A row per input row; ``row`` tells rows of one id apart. Null texts are empty; an empty text is one empty block.
    """
    rows = documents(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    for attempt in count():
        bits = min(128, digest_bits << attempt)
        variants = _contents(rows, block_bytes, attempt, bits).groupBy("h1", "h2", "block").agg(F.count(F.lit(1)).alias("n"))
        found = cut(variants.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("variants")), "blocks")
        if found.where("variants > 1").isEmpty():
            break
    light = cut(_digested(rows, block_bytes, attempt, bits), "digests")
    names = cut(_numbered(found.drop("variants"), F.col("h1").bitwiseAND(F.lit(BUCKETS - 1)), ["h1", "h2"]), "block-names")
    each = light.select("row", F.size("digests").alias("blocks"), F.posexplode("digests").alias("pos", "d")).select("row", "blocks", "pos", "d.h1", "d.h2")
    named = cut(join_counted(each, names, ["h1", "h2"], "n").select("row", "blocks", "pos", "name"), "names")
    done = []
    for level in count():
        done.append(named.where("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = named.where("blocks > 1")
        if rest.isEmpty():
            break
        of_side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = cut(rest.groupBy("row", F.expr("(blocks + 1) div 2").cast("int").alias("blocks"), F.expr("pos div 2").cast("int").alias("pos")).agg(
            of_side(0).alias("left"), F.coalesce(of_side(1), F.lit(-1)).alias("right")), "pairs")
        names = cut(_numbered(pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")), F.pmod(F.xxhash64("left", "right"), F.lit(BUCKETS)), ["left", "right"]), "pair-names")
        named = cut(join_counted(pairs, names, ["left", "right"], "n").select("row", "blocks", "pos", "name"), "names")
    ident = done[0]
    for d in done[1:]:
        ident = ident.union(d)
    return light.select("row", "doc_id", "text_sha256").join(ident, "row")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, digest_bits: int = 128) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row per input row, dropped ones too.

    Texts are equal when the same after lower-casing A-Z only; null and empty texts are equal. Of equal texts the row
    with the largest id stays; a null id is smaller than any, and of rows that agree in text and id exactly one
    stays. An empty table gives no rows. Other columns are not read.
    """
    rows = cut(identities(docs, doc_id, text, block_bytes, digest_bits), "identities")
    groups = cut(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")), "groups")
    return join_counted(rows, groups, ["level", "name"], "group_size").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), "text_sha256")
