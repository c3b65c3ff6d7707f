"""Near copies by the similarity of their 5-word shingles, for the pipeline's near-duplicate stage.

Texts meet by bands of min-hashes and each pair that is met is compared exactly. In a group the least row
leads: the others are compared with it and go when they are near it, and those that are left are a group
without it in the next round. So no pair that stays is near and shares a band, and a group of millions of
near copies costs one comparison a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import cut, slices
from quarry.llm.simhash import row_hash

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with chance (1 - 0.8 ** ROWS) ** BANDS = 0.00007.
BANDS, ROWS = 24, 5
#: In groups of at most so many rows all pairs are compared at once.
GROUP_ROWS = 32
_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Shingles that are hashed at a time.
_PART = 1 << 12


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's runs of words, sorted; a shorter text is one run, one without words has none."""
    words = (text or "").encode().lower().split()
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) > shingle else [words] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A signed key for each band of the min-hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), _PART):
        np.minimum(least, ((found[at:at + _PART, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), i) - 2**63 for i, part in enumerate(least.reshape(BANDS, ROWS))]


def near(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the shared part of two sets' union is at least ``similarity``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both >= similarity * (len(a) + len(b) - both)


def _sketches(rows: DataFrame) -> DataFrame:
    """(id, row, size, keys) of each row with words; size is that of its set."""
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(
                [bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["id", "row", "size", "keys"])
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row bigint, size bigint, keys array<bigint>")


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(row) of the pairs (row, lead) whose texts are near."""
    def run(batches):
        last, of = None, None
        for batch in slices(batches):
            gone = []
            for row, lead, mine, other in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if lead != last:
                    last, of = lead, shingles(other)
                if near(shingles(mine), of, similarity):
                    gone.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["row"])
    both = (pairs.join(texts, "row").join(texts.select(F.col("row").alias("lead"), F.col("text").alias("other")), "lead")
            .select("row", "lead", "text", "other"))
    return both.mapInArrow(run, "row bigint").distinct()


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows without those whose 5-word shingles are at least ``similarity`` like those of a row with a smaller id.

    What a row that goes is near may go too, for a still smaller one. Rows with null ids, and texts without
    words, neither go nor make others go. Rows that repeat id and text stay together.
    """
    marked = docs.withColumn("__row", row_hash(doc_id, text))
    rows = marked.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col("__row").alias("row"), F.col(text).alias("text")).dropDuplicates(["row"])
    texts = rows.select("row", "text")
    live = cut(_sketches(rows).select("id", "row", "size", F.explode("keys").alias("key")), "sketches")
    gone = None
    while True:
        groups = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "size")).alias("lead")).where("n > 1")
        met = cut(live.join(groups, "key"), "met")
        small = met.where(F.col("n") <= group_rows).select("key", "id", "row", "size")
        first = small.select("key", F.struct("id", "row", "size").alias("lead"))
        pairs = small.join(first, "key").union(met.where(F.col("n") > group_rows).select("key", "id", "row", "size", "lead"))
        pairs = pairs.where((F.struct("id", "row") > F.struct("lead.id", "lead.row")) & (F.least("size", "lead.size") >= similarity * F.greatest("size", "lead.size")))
        new = cut(_confirmed(pairs.select("row", F.col("lead.row").alias("lead")).distinct(), texts, similarity), "near-copies")
        gone = new if gone is None else gone.union(new)
        # leaders of large groups have been compared with all of their group
        left = met.where((F.col("n") > group_rows) & (F.col("row") != F.col("lead.row"))).select("id", "row", "size", "key").join(new, "row", "left_anti")
        live = cut(left.select("id", "row", "size", "key"), "sketches")
        if live.isEmpty():
            return marked.join(gone.distinct(), marked["__row"] == gone["row"], "left_anti").drop("__row")
