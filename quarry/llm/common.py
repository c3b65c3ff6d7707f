"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.session import cut_lineage as cut

__all__ = ["SUB_BITS", "cut", "documents", "group_rank", "hash_order", "join_counted", "slices", "word_count"]

#: Each ranked group is ranked in so many (2 ** SUB_BITS) slices of its hash order.
SUB_BITS = 12
#: A key of more rows is joined by broadcast; there are at most HOT_KEYS of them, whatever the table.
HOT_ROWS, HOT_KEYS = 50_000, 50_000


def slices(batches, rows: int = 256):
    """The Arrow batches of a task in short pieces, so that only few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the named columns, so extra columns of the input never clash with those an operator adds."""
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *more)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    lean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(lean) - F.length(F.replace(lean, F.lit("w"), F.lit("")))).cast("long")


def hash_order(seed: int, *cols) -> Column:
    """A uniform 64-bit number that depends on the seed and the columns only."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])


def group_rank(df: DataFrame, groups: list[str], order: str, ties: list[str], name: str = "rank", weight: str | None = None) -> DataFrame:
    """Add ``name``: the row's 0-based rank in its group by the uniform hash column ``order``.

    With ``weight``: the sum of that column over the rows before it. A group is not sorted by one task:
    its hash range is cut into slices, each slice is ranked by itself, and the slices' sums (a small
    table) give where each begins. Groups must not be null. Names that begin with two underscores are
    kept for use inside.
    """
    sub = F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(2**63))), 64 - SUB_BITS)
    df = df.withColumn("__sub", sub)
    amount = F.col(weight) if weight else F.lit(1)
    counts = df.groupBy(*groups, "__sub").agg(F.sum(amount).alias("__n"))
    start = counts.select(*groups, "__sub", F.coalesce(F.sum("__n").over(W.partitionBy(*groups).orderBy("__sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    slice_ = W.partitionBy(*groups, "__sub").orderBy(order, *ties)
    within = F.coalesce(F.sum(weight).over(slice_.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(slice_) - 1
    return (df.withColumn("__within", within).join(start, [*groups, "__sub"])
            .withColumn(name, F.col("__start") + F.col("__within")).drop("__sub", "__within", "__start"))


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has one row per key and in ``n`` how many of ``rows`` have that key.

    A key of many rows would send them all to one task. Such keys are few (at most HOT_KEYS, as the limit grows with the
    sum of ``n``), so theirs are broadcast and their rows stay where they are; the other keys are joined by a shuffle.
    """
    total, most = found.agg(F.sum(n), F.max(n)).first()
    limit = max(hot_rows, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return rows.join(found, keys)
    hot = found.where(F.col(n) > limit)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(found.where(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)
