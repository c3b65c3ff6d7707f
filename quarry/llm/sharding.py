"""Uniform shuffle into shards of exact size (operator 9).

Rows lie in logical partitions. A communication matrix says how many rows of each partition go to
each shard; it is drawn from the multivariate hypergeometric law, so the result is as if all rows
had been permuted at once. Each partition permutes its rows and deals them out by its matrix row,
and each shard permutes what it got.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import group_rank, hash_order


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; the first shards take the odd rows."""
    return np.full(shards, rows // shards, dtype=np.int64) + (np.arange(shards) < rows % shards)


def communication_matrix(partition_rows, sizes, seed: int) -> np.ndarray:
    """partitions x shards: rows that go from each partition to each shard.

    The margins are exact: row sums are ``partition_rows``, column sums are ``sizes``.
    """
    rng, left = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    out = np.zeros((len(partition_rows), len(left)), dtype=np.int64)
    for p, n in enumerate(partition_rows):
        out[p] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= out[p]
    return out


def shuffle_into_shards(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 42, rows_per_partition: int = 250_000,
                        least_partitions: int = 64) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in the shard) to every row.

    ``keys`` identify a row; the result depends on them, the seed and the row count only, so a lost
    task that runs again gives the same rows. Nulls count as a value. Rows that agree in all keys are
    interchangeable. Empty tables give no rows. Columns called shard or slot are replaced.
    The matrix has partitions x shards cells, the only thing that the driver holds.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    parts = max(least_partitions, -(-df.count() // rows_per_partition))
    rows = (df.withColumn("__h1", hash_order(seed, *keys)).withColumn("__h2", hash_order(seed + 1, *keys))
            .withColumn("__part", F.pmod(hash_order(seed + 2, *keys), F.lit(parts)).cast("int")))
    counts = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    partition_rows = [counts.get(p, 0) for p in range(parts)]
    matrix = communication_matrix(partition_rows, shard_sizes(sum(partition_rows), shards), seed)
    ends = spark.createDataFrame([(p, [int(x) for x in row]) for p, row in enumerate(matrix.cumsum(axis=1))], "__part int, __ends array<bigint>")
    local = group_rank(rows, ["__part"], "__h1", keys, "__rank")
    dealt = local.join(ends, "__part").withColumn("shard", _first_above("__ends", F.col("__rank")))
    return group_rank(dealt.drop("__ends", "__rank", "__part", "__h1"), ["shard"], "__h2", keys, "slot").drop("__h2")


def _first_above(ends: str, rank: Column) -> Column:
    return F.size(F.filter(F.col(ends), lambda e: e <= rank)).cast("int")
