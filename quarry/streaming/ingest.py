"""Continuous sync: a stream of file versions keeps a chunk table current.

Two append-only parquet tables, both partitioned by batch: ``versions`` (one row per changed
file) and ``chunks``. A batch writes only what changed, and writing a batch again replaces just
that batch, so a retry after a lost executor or driver does no harm. The current chunks are
those of each file's newest version.

Every so many batches the versions are folded into ``base/<batch>``, one row per file, deleted ones too. A batch then reads the
newest finished base and the few batches after it, so its time depends on the files and not on how many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.incremental import KEY
from quarry.session import cut_lineage

COMPACT_EVERY = 32
VERSIONS = "corpus string, path string, content_hash string, deleted boolean, mtime bigint, batch bigint"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not exist yet."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(conf).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def base_batch(spark: SparkSession, root: str, before: int | None = None) -> int:
    """The last batch that a finished base covers, -1 if there is none; bases from ``before`` on do not count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/base")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return -1
    held = [s.getPath() for s in fs.listStatus(p)]
    done = [int(d.getName()) for d in held if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))]
    return max([n for n in done if before is None or n < before], default=-1)


def versions(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest version of every file, of all batches or of those before a batch."""
    at = base_batch(spark, root, before)
    v = _read(spark, f"{root}/versions", VERSIONS).where(F.col("batch") > at)
    v = v if before is None else v.where(F.col("batch") < before)
    if at >= 0:
        v = v.unionByName(spark.read.schema(VERSIONS).parquet(f"{root}/base/{at}"))
    newest = F.max_by(F.struct("content_hash", "deleted", "mtime", "batch"), F.struct("batch", "mtime"))
    return v.groupBy(*KEY).agg(newest.alias("v")).select(*KEY, "v.*")


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Fold the versions of all batches up to ``upto`` into a base. A run that dies leaves a folder without a mark, which is not read,
    and a repeat writes the same base again."""
    versions(spark, root, upto + 1).select("corpus", "path", "content_hash", "deleted", "mtime", "batch").write.mode("overwrite").parquet(f"{root}/base/{upto}")


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    live = versions(spark, root).where("NOT deleted").select(*KEY, "batch")
    return spark.read.parquet(f"{root}/chunks").join(live, [*KEY, "batch"]).drop("batch")


def apply_batch(batch: DataFrame, batch_id: int, root: str, split: Callable[[DataFrame], DataFrame], compact_every: int = COMPACT_EVERY) -> None:
    """File versions (corpus, path, content, mtime, deleted) of one batch; repeats within the batch
    and files whose hash did not change are left out."""
    spark = batch.sparkSession
    if batch_id > 0 and batch_id % compact_every == 0:
        compact(spark, root, batch_id - 1)
    # versions are chosen and compared by hashes; the content itself is joined to what changed at the end
    known = batch.select(*KEY, "mtime", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.sha2("content", 256).alias("content_hash"))
    new = (known.groupBy(*KEY).agg(F.max_by(F.struct("mtime", "deleted", "content_hash"), F.struct("mtime", "deleted", "content_hash")).alias("r")).select(*KEY, "r.*")
           .withColumn("content_hash", F.when(~F.col("deleted"), F.col("content_hash"))))
    old = versions(spark, root, batch_id).select(
        *KEY, F.col("content_hash").alias("_h"), F.col("deleted").alias("_d"), F.col("mtime").alias("_m"))
    j = new.join(old, KEY, "left")
    seen = F.col("_d").isNotNull()
    stale = seen & (F.col("_m") > F.col("mtime"))
    same = seen & F.col("_h").eqNullSafe(F.col("content_hash")) & (F.col("_d") == F.col("deleted"))
    changed = j.where(~F.coalesce(stale, F.lit(False)) & ~same & ~(~seen & F.col("deleted"))).drop("_h", "_d", "_m").withColumn("batch", F.lit(batch_id).cast("bigint"))
    write = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/{name}")
    changed = cut_lineage(changed, "changed")
    at = [*KEY, "mtime", "content_hash"]
    texts = batch.select(*KEY, "mtime", F.sha2("content", 256).alias("content_hash"), "content").join(
        changed.where("NOT deleted").select(*at), at, "left_semi").dropDuplicates(at).select(*KEY, "content")
    # chunks first: a version row is what makes them visible
    write(split(texts).withColumn("batch", F.lit(batch_id).cast("bigint")), "chunks")
    write(changed.select(*KEY, "content_hash", "deleted", "mtime", "batch"), "versions")


def start(files: DataFrame, root: str, checkpoint: str, split: Callable[[DataFrame], DataFrame], every: str = "3 minutes",
          available_now: bool = False) -> StreamingQuery:
    w = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(df, i, root, split))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
