"""Chunk and commit tables on plain parquet: upsert, delete, rebuild, commit records.

The functions that change a table take and give DataFrames; ``write_partitions`` is the one
place that writes. Tables are partitioned by corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from quarry.functions import fixed as X
from quarry.functions.paths import normalize_path
from quarry.session import cut_lineage


PARTITION_COLUMNS = ("corpus", "bucket")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Incoming rows replace rows of the same key; ids derive from content, so a repeat changes nothing."""
    fresh = incoming.dropDuplicates([key])
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks without those of the given (corpus, path) rows; paths are normalised and deduplicated."""
    return chunks.join(clean_paths(paths), ["corpus", "path"], "left_anti")


def clean_paths(paths: DataFrame) -> DataFrame:
    return paths.select("corpus", normalize_path(F.col("path")).alias("path")).where("path IS NOT NULL").distinct()


def deleted_counts(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Requested paths per corpus and the chunks that go with them."""
    p = clean_paths(paths)
    hit = chunks.join(p, ["corpus", "path"], "left_semi").groupBy("corpus").agg(F.count(F.lit(1)).alias("chunks"))
    return p.groupBy("corpus").agg(F.count(F.lit(1)).alias("paths")).join(hit, "corpus", "left").na.fill(0, ["chunks"])


def query(chunks: DataFrame, where: str, columns: list[str], limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Filter, projection and, where one is given, limit. Nothing is cut unasked; ``fixed.QUERY_LIMIT`` is what a caller
    passes for the store's own limit of an unfiltered query."""
    df = chunks.where(where) if where else chunks
    return (df if limit is None else df.orderBy(*(order or ["chunk_id"])).limit(limit)).select(*columns)


def rebuild(existing: DataFrame, fresh: DataFrame, corpora: DataFrame) -> DataFrame:
    """All rows of the named corpora are dropped, whatever their id, and built anew."""
    return existing.join(corpora.select("corpus").distinct(), "corpus", "left_anti").unionByName(
        fresh.join(corpora.select("corpus").distinct(), "corpus", "left_semi"), allowMissingColumns=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table with its partition values as the strings they were written from."""
    raw = spark.read.parquet(path)
    inferred = [c for c, kind in raw.dtypes if c in PARTITION_COLUMNS and kind != "string"]
    if not inferred:
        return raw
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in inferred else f.dataType, f.nullable) for f in raw.schema.fields])
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("corpus",), staged: bool = True,
                     replaces: DataFrame | None = None, order: tuple[str, ...] = ()) -> None:
    """Replace just the partitions that occur in ``df``, or those of ``replaces`` when given: one of
    these without rows in ``df`` goes away.

    ``df`` may read the table it replaces: unless ``staged`` is off, it is written to the shared
    folder first. The rebalance hint splits a partition that holds most rows over several tasks.
    ``order`` sorts each file, so that a reader can skip parts of it.
    """
    rows = cut_lineage(df, "staged") if staged else df
    laid = rows.hint("rebalance", *[F.col(c) for c in by])
    laid = laid.sortWithinPartitions(*by, *order) if order else laid
    (laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))
    if replaces is not None:
        drop_partitions(replaces.select(*by).distinct().join(rows.select(*by).distinct(), list(by), "left_anti"), path)


def drop_partitions(parts: DataFrame, path: str) -> None:
    """Delete partition folders; ``parts`` has their values, one row per partition."""
    spark = parts.sparkSession
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in parts.toLocalIterator():
        fs.delete(Path("/".join([path] + [names.getPartitionPathString(c, str(row[c])) for c in parts.columns])), True)


def cap_chunks(chunks: DataFrame, cap: int, buckets: int | None = None) -> DataFrame:
    """The first ``cap`` chunks per corpus in file order, with the corpus status.

    Files are cut into ranges of paths; counts per range are summed in order, and only the
    ranges' own rows are counted one by one. No task sees a whole corpus.
    """
    spark = chunks.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_file = chunks.groupBy("corpus", "path").agg(F.count(F.lit(1)).alias("n"))
    ranged = per_file.repartitionByRange(n, "corpus", "path").withColumn("_b", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")      # range numbers must not change between uses
    totals = ranged.groupBy("corpus", "_b").agg(F.sum("n").alias("t"))
    before = totals.select("corpus", "_b", (F.sum("t").over(W.partitionBy("corpus").orderBy("_b")) - F.col("t")).alias("_before"))
    whole = totals.groupBy("corpus").agg(F.when(F.sum("t") >= cap, "limit_reached").otherwise("completed").alias("status"))
    own = F.sum("n").over(W.partitionBy("corpus", "_b").orderBy("path")) - F.col("n")
    placed = ranged.withColumn("_own", own).join(before, ["corpus", "_b"]).withColumn("_first", F.col("_own") + F.col("_before"))
    files = placed.where(F.col("_first") < cap).select("corpus", "path", "n", "_first")
    kept = chunks.join(files, ["corpus", "path"])
    inside = F.col("_first") + F.row_number().over(W.partitionBy("corpus", "path").orderBy("start_line", "chunk_id")) <= cap
    split = kept.where(F.col("_first") + F.col("n") > cap).withColumn("_in", inside).where("_in").drop("_in")
    full = kept.where(F.col("_first") + F.col("n") <= cap)
    return full.unionByName(split).drop("n", "_first").join(whole, "corpus")


# --- commit records -------------------------------------------------------------------------
#: The kind of a record that takes back what earlier records of a corpus prove.
WITHDRAWN = "withdrawn"
FINGERPRINT = ["provider", "model", "dimension", "store", "schema_version"]


def valid_commit() -> Column:
    checks = [F.col("kind") == X.MARKER_KIND, F.length("corpus") > 0, F.col("indexed_files") >= 0, F.col("total_chunks") >= 0,
              F.try_to_timestamp("completed_at").isNotNull(), F.length("run_id") > 0, F.col("fingerprint").isNotNull()]
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def latest_commits(commits: DataFrame, only_valid: bool = False) -> DataFrame:
    """The newest record per corpus; malformed ones can be left out. Pre-aggregates before the shuffle."""
    c = commits.where(valid_commit()) if only_valid else commits
    row = F.struct(*[x for x in commits.columns if x != "corpus"])
    order = F.struct(F.try_to_timestamp("completed_at").alias("a"), F.col("run_id").alias("b"))
    return c.groupBy("corpus").agg(F.max_by(row, order).alias("r")).select("corpus", "r.*")


def proofs(commits: DataFrame) -> DataFrame:
    """The newest valid record of each corpus, unless it was withdrawn since; a run's own completion comes after its withdrawal."""
    log = commits.where(valid_commit() | (F.col("kind") == WITHDRAWN))
    row = F.struct(*[x for x in commits.columns if x != "corpus"])
    order = F.struct(F.try_to_timestamp("completed_at").alias("a"), F.col("run_id").alias("b"), (F.col("kind") != WITHDRAWN).alias("c"))
    return log.groupBy("corpus").agg(F.max_by(row, order).alias("r")).select("corpus", "r.*").where(F.col("kind") != WITHDRAWN)
