"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "quarry", partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator is designed for.

    On a cluster the number of shuffle partitions is left to the cluster's own
    configuration; AQE coalesces and splits from there.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="quarry-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session may do without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        root = _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: What ``cut_lineage`` made inside each open ``temporary_cuts``.
_CUTS: list[list[str]] = []


@contextlib.contextmanager
def temporary_cuts(spark: SparkSession):
    """Removes at its end the folders that ``cut_lineage`` made inside it, also after an error.

    Results must be written or collected inside: DataFrames that read such a folder cannot be used after it.
    """
    _CUTS.append([])
    try:
        yield
    finally:
        conf, Path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        for path in _CUTS.pop():
            p = Path(path)
            p.getFileSystem(conf).delete(p, True)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` in the shared folder and read it back: survives lost executors. It stays there
    unless ``temporary_cuts`` removes it."""
    path = shared_dir(df.sparkSession, name)
    if _CUTS:
        _CUTS[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for work that costs much per row.

    A table of many files or row groups already has that many splits and comes back as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def explode_once(df: DataFrame, array, name: str, pos: str | None = None) -> DataFrame:
    """``explode`` (or ``posexplode``) of an expensive array expression.

    A plain explode makes the optimizer add a filter on the array's size below it, which computes
    the array a second time; the outer form does not, and the null rows go right after.
    """
    gen = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    out = df.select("*", gen)
    return out.where(F.col(pos).isNotNull() if pos else F.col(name).isNotNull())
