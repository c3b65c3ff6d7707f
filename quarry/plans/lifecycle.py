"""The state of each corpus around the runs that write its index.

    root/state     one row per transition: status, counts, the run, and a version that grows by one per corpus

A run first records ``indexing``, then withdraws the proof and writes (``plans.index``), and last records ``indexed`` or
``indexfailed``. A transition is one append, which is there whole or not at all. A run whose driver dies stays ``indexing``; after
the grace time ``recover`` settles it by the completion record: with a valid one only the last transition was missing.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions import fixed as X
from quarry.operators import state as S
from quarry.plans import index
from quarry.sources import tables as T

SCHEMA = ("corpus string, version bigint, run_id string, status string, pct double, last_updated string, reason string, error string, "
          "indexed_files bigint, total_chunks bigint, fingerprint struct<provider:string,model:string,dimension:int,store:string,schema_version:string>, fingerprint_source string")
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]


class Busy(RuntimeError):
    """Another run is writing one of the corpora."""


def transitions(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/state"
    return spark.read.schema(SCHEMA).parquet(path) if T.exists(spark, path) else spark.createDataFrame([], SCHEMA)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each corpus; of two runs' rows with one version the greater run id counts."""
    rows = transitions(spark, root)
    newest = F.max_by(F.struct(*[c for c in COLUMNS if c != "corpus"]), F.struct("version", "run_id"))
    return rows.groupBy("corpus").agg(newest.alias("r")).select("corpus", "r.*")


def _append(rows: DataFrame, root: str) -> None:
    rows.select(*[F.col(c).cast(t.dataType) for c, t in zip(COLUMNS, rows.sparkSession.createDataFrame([], SCHEMA).schema, strict=True)]).write.mode("append").parquet(f"{root}/state")


def _stamp(now: Column) -> Column:
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")


def _stale(now: Column, grace: float) -> Column:
    age = S.age_seconds(F.col("last_updated"), now)
    return age.isNull() | (age > grace)


def begin(corpora: DataFrame, root: str, fingerprint: Column, now: Column, run_id: str, grace: float = X.RECOVERY_GRACE_SECONDS) -> None:
    """Record that a run starts to write ``corpora``. Raises ``Busy`` where another run of the last ``grace`` seconds does."""
    spark = corpora.sparkSession
    mine = T.cut_lineage(corpora.select("corpus").distinct().join(current(spark, root), "corpus", "left"), "begin")
    busy = [r["corpus"] for r in mine.where((F.col("status") == "indexing") & ~_stale(now, grace)).select("corpus").limit(5).collect()]
    if busy:
        raise Busy(f"being written by another run: {busy}")
    none = F.lit(None)
    _append(mine.withColumns({"version": F.coalesce("version", F.lit(0)) + 1, "run_id": F.lit(run_id), "status": F.lit("indexing"), "pct": F.lit(0.0),
                              "last_updated": _stamp(now), "reason": none, "error": none, "fingerprint": fingerprint, "fingerprint_source": F.lit("verified")}), root)


def beat(spark: SparkSession, root: str, run_id: str, now: Column, pct: float) -> None:
    """Sign of life of a run, with its progress: what it is writing is not taken for interrupted until the grace time is over anew."""
    mine = current(spark, root).where((F.col("run_id") == run_id) & (F.col("status") == "indexing"))
    _append(T.cut_lineage(mine, "beat").withColumns({"version": F.col("version") + 1, "last_updated": _stamp(now), "pct": F.lit(float(pct))}), root)


def finish(spark: SparkSession, root: str, run_id: str, now: Column, error: str | None = None) -> None:
    """End a run: its corpora are indexed, with the counts of their proofs, or failed with ``error``.

    A corpus that the run left without a proof, since it has no chunk, is indexed with zero counts.
    """
    mine = current(spark, root).where((F.col("run_id") == run_id) & (F.col("status") == "indexing"))
    cols = {"version": F.col("version") + 1, "last_updated": _stamp(now)}
    if error is not None:
        ended = mine.withColumns(cols | {"status": F.lit("indexfailed"), "reason": F.lit("error"), "error": F.lit(error)})
    else:
        proof = T.proofs(spark.read.parquet(f"{root}/commits")).select("corpus", F.col("indexed_files").alias("_f"), F.col("total_chunks").alias("_c"))
        ended = mine.join(proof, "corpus", "left").withColumns(cols | {
            "status": F.lit("indexed"), "pct": F.lit(100.0), "indexed_files": F.coalesce("_f", F.lit(0)), "total_chunks": F.coalesce("_c", F.lit(0))})
    _append(T.cut_lineage(ended, "ended"), root)


@contextlib.contextmanager
def tracked(corpora: DataFrame, root: str, fingerprint: Column, now: Column, run_id: str, grace: float = X.RECOVERY_GRACE_SECONDS):
    """Around any job that writes ``corpora`` in the index; an error is recorded and raised on."""
    spark = corpora.sparkSession
    begin(corpora, root, fingerprint, now, run_id, grace)
    try:
        yield
    except Exception as e:
        finish(spark, root, run_id, now, f"{type(e).__name__}: {e}"[:1000])
        raise
    finish(spark, root, run_id, now)


def build(files: DataFrame, root: str, embed, fingerprint: Column, now: Column, run_id: str, **options) -> None:
    """``index.build`` with its transitions."""
    with tracked(files, root, fingerprint, now, run_id):
        index.build(files, root, embed, fingerprint, now, run_id, **options)


def sync(files: DataFrame, root: str, embed, fingerprint: Column, now: Column, run_id: str, **options) -> DataFrame:
    """``index.sync`` with its transitions; gives the delta."""
    with tracked(files, root, fingerprint, now, run_id):
        return index.sync(files, root, embed, fingerprint, now, run_id, **options)


def recover(spark: SparkSession, root: str, fingerprint: Column, now: Column, grace: float = X.RECOVERY_GRACE_SECONDS) -> DataFrame:
    """Settle interrupted runs, see ``state.recover_interrupted``; gives (corpus, action, status, reason) of those that it changed.

    A proof counts only if it is newer than the withdrawal of the run. It is the proof of another run where the died one
    had not come to withdraw it: then nothing was written and the index is as that proof says.
    """
    commits = f"{root}/commits"
    if not T.exists(spark, commits):
        # a first run that died before it wrote anything
        log = spark.createDataFrame([], "corpus string, kind string, fingerprint struct<provider:string,model:string,dimension:int,store:string,schema_version:string>, "
                                        "indexed_files bigint, total_chunks bigint, completed_at string, run_id string, status string")
    else:
        log = spark.read.parquet(commits)
    last = F.struct(F.try_to_timestamp("completed_at").alias("a"), F.col("run_id").alias("b"), (F.col("kind") != T.WITHDRAWN).alias("c"))
    newest = log.groupBy("corpus").agg(F.max_by(F.struct(*[c for c in log.columns if c != "corpus"]), last).alias("r")).select("corpus", "r.*")
    settled = S.recover_interrupted(current(spark, root), newest, fingerprint, now, grace).where("action <> 'none'")
    settled = T.cut_lineage(settled.withColumns({"version": F.col("version") + 1, "last_updated": _stamp(now)}), "settled")
    _append(settled, root)
    return settled.select("corpus", "action", "status", "reason")


def gate(spark: SparkSession, root: str, fingerprint: Column) -> DataFrame:
    """(corpus, open, reason) for ``search.search_batch``: status, fingerprint and proof as they are now."""
    return S.search_gate(current(spark, root), T.proofs(spark.read.parquet(f"{root}/commits")), fingerprint)
