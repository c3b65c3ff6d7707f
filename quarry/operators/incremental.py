"""Content-hash snapshots and what follows from their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import fixed as X
from quarry.functions.ignore_rules import is_ignored
from quarry.functions.paths import ancestors, extension, is_hidden, normalize_path
from quarry.sources.tables import delete_paths

KEY = ["corpus", "path"]


def file_snapshot(files: DataFrame) -> DataFrame:
    """(corpus, path, content_hash, size, mtime) from file bytes or text."""
    return files.select(*KEY, F.sha2("content", 256).alias("content_hash"), "size", "mtime")


def hash_needed(stats: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """Status rows with the hash to reuse, or null where the content has to be read."""
    prev = previous.select(*KEY, F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    same = (F.col("_s") == F.col("size")) & (F.col("_m") == F.col("mtime")) & F.lit(not force)
    return stats.join(prev, KEY, "left").withColumn("reused_hash", F.when(same, F.col("_h"))).drop("_s", "_m", "_h")


def snapshot_with_reuse(files: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """A snapshot that reads content only where size or time changed."""
    need = hash_needed(files.select(*KEY, "size", "mtime"), previous, force)
    read = (files.select(*KEY, "content").join(need.where("reused_hash IS NULL").select(*KEY), KEY, "left_semi")
            .select(*KEY, F.sha2("content", 256).alias("_new")))
    return (need.join(read, KEY, "left")
            .select(*KEY, F.coalesce("reused_hash", "_new").alias("content_hash"), "size", "mtime", F.col("reused_hash").isNull().alias("hashed")))


def snapshot_fetched(need: DataFrame, fetched: DataFrame) -> DataFrame:
    """The snapshot of ``hash_needed`` rows, given the contents (corpus, path, content) of those that had to be read.

    A file that had to be read and is not among the contents could not be read: it has no row.
    """
    read = need.where("reused_hash IS NULL").join(fetched.select(*KEY, F.sha2("content", 256).alias("_new")), KEY)
    cols = [*KEY, "content_hash", "size", "mtime", "hashed"]
    return (need.where("reused_hash IS NOT NULL").withColumns({"content_hash": F.col("reused_hash"), "hashed": F.lit(False)}).select(*cols)
            .unionByName(read.withColumns({"content_hash": F.col("_new"), "hashed": F.lit(True)}).select(*cols)))


def full_hash_due(run: Column, every: Column) -> Column:
    """Run number ``run`` (from 1) hashes everything: each Nth one, never when N is 0; N is held in 0..1000000."""
    n = F.least(F.greatest(F.floor(every), F.lit(0)), F.lit(1_000_000))
    return (n > 0) & (F.pmod(run, F.greatest(n, F.lit(1))) == 0)


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(corpus, path, change) with change added, removed or modified."""
    p = previous.select(*KEY, F.col("content_hash").alias("_p"), F.lit(True).alias("_op"))
    c = current.select(*KEY, F.col("content_hash").alias("_c"), F.lit(True).alias("_oc"))
    change = (F.when(F.col("_op").isNull(), "added").when(F.col("_oc").isNull(), "removed")
              .when(~F.col("_p").eqNullSafe(F.col("_c")), "modified"))
    return p.join(c, KEY, "full_outer").select(*KEY, change.alias("change")).where("change IS NOT NULL")


def diff_counts(delta: DataFrame) -> DataFrame:
    return delta.groupBy("corpus").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")])


def compress_prefixes(prefixes: DataFrame, col: str = "prefix") -> DataFrame:
    """Normalised prefixes that no other prefix covers: an equi join on their ancestors."""
    p = prefixes.select("corpus", normalize_path(F.col(col)).alias("prefix")).where("prefix IS NOT NULL").distinct()
    above = p.select("corpus", F.col("prefix").alias("_p"), F.explode(ancestors(F.col("prefix"))).alias("prefix"))
    covered = above.join(p, ["corpus", "prefix"], "left_semi").select("corpus", F.col("_p").alias("prefix")).distinct()
    return p.join(covered, ["corpus", "prefix"], "left_anti")


def preserve_unscanned(previous: DataFrame, scanned: DataFrame, unreadable: DataFrame, unscanned: DataFrame,
                       ignore_rules: list[str] | None = None) -> DataFrame:
    """The state to compare and store: what was scanned, and earlier rows of unreadable files and
    of folders that could not be listed. Ignored or hidden paths never stay.

    The prefix test is an equi join on the path's own ancestors.
    """
    cols = [*KEY, "content_hash", "size", "mtime"]
    old = previous.join(scanned.select(*KEY), KEY, "left_anti").select(*cols)
    prefixes = compress_prefixes(unscanned).withColumnRenamed("prefix", "_a")
    below = (old.withColumn("_a", F.explode(ancestors(F.col("path"), include_self=True)))
             .join(prefixes, ["corpus", "_a"], "left_semi").select(*KEY))
    keep = below.unionByName(unreadable.select(*KEY)).distinct()
    state = (scanned.select(*cols).withColumn("preserved", F.lit(False))
             .unionByName(old.join(keep, KEY, "left_semi").withColumn("preserved", F.lit(True))))
    drop = is_hidden(F.col("path")) | (is_ignored(F.col("path"), ignore_rules) if ignore_rules else F.lit(False))
    return state.where(~drop)


def merkle_root(snapshot: DataFrame, hex_digits: int = 4) -> DataFrame:
    """One digest per corpus over paths and hashes.

    Paths are spread over 16^hex_digits buckets by their hash; a bucket digest covers its own
    sorted rows, the root covers the bucket digests in order. No task holds a whole corpus.
    """
    line = F.concat("path", F.lit("\u0000"), "content_hash", F.lit("\n"))
    buckets = (snapshot.groupBy("corpus", F.substring(F.sha2("path", 256), 1, hex_digits).alias("_b"))
               .agg(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))).alias("ls"), F.count(F.lit(1)).alias("n"))
               .select("corpus", "_b", "n", F.sha2(F.array_join(F.transform("ls", lambda x: x["l"]), ""), 256).alias("d")))
    return (buckets.groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct("_b", "d"))).alias("ds"), F.sum("n").alias("files"))
            .select("corpus", "files", F.sha2(F.array_join(F.transform("ds", lambda x: F.concat(x["_b"], F.lit(":"), x["d"], F.lit("\n"))), ""), 256).alias("root")))


def write_gate(delta: DataFrame, state: DataFrame, meta: DataFrame) -> DataFrame:
    """Per corpus: is there anything to store? A diff, a hash taken anew, a change of the partial
    flag, or a moved run counter. ``meta`` has one row per corpus with partial, was_partial,
    counter and was_counter."""
    d = delta.groupBy("corpus").agg(F.count(F.lit(1)).alias("changes"))
    h = state.groupBy("corpus").agg(F.count_if("hashed").alias("hashed"))
    j = meta.join(d, "corpus", "left").join(h, "corpus", "left").na.fill(0, ["changes", "hashed"])
    moved = ~F.col("partial").eqNullSafe(F.col("was_partial")) | ~F.col("counter").eqNullSafe(F.col("was_counter"))
    return j.withColumn("write", (F.col("changes") > 0) | (F.col("hashed") > 0) | moved)


def apply_delta(chunks: DataFrame, delta: DataFrame, files: DataFrame, split) -> DataFrame:
    """Chunk table after a delta: rows of its files go, added and modified files are split again, once.
    Files outside the delta are neither read nor embedded. The delta is read twice: give it as a
    stored table (``session.cut_lineage``)."""
    again = files.join(delta.where("change IN ('added', 'modified')").select(*KEY), KEY, "left_semi")
    return delete_paths(chunks, delta.select(*KEY)).unionByName(split(again), allowMissingColumns=True)


def reindex(chunks: DataFrame, previous: DataFrame | None, current: DataFrame, files: DataFrame, split) -> tuple[DataFrame, DataFrame]:
    """(new chunk table, delta). Without an earlier snapshot every file counts as added."""
    prev = current.limit(0) if previous is None else previous
    delta = snapshot_diff(prev, current)
    return apply_delta(chunks.limit(0) if previous is None else chunks, delta, files, split), delta


def reconcile_rules(manifest: DataFrame, files: DataFrame, old_rules: list[str], new_rules: list[str]) -> DataFrame:
    """(corpus, path, action) after a change of ignore rules: delete, keep or add; newly_ignored
    marks rows the old rules let through."""
    m = manifest.select(*KEY).distinct().withColumn("_m", F.lit(True))
    f = files.select(*KEY).distinct().withColumn("_f", F.lit(True))
    j = m.join(f, KEY, "full_outer")
    new, old = is_ignored(F.col("path"), new_rules), is_ignored(F.col("path"), old_rules)
    action = (F.when(F.col("_m") & new, "delete").when(F.col("_m"), "keep").when(~new & ~is_hidden(F.col("path")), "add"))
    return j.select(*KEY, action.alias("action"), (F.col("_m").isNotNull() & new & ~old).alias("newly_ignored")).where("action IS NOT NULL")


def manifest(chunks: DataFrame) -> DataFrame:
    return chunks.select(*KEY).distinct()


def control_signature(files: DataFrame, corpora: DataFrame, control: list[str] | None = None) -> DataFrame:
    """name:mtime:size, or name:missing, for every control file of a corpus, joined with "|"."""
    names = control or X.CONTROL_FILES
    hit = files.where(F.col("path").isin(names)).groupBy("corpus").agg(*[
        F.max(F.when(F.col("path") == n, F.concat_ws(":", F.lit(n), F.round("mtime").cast("bigint"), "size"))).alias(f"_{i}") for i, n in enumerate(names)])
    sig = F.concat_ws("|", *[F.coalesce(F.col(f"_{i}"), F.lit(f"{n}:missing")) for i, n in enumerate(names)])
    return corpora.select("corpus").distinct().join(hit, "corpus", "left").select("corpus", sig.alias("signature"))


def preflight(index_state: DataFrame, changed: DataFrame, control: list[str] | None = None) -> DataFrame:
    """Is a full rebuild needed? ``index_state`` has corpus, status, allowed (the fingerprint gate)
    and probed (whether changed files could be listed)."""
    c = changed.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("path").isin(control or X.CONTROL_FILES)).alias("only_control"))
    j = index_state.join(c, "corpus", "left")
    ready = F.col("status").isin("indexed", "sync_completed")
    outcome = (F.when((F.col("status") == "requires_reindex") | ~F.col("allowed"), "reindex_required")
               .when(~F.col("probed"), "probe_failed")
               .when(F.col("n").isNull(), "unknown")
               .when(F.col("only_control") & ready, "reindex_unnecessary_ignore_only").otherwise("unknown"))
    return j.select("corpus", outcome.alias("outcome"),
                    F.when(outcome.isin("reindex_required", "reindex_unnecessary_ignore_only"), "high").otherwise("low").alias("confidence"))


def changed_paths(status: DataFrame, line: str = "line", include_untracked: bool = False) -> DataFrame:
    """Changed paths from version-control status lines (two status letters, a blank, the path)."""
    t = F.regexp_replace(line, r"\s+$", "")
    code, rest = F.substring(t, 1, 2), F.regexp_replace(F.substring(t, 4, 1 << 30), r"^\s+|\s+$", "")
    target = F.regexp_replace(F.element_at(F.split(rest, " -> "), -1), r"^\s+|\s+$", "")
    inner = F.substring(target, F.lit(2), F.length(target) - 2)
    plain = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    quoted = target.startswith('"') & target.endswith('"') & (F.length(target) >= 2)
    path = F.regexp_replace(F.replace(F.when(quoted, plain).otherwise(target), F.lit("\\"), F.lit("/")), "^/+", "")
    keep = (F.length(t) >= 4) & (code != "!!") & (F.lit(include_untracked) | (code != "??"))
    others = [c for c in status.columns if c != line]
    return (status.where(keep).select(*others, path.alias("path"))
            .where((F.length("path") > 0) & ~F.col("path").startswith("..")).distinct())


def graph_rebuild_due(changed: DataFrame) -> DataFrame:
    """Per corpus: did a file change that can carry symbols?"""
    exts = [e for _, es, _, sym in X.LANGUAGES if sym for e in es]
    return changed.groupBy("corpus").agg(F.bool_or(F.lower(extension(F.col("path"))).isin(exts)).alias("rebuild"))
