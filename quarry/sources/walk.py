"""Listing folder trees level by level and opening named files.

A round lists all folders of one depth, of all corpora, in parallel, and drops what the rules ignore before it is listed, so a
large dependency folder costs one test. Only names, sizes and times are read; ``read_files`` opens the files that are asked for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F, types as T

from quarry.functions import fixed as X
from quarry.functions.ignore_rules import is_ignored, is_ignored_merged, layered
from quarry.functions.paths import is_hidden
from quarry.session import cut_lineage
from quarry.sources.corpus import discover, root_rules

#: (name, is a folder, size, time in milliseconds) of an entry
Entry = tuple[str, bool, int, int]
#: Rows of a listing, and bytes of contents, that leave a worker at a time; files beyond MOST bytes cannot be a value.
ROWS, BYTES, MOST = 10_000, 16 << 20, (1 << 31) - 1
#: What stands in a name for bytes that are not UTF-8; such entries are left out.
NOT_UTF8 = re.compile("[\ud800-\udfff]")


class Tree(NamedTuple):
    files: DataFrame        # corpus, root, path, size, mtime: what is left of the files after all rules
    unlisted: DataFrame     # corpus, prefix: folders that could not be listed
    rules: DataFrame        # corpus, rules: of the ignore files at the roots, see ``root_rules``


def _local(root: str) -> str | None:
    """The plain path of a local root, None for another file system."""
    return re.sub("^file:/+", "/", root) if root.startswith("file:") or "://" not in root else None


def list_folder(root: str, path: str) -> Iterator[Entry]:
    """Entries of a folder below a root: a local path or a URI that pyarrow knows. Links are neither followed nor listed."""
    local = _local(root)
    if local is None:
        system, base = pafs.FileSystem.from_uri(root)
        for e in system.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/{path}".rstrip("/"))):
            if e.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield e.base_name, e.type == pafs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1_000_000
        return
    with os.scandir(os.path.join(local, path)) as entries:
        for e in entries:
            try:
                if not e.is_symlink() and (e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)):
                    s = e.stat(follow_symlinks=False)
                    yield e.name, e.is_dir(follow_symlinks=False), s.st_size, s.st_mtime_ns // 1_000_000
            except FileNotFoundError:       # gone since it was listed
                continue


def open_file(root: str, path: str) -> bytes:
    local = _local(root)
    if local is None:
        system, base = pafs.FileSystem.from_uri(root)
        with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
            return f.read()
    with open(os.path.join(local, path), "rb") as f:
        return f.read()


def _spread(df: DataFrame) -> DataFrame:
    """One folder or file is little data and much waiting: a fixed number of tasks, whatever the bytes say."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "corpus", "path")


def _listed(folders: DataFrame, lister: Callable[[str, str], Iterator[Entry]]) -> DataFrame:
    """Entries of folders (corpus, root, path): kind is file, folder, or failed for a folder that could not be listed."""
    schema = pa.schema([("corpus", pa.string()), ("root", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])

    def entries(corpus, root, path):
        try:
            for name, folder, size, mtime in lister(root, path):
                if not NOT_UTF8.search(name):
                    yield corpus, root, f"{path}/{name}" if path else name, "folder" if folder else "file", size, mtime
        except OSError:
            yield corpus, root, path, "failed", 0, 0

    def batches(source):
        rows = []
        for batch in source:
            for r in batch.to_pylist():
                for row in entries(r["corpus"], r["root"], r["path"]):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return _spread(folders.select("corpus", "root", "path")).mapInArrow(batches, "corpus string, root string, path string, kind string, size bigint, mtime bigint")


def _whole_folders(rules: list[str]) -> list[str]:
    """Rules for the folders that a rule like ``build/**`` empties, as far as no later rule can bring back something below."""
    last = max((i for i, r in enumerate(rules) if r.startswith("!")), default=-1)
    return [f"/{r.lstrip('/')[:-2]}" for r in rules[last + 1:] if r.endswith("/**") and r.strip("/*")]


def walk(roots: DataFrame, rules: list[str] | None = None, custom_extensions: list[str] | None = None,
         lister: Callable[[str, str], Iterator[Entry]] = list_folder, opener: Callable[[str, str], bytes] = open_file) -> Tree:
    """The trees below the roots (corpus, root), one row per corpus, without ignored and hidden folders.

    The files are those that ``discover`` would keep of a full listing: a folder is passed over when the ordered rules
    (built-in, ``rules``, the corpus's own ignore files) ignore it, since nothing below such a folder can come back, or all that
    may be in it (``build/**``) while the corpus brings nothing back.
    Of contents only those ignore files are read. A folder that cannot be listed is named in ``unlisted``, for
    ``index.sync(unscanned=...)``; a root that cannot be listed is an error, since all its files would seem removed.
    The levels are tables in the shared folder; no roots give no files.
    """
    common = layered(X.DEFAULT_IGNORE_RULES, rules)
    emptied = _whole_folders(common)
    level, own, seen = roots.select("corpus", "root", F.lit("").alias("path")), None, []
    while own is None or not level.isEmpty():
        entries = cut_lineage(_listed(level, lister), f"level{len(seen)}")
        seen.append(entries)
        if own is None:
            lost = [r["corpus"] for r in entries.where("kind = 'failed'").select("corpus").limit(5).collect()]
            if lost:
                raise OSError(f"roots that cannot be listed, among them those of {lost}")
            control = read_files(entries.where((F.col("kind") == "file") & F.col("path").isin(X.CONTROL_FILES)), opener)
            own = cut_lineage(root_rules(control, before=common), "rules")
        folder = F.concat("path", F.lit("/"))
        below = entries.where("kind = 'folder'").where(~is_hidden(F.col("path"))).join(own, "corpus", "left")
        brings_back = F.coalesce(F.exists("rules", lambda r: r["negate"]), F.lit(False))
        pruned = is_ignored_merged(folder, common, F.col("rules")) | (~brings_back & is_ignored(folder, emptied))
        level = cut_lineage(below.where(~pruned).select("corpus", "root", "path"), f"folders{len(seen)}")
    every = reduce(DataFrame.unionByName, seen)
    files = discover(every.where("kind = 'file'").drop("kind"), rules, custom_extensions, own)
    return Tree(files.select("corpus", "root", "path", "size", "mtime"), every.where("kind = 'failed'").select("corpus", F.col("path").alias("prefix")), own)


def read_files(files: DataFrame, opener: Callable[[str, str], bytes] = open_file) -> DataFrame:
    """The files (corpus, root, path and any other columns) with their ``content``.

    Files that cannot be opened any more, or hold 2 GiB or more, are left out: what asked for them finds them missing.
    """
    rows = _spread(files.drop("content"))
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    names = [f.name for f in schema.fields]

    def batches(source):
        for batch in source:
            at, blobs, held = [], [], 0
            places = zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True)
            for i, (root, path) in enumerate(places):
                try:
                    data = opener(root, path)
                except OSError:
                    continue
                if len(data) > MOST:
                    continue
                if at and held + len(data) > BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(blobs, pa.binary())], names=names)
                    at, blobs, held = [], [], 0
                at.append(i)
                blobs.append(data)
                held += len(data)
            if at:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(blobs, pa.binary())], names=names)

    return rows.mapInArrow(batches, schema)


def fetcher(roots: DataFrame, opener: Callable[[str, str], bytes] = open_file) -> Callable[[DataFrame], DataFrame]:
    """For ``index.sync(fetch=...)``: contents of (corpus, path) rows below the roots (corpus, root)."""
    return lambda wanted: read_files(wanted.join(roots.select("corpus", "root"), "corpus"), opener).select("corpus", "path", "content")
