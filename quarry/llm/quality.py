"""Quality rules with cross-document line frequency (operator 8).

Lines are normalised and hashed, the different documents of a host that hold each line are counted,
lines above the limit are removed, and documents that lose too much are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import cut, slices
from quarry.session import explode_once

#: A line is removed where over MIN_TEXTS different texts of its host hold it, however many texts the host has. MAX_SHARE is a
#: further least share of them, none unless asked for: with a share, the limit would grow with the host.
MAX_SHARE, MIN_TEXTS = 0.0, 10
#: A document is depleted when under LEAST_LEFT of its words, or under LEAST_WORDS, are left.
LEAST_LEFT, LEAST_WORDS = 0.5, 10
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    grams = ids[:n]
    for k in range(1, window):      # number the grams of k + 1 words from those of k words
        distinct, grams = np.unique(grams * len(number) + ids[k:k + n], return_inverse=True)
        if len(distinct) == n:
            return 0
    twice = np.bincount(grams)[grams] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[:n] += twice
    cover[window:] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure_text(text: str | None) -> dict[str, int]:
    """The measures of one whole text; null is like an empty text."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    following = len(data) - len(data.translate(None, bytes(range(0x80, 0xC0))))   # bytes of a code point after its first
    return {"n_words": len(words), "word_chars": sum(map(len, words)) - following, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(words)}


def _measured(keyed: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, row_hash) and the measures of each row's text."""
    names = ["doc_id", "host", "text_hash", "row_hash"]
    fields = [f"{n} {keyed.schema[n].dataType.simpleString()}" for n in names] + [f"{n} bigint" for n in MEASURES]

    def run(batches):
        for batch in slices(batches):
            found = [measure_text(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[n] for m in found], pa.int64()) for n in MEASURES)], names=[*names, *MEASURES])
    return keyed.mapInArrow(run, ", ".join(fields))


def _keyed(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Two numbers name a row by its id and its whole text; null hosts are one host."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"),
                       F.xxhash64(t).alias("text_hash"), F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), t).alias("row_hash"))


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def _lines(keyed: DataFrame) -> DataFrame:
    """A row for each different line with a word of each row: its hash and its words, repeats counted."""
    lines = F.filter(F.transform(F.split("text", "\n"), normal_line), lambda x: x != "")
    both = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))
    return explode_once(keyed.select("host", "text_hash", "row_hash", both.alias("both")), F.col("both"), "one").select(
        "host", "text_hash", "row_hash", F.col("one.line").alias("line"), F.col("one.words").alias("words"))


def frequent_lines(keyed: DataFrame, max_share: float, min_texts: int) -> DataFrame:
    """(host, line) of the lines above the limit. Copies of a text count once, so a text is not removed for having copies."""
    held = _lines(keyed).groupBy("host", "line", "text_hash").agg(F.lit(1).alias("_")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    texts = keyed.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    over = held.where(F.col("n") > min_texts)
    return over.join(texts, "host").where(F.col("n") > max_share * F.col("texts")).select("host", "line")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_share: float = MAX_SHARE, min_texts: int = MIN_TEXTS,
          least_left: float = LEAST_LEFT, least_words: int = LEAST_WORDS, often: DataFrame | None = None) -> DataFrame:
    """(doc_id, measures, removed_words, base_failed, kept) for every row.

    ``often``: the result of ``frequent_lines`` where it is at hand.

    Null and empty texts have no words and fail the base; rows with null ids or hosts are judged like
    others; repeated rows are answered each; empty tables give no rows. Other columns are not read.
    """
    keyed = _keyed(docs, doc_id, text, host)
    often = frequent_lines(keyed, max_share, min_texts) if often is None else often
    lost = (_lines(keyed).join(often, ["host", "line"]).groupBy("row_hash", "text_hash", "host")
            .agg(F.sum("words").alias("lost"), F.count(F.lit(1)).alias("_lines")))
    rows = _measured(keyed)
    # rows that agree in id, text and host hold the same lines: their lost words were summed together
    same = rows.groupBy("row_hash", "text_hash", "host", "doc_id", *MEASURES).agg(F.count(F.lit(1)).alias("copies"))
    left = same.join(lost, ["row_hash", "text_hash", "host"], "left").withColumn("removed_words", (F.coalesce("lost", F.lit(0)) / F.col("copies")).cast("long"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    depleted = (rest < least_left * F.col("n_words")) | (rest < least_words)
    judged = left.withColumn("base_failed", base).withColumn("kept", ~base & ~depleted)
    return explode_once(judged, F.sequence(F.lit(1), F.col("copies")), "_copy").select(
        "doc_id", "host", "text_hash", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept rows, all their columns, with the lines above the limit taken out of the text.

    The other lines stay as they are. ``limits`` are those of ``judge``.
    """
    share, least = limits.get("max_share", MAX_SHARE), limits.get("min_texts", MIN_TEXTS)
    keyed = _keyed(docs, doc_id, text, host)
    often = cut(frequent_lines(keyed, share, least), "frequent-lines")      # used twice, and far smaller than the text
    kept = judge(docs, doc_id, text, host, often=often, **limits).where("kept").select("row_hash", "text_hash", "host", "removed_words").distinct()
    gone = _lines(keyed).join(often, ["host", "line"]).groupBy("row_hash", "text_hash", "host").agg(F.collect_set("line").alias("__gone"))
    verdict = kept.join(gone, ["row_hash", "text_hash", "host"], "left").select(
        F.col("row_hash").alias("__row"), F.col("text_hash").alias("__text"), F.col("host").alias("__host"), "__gone")
    t = F.coalesce(F.col(text), F.lit(""))
    mark = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), t)).withColumn("__text", F.xxhash64(t)).withColumn(
        "__host", F.coalesce(F.col(host).cast("string"), F.lit("\x00")))
    rest = F.array_join(F.filter(F.split(t, "\n"), lambda x: ~F.array_contains(F.col("__gone"), F.xxhash64(normal_line(x)))), "\n")
    return (mark.join(verdict, ["__row", "__text", "__host"]).withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest))
            .select(*docs.columns))
