"""Splitting by nested declarations, with the chain of scopes that a chunk lies in.

A file is one row: a small Arrow UDF gives the lines of its declarations, everything else is columns; nothing shuffles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.outline import outline
from quarry.functions.text import breadcrumbs, chunk_id, symbol_id, trim_ws
from quarry.operators import chunking as C
from quarry.session import explode_once

_SPANS = "array<struct<start_line: int, end_line: int, headers: array<string>>>"


def declarations(content: Column, language: Column) -> Column:
    """Spans of a file's declarations, see ``functions.outline.outline``."""
    def run(code: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([[{"start_line": a, "end_line": b, "headers": h} for a, b, h in outline(c, x)] for c, x in zip(code, lang, strict=True)], dtype=object)
    return F.pandas_udf(run, _SPANS)(content, language)


def structure_chunks(files: DataFrame, text: str = "content") -> DataFrame:
    """A chunk per declaration, nested ones too, and per range of lines outside of all; blank ranges are left out.

    Adds chunk_no, start_line, end_line, content, header, symbol_label, and breadcrumbs: the labels of at most two scopes, its own last;
    null where there is none.
    """
    d = C.with_language(files)
    d = d.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).withColumn("_spans", declarations(F.col(text), F.col("language")))
    keep = [c for c in d.columns if c not in ("_lines", "_spans", text, "content")]
    lines = lambda s: F.array_join(F.slice("_lines", s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")
    rows = F.filter(F.transform("_spans", lambda s: F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["headers"].alias("headers"), lines(s).alias("content"))),
                    lambda s: trim_ws(s["content"]) != "")
    x = explode_once(d.withColumn("_rows", rows), F.col("_rows"), "c", "chunk_no").select(*keep, "chunk_no", "c.*")
    x = x.withColumn("header", F.try_element_at("headers", F.lit(-1))).withColumn("symbol_label", C.symbol_label(F.col("language"), F.col("header")))
    labels = F.filter(F.transform("headers", lambda h: C.symbol_label(F.col("language"), h)), lambda s: s.isNotNull())
    return x.withColumn("breadcrumbs", breadcrumbs(labels)).drop("headers")


def split_structured(files: DataFrame, size: int = 2500, text: str = "content") -> DataFrame:
    """``structure_chunks`` with large chunks cut again and with ids; parts keep their declaration's labels and symbol id."""
    c = structure_chunks(files, text)
    c = c.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")))
    c = c.withColumn("symbol_id", symbol_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol_label")))
    return C.split_large(c, size).withColumn("embed_text", F.concat_ws("\n", F.array_join("breadcrumbs", " > "), F.col("content")))
