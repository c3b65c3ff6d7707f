"""Splitting files into chunks. A file is one row, so nothing here shuffles.

A splitter is a function from a file table to a chunk table; use it with ``df.transform``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import fixed as X
from quarry.functions.paths import extension, language_of
from quarry.session import explode_once
from quarry.functions.text import chunk_id, line_count, symbol_id, trim_ws

# --- fixed values: declaration headers by language -------------------------------------------
ARROW = r"^\s*(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][A-Za-z0-9_$]*\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][A-Za-z0-9_$]*)\s*(?::[^=]+)?=>"
METHOD = (r"^\s+(?:(?:public|private|protected|static|override|readonly|async|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return|with|new)[^A-Za-z0-9_$])"
          r"[#A-Za-z_$][A-Za-z0-9_$]*\s*\([^;]*\)\s*(?::[^{;]+)?\{\s*$")
MEMBER = (r"^\s+(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized)\s+)+(?:[A-Za-z_][A-Za-z0-9_<>\[\],.?]*\s+)?"
          r"[A-Za-z_][A-Za-z0-9_]*\s*\([^;]*\)\s*(?:throws\s+[A-Za-z0-9_,.\s]+)?\{?\s*$")
DECLARATIONS = {
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function|interface|type|enum)\s+[A-Za-z_$]|" + ARROW + "|" + METHOD,
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class|function)\s+[A-Za-z_$]|" + ARROW + "|" + METHOD,
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+[A-Za-z_]",
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum)\s+[A-Za-z_]|" + MEMBER,
    "csharp": r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract)\s+)*(?:class|interface|struct|enum)\s+[A-Za-z_]|" + MEMBER,
    "cpp": r"^\s*(?:class|struct|namespace|enum)\s+[A-Za-z_]",
    "go": r"^\s*(?:func|type)\s+[A-Za-z_(]",
    "rust": r"^\s*(?:pub\s+)?(?:fn|struct|enum|trait|impl|mod)\s+[A-Za-z_<]",
    "scala": r"^\s*(?:case\s+)?(?:class|object|trait|def)\s+[A-Za-z_]",
}


def _pack(lens: Column, size: int) -> Column:
    """Zero-based first units of greedily filled windows; a unit alone may exceed the size. The running length
    grows as text and each start is added once, to a string, so long files do not copy an array at each window."""
    init = F.struct(F.lit(0).alias("len"), F.lit(0).alias("i"), F.lit("0").alias("starts"))

    def step(acc, n):
        full = (acc["len"] > 0) & (acc["len"] + n > size)
        return F.struct(F.when(full, n).otherwise(acc["len"] + n).alias("len"), (acc["i"] + 1).alias("i"),
                        F.when(full, F.concat_ws(",", acc["starts"], acc["i"].cast("string"))).otherwise(acc["starts"]).alias("starts"))

    return F.transform(F.split(F.aggregate(lens, init, step, lambda acc: acc["starts"]), ","), lambda x: x.cast("int"))


def _ends(starts: Column, n: Column) -> Column:
    """Exclusive ends of windows given their starts and the number of units."""
    return F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))


def with_language(files: DataFrame) -> DataFrame:
    return files if "language" in files.columns else files.withColumn("language", language_of(extension(F.col("path"))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(lines: Column, size: int) -> Column:
    """Lines, with their line ends and numbers from 0, cut at the size where they are longer."""
    def cut_line(lines, line, i):
        full = F.when(i < F.size(lines) - 1, F.concat(line, F.lit("\n"))).otherwise(line)
        k = F.greatest(F.lit(0), F.ceil(F.length(full) / F.lit(size)).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), k), lambda j: F.struct(F.substring(full, j * size + 1, F.lit(size)).alias("t"), i.alias("line")))

    return _let(lines, lambda ls: F.flatten(F.transform(ls, lambda line, i: cut_line(ls, line, i))))


def _tails(spans: Column, overlap: int) -> Column:
    """The spans of one file, each with the last characters of the one before."""
    def with_tail(span, i):
        before = F.get(spans, i - 1)["content"]
        return F.struct(span.alias("c"), F.substring(before, F.greatest(F.length(before) - overlap + 1, F.lit(1)), F.lit(overlap)).alias("overlap_text"))

    return F.transform(spans, with_tail)


def chunk_windows(files: DataFrame, size: int = 2500, overlap: int = 0, text: str = "content") -> DataFrame:
    """Size-bounded windows of whole lines, with line spans; a longer line is cut at the size.

    Adds chunk_no, start_line, end_line, content and, with an overlap, overlap_text.
    """
    d = with_language(files).withColumn("_u", _pieces(F.split(F.col(text), "\n", -1), size))
    d = d.withColumn("_s", _pack(F.transform("_u", lambda u: F.length(u["t"])), size))
    d = d.withColumn("_e", _ends(F.col("_s"), F.size("_u")))
    at = F.transform(F.arrays_zip("_s", "_e"), lambda p, n: F.struct(p["_s"].alias("s"), p["_e"].alias("e"), n.alias("n")))
    spans = F.filter(F.transform(at, lambda p: F.struct(
        p["n"].alias("chunk_no"), F.array_join(F.transform(F.slice("_u", p["s"] + 1, p["e"] - p["s"]), lambda u: u["t"]), "").alias("content"),
        (F.get("_u", p["s"])["line"] + 1).alias("start_line"), (F.get("_u", p["e"] - 1)["line"] + 1).alias("end_line"))),
        lambda c: trim_ws(c["content"]) != "")
    keep = [c for c in d.columns if c not in ("_u", "_s", "_e", text, "content")]
    cols = [*keep, "c.chunk_no", "c.start_line", "c.end_line", "c.content"]
    if not overlap:
        return explode_once(d, spans, "c").select(*cols)
    d = d.withColumn("_spans", spans)
    return _embed_text(explode_once(d, _tails(F.col("_spans"), overlap), "x").withColumn("c", F.col("x.c")).select(*cols, "x.overlap_text"))


def _declarations(lines: Column, language: Column) -> Column:
    """Spans of declarations as an array: chunk_no, content, start_line, end_line, header (null for lines before the first)."""
    pattern = F.element_at(F.create_map(*[F.lit(x) for kv in DECLARATIONS.items() for x in kv]), language)
    heads = F.coalesce(F.filter(F.transform(lines, lambda ln, i: F.when(F.rlike(ln, pattern), i)), lambda i: i.isNotNull()), F.array().cast("array<int>"))

    def spans(starts):
        at = F.transform(starts, lambda s, n: F.struct(s.alias("s"), F.coalesce(F.get(starts, n + 1), F.size(lines)).alias("e"), n.alias("n")))
        return F.transform(at, lambda p: F.struct(
            p["n"].alias("chunk_no"), F.array_join(F.slice(lines, p["s"] + 1, p["e"] - p["s"]), "\n").alias("content"), (p["s"] + 1).alias("start_line"), p["e"].alias("end_line"),
            F.when((p["n"] > 0) | F.rlike(F.get(lines, F.lit(0)), pattern), F.get(lines, p["s"])).alias("header")))

    return F.filter(_let(F.array_distinct(F.concat(F.array(F.lit(0)), heads)), spans), lambda c: trim_ws(c["content"]) != "")


def chunk_declarations(files: DataFrame, text: str = "content") -> DataFrame:
    """One chunk per declaration header up to the next one; the lines before the first are a chunk
    of their own, and a text without declarations is one chunk."""
    d = with_language(files).withColumn("_lines", F.split(F.col(text), "\n", -1))
    keep = [c for c in d.columns if c not in ("_lines", text, "content")]
    out = explode_once(d, _declarations(F.col("_lines"), F.col("language")), "c").select(*keep, "c.*")
    return out.withColumn("symbol_label", symbol_label(F.col("language"), F.col("header")))


def symbol_label(language: Column, header: Column) -> Column:
    """Label of a declaration header for the languages with symbols; null for the others."""
    h = trim_ws(F.regexp_replace(header, r"\s+", " "))
    py = F.regexp_replace(h, r"\s*:$", "")
    py = (F.when(py.rlike("^class "), py)
          .when(py.rlike("^async def "), F.concat(F.lit("async function "), F.regexp_replace(py, "^async def ", "")))
          .when(py.rlike("^def "), F.concat(F.lit("function "), F.regexp_replace(py, "^def ", ""))))
    js = F.regexp_replace(h, r"^(?:export )?(?:default )?(?:abstract )?", "")
    func = F.regexp_extract(js, r"^(async )?function ([A-Za-z_$][A-Za-z0-9_$]*)? ?(\([^)]*\))?", 0)
    params = F.regexp_extract(js, r"^(?:async )?function [A-Za-z0-9_$]* ?(\([^)]*\))", 1)
    name = F.regexp_extract(js, r"^(?:async )?function ([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    kind = F.regexp_extract(js, r"^(class|interface|type) ", 1)
    kname = F.regexp_extract(js, r"^(?:class|interface|type) ([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    method = F.regexp_extract(js, r"^(?:(?:public|private|protected|static|async) )*([A-Za-z_$][A-Za-z0-9_$]*) ?\([^)]*\) ?(?::[^{]*)?\{", 1)
    margs = F.regexp_extract(js, r"^[^(]*(\([^)]*\))", 1)
    js_label = (
        F.when(func != "", F.concat(F.when(js.startswith("async "), "async ").otherwise(""), F.lit("function "),
                                    F.when(name == "", "<anonymous>").otherwise(name), params))
        .when(kind != "", F.concat(kind, F.lit(" "), F.when(kname == "", "<anonymous>").otherwise(kname)))
        .when(method != "", F.concat(F.when(js.rlike(r"(?:^| )async "), "async ").otherwise(""), F.lit("method "), method, margs)))
    return F.when(language == "python", py).when(language.isin("typescript", "javascript"), js_label)


def _parts(content: Column, start: Column, end: Column, size: int) -> Column:
    """The parts of a chunk: part, content, start_line, end_line. A chunk within the size is one part, as it is; a larger
    one is cut at line ends, lines above the size inside, and its parts are trimmed."""
    def windows(u, starts):
        at = F.transform(starts, lambda s, n: F.struct(s.alias("s"), F.coalesce(F.get(starts, n + 1), F.size(u)).alias("e"), n.alias("n")))
        cut_parts = F.transform(at, lambda p: F.struct(
            p["n"].alias("part"), trim_ws(F.array_join(F.transform(F.slice(u, p["s"] + 1, p["e"] - p["s"]), lambda x: x["t"]), "")).alias("content"),
            (start + F.get(u, p["s"])["line"]).cast("int").alias("start_line"), (start + F.get(u, p["e"] - 1)["line"]).cast("int").alias("end_line")))
        return F.filter(cut_parts, lambda p: (p["content"] != "") | (p["part"] < F.size(starts) - 1))

    large = _let(_pieces(F.split(content, "\n", -1), size), lambda u: _let(_pack(F.transform(u, lambda x: F.length(x["t"])), size), lambda starts: windows(u, starts)))
    whole = F.array(F.struct(F.lit(0).alias("part"), content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line")))
    return F.when(F.length(content) > size, large).otherwise(whole)


def split_large(chunks: DataFrame, size: int = 2500) -> DataFrame:
    """Chunks above the size are cut again on whole lines and trimmed; a longer line is cut at the size. Symbol
    columns stay, line ranges are derived anew. Smaller chunks pass through. Adds part."""
    keep = [c for c in chunks.columns if c not in ("content", "start_line", "end_line")]
    return explode_once(chunks, _parts(F.col("content"), F.col("start_line"), F.col("end_line"), size), "p").select(*keep, "p.*")


def _embed_text(chunks: DataFrame) -> DataFrame:
    """overlap_start, the first line of the overlap, and embed_text, what a model is given."""
    return (chunks.withColumn("overlap_start", F.when(F.col("overlap_text").isNull(), F.col("start_line")).otherwise(
                F.greatest(F.lit(1), F.col("start_line") - line_count(F.col("overlap_text")))))
            .withColumn("embed_text", F.concat_ws("\n", "overlap_text", "content")))


def add_overlap(chunks: DataFrame, overlap: int, order: list[str] = ["chunk_no"], by: list[str] = ["corpus", "path"]) -> DataFrame:
    """overlap_text: the last characters of the chunk before, within one file. The chunk's own span stays as it is, so that
    symbol ids and spans keep pointing at the declaration. For chunks of a splitter of one's own: it shuffles the
    text, which ``chunk_windows`` and ``split_code`` do not, as they add the overlap inside a file's row."""
    prev = F.lag("content").over(W.partitionBy(*by).orderBy(*order))
    return _embed_text(chunks.withColumn("overlap_text", F.substring(prev, F.greatest(F.length(prev) - overlap + 1, F.lit(1)), F.lit(overlap))))


def finish_chunks(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id and symbol_id to split chunks."""
    c = chunks if "symbol_label" in chunks.columns else chunks.withColumn("symbol_label", F.lit(None).cast("string"))
    span = (F.col("path"), F.col("start_line"), F.col("end_line"))
    return c.withColumn("chunk_id", chunk_id(*span, F.col("content"))).withColumn("symbol_id", symbol_id(*span, F.col("symbol_label")))


def split_code(files: DataFrame, size: int = 2500, overlap: int = 300, text: str = "content") -> DataFrame:
    """The default splitter: declarations, large ones cut again, ids, overlap text. All of it inside a file's row, so nothing is shuffled."""
    d = with_language(files).withColumn("_lines", F.split(F.col(text), "\n", -1))
    keep = [c for c in d.columns if c not in ("_lines", text, "content")]
    spans = F.transform(_declarations(F.col("_lines"), F.col("language")), lambda c: F.struct(
        c["chunk_no"].alias("chunk_no"), symbol_label(F.col("language"), c["header"]).alias("symbol_label"), c["content"].alias("whole"),
        c["start_line"].alias("from_line"), c["end_line"].alias("to_line"), _parts(c["content"], c["start_line"], c["end_line"], size).alias("parts")))
    d = d.withColumn("_decl", spans)
    flat = F.flatten(F.transform("_decl", lambda c: F.transform(c["parts"], lambda p: F.struct(
        c["chunk_no"].alias("chunk_no"), c["symbol_label"].alias("symbol_label"), c["from_line"].alias("from_line"), c["to_line"].alias("to_line"),
        chunk_id(F.col("path"), c["from_line"], c["to_line"], c["whole"]).alias("chunk_id"), p["part"].alias("part"), p["content"].alias("content"),
        p["start_line"].alias("start_line"), p["end_line"].alias("end_line")))))
    d = d.withColumn("_flat", flat)
    x = explode_once(d, _tails(F.col("_flat"), overlap), "x")
    out = x.withColumn("c", F.col("x.c")).select(*keep, "c.chunk_no", "c.part", "c.symbol_label", "c.chunk_id", "c.content", "c.start_line", "c.end_line",
        symbol_id(F.col("path"), F.col("c.from_line"), F.col("c.to_line"), F.col("c.symbol_label")).alias("symbol_id"), "x.overlap_text")
    return _embed_text(out)
