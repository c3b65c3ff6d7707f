"""Symbol graph: nodes, call and import edges, notes, bounded traversal, span lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import fixed as X
from quarry.functions.ignore_rules import is_ignored
from quarry.functions.paths import extension, graph_capable, normalize_path
from quarry.functions.text import trim_ws
from quarry.operators.scoring import blank_last
from quarry.session import cut_lineage, explode_once

# --- fixed values: names and calls ------------------------------------------------------------
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# a whole name is taken without going back (what follows one is no part of it), and a member call's object from its first letter
DIRECT_CALL = rf"{WORD_EDGE}({NAME}+)\s*+\("
MEMBER_CALL = rf"(?<![A-Za-z_$]){NAME}+\.({NAME}+)\s*+\("
PY_IMPORT = r"^\s*from\s+[^\s]+\s+import\s+(.+)$"
JS_IMPORT = r"^\s*import\s+(.+)\s+from\s+['\x22][^'\x22]+['\x22]"
NAMED_LABELS = [rf"(?i)^(?:async\s+)?method\s+({NAME})\s*\(", rf"(?i)^(?:async\s+)?function\s+({NAME})\s*\(", rf"(?i)^class\s+({NAME})"]
LINE_COMMENT = {"python": "#.*$"}
OTHER_COMMENT = "//.*$"
# folders that no graph is built from, whatever the rules say
GRAPH_IGNORED = ["**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.next/**"]


# --- nodes ------------------------------------------------------------------------------------
def symbol_nodes(chunks: DataFrame) -> DataFrame:
    """(corpus, symbol_id, symbol_label, file, language, start_line, end_line): one row per symbol."""
    where = F.struct("path", "start_line", "chunk_id")
    label = F.nullif(F.col("symbol_label"), F.lit(""))
    return (chunks.where("symbol_id IS NOT NULL").groupBy("corpus", "symbol_id").agg(
        F.min_by(label, F.when(label.isNotNull(), where)).alias("symbol_label"), F.min_by("path", where).alias("file"),
        F.min_by("language", where).alias("language"), F.min(F.greatest(F.lit(1), F.col("start_line"))).alias("start_line"),
        F.max(F.greatest(F.lit(1), F.col("start_line"), F.col("end_line"))).alias("end_line")))


def missing_symbol_notes(chunks: DataFrame) -> DataFrame:
    return chunks.where("symbol_id IS NULL").select(
        "corpus", F.lit("missing_symbol_metadata").alias("type"), F.col("path").alias("file"), F.col("start_line").alias("line"),
        F.lit(None).cast("string").alias("symbol_id"),
        F.concat(F.lit("no symbol for "), "path", F.lit(":"), "start_line", F.lit("-"), "end_line").alias("detail")).distinct()


def symbol_index(nodes: DataFrame) -> DataFrame:
    """Nodes by the lower-cased name of a method, function or class."""
    label = trim_ws(F.col("symbol_label"))
    found = [F.regexp_extract(label, pattern, 1) for pattern in NAMED_LABELS]
    names = F.array_distinct(F.filter(F.transform(F.array(*found), F.lower), lambda n: n != ""))
    return nodes.withColumn("name", F.explode(names))


# --- sites ------------------------------------------------------------------------------------
def call_sites(line: Column) -> Column:
    """ARRAY<STRUCT<name, kind>> of one source line: a member call is both dynamic and a call.

    Plain substring tests come before the patterns, since most lines have no call at all.
    """
    none = F.array().cast("array<struct<name:string,kind:string>>")
    own = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.lower))
    as_kind = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    direct = own(DIRECT_CALL)
    member = F.when(line.contains("."), as_kind(own(MEMBER_CALL), "dynamic")).otherwise(none)
    getattr_ = F.when(line.contains("getattr") & line.rlike(r"(?:^|[^A-Za-z0-9_])getattr\s*\("),
                      F.array(F.struct(F.lit("getattr").alias("name"), F.lit("dynamic").alias("kind")))).otherwise(none)
    return F.when(line.contains("("), F.array_distinct(F.concat(member, as_kind(direct, "call"), getattr_))).otherwise(none)


def defined_names(line: Column) -> tuple[Column, Column]:
    """Names that a line defines, lower-cased, with all that stands beside them of letters, digits, ``_`` and ``$``: those after a
    keyword, and those whose brackets are followed by a body. Each is looked ahead for, so that one may lie in another's brackets."""
    named = F.regexp_extract_all(line, F.lit(r"(?i)(?:^|[^A-Za-z0-9_])(?:function|class|def)(?=\s+([A-Za-z0-9_$]+))"), F.lit(1))
    body = F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z0-9_$])([A-Za-z0-9_$]++)(?=\s*\([^)]*\)\s*(?:=>|\{))"), F.lit(1))
    return F.transform(named, F.lower), F.transform(body, F.lower)


def is_defined(name: Column, named: Column, body: Column) -> Column:
    """``$`` ends a name as any other sign does."""
    return (F.exists(named, lambda x: (x == name) | x.startswith(F.concat(name, F.lit("$"))))
            | F.exists(body, lambda x: (x == name) | x.endswith(F.concat(F.lit("$"), name))))


def import_names(line: Column, language: Column) -> Column:
    py = F.regexp_extract(line, PY_IMPORT, 1)
    py_names = F.transform(F.split(py, ","), lambda t: F.lower(trim_ws(F.get(F.split(trim_ws(t), r"(?i)\s+as\s+"), 0))))
    js = F.regexp_replace(F.regexp_extract(line, JS_IMPORT, 1), r"[{}*]", " ")
    js_names = F.filter(F.transform(F.split(js, r"[\s,]+"), F.lower), lambda n: n != "as")
    return F.array_distinct(F.filter(F.when(language == "python", py_names).otherwise(js_names), lambda n: n != ""))


def source_lines(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Lines inside function, method and class nodes, tail comments stripped. A line belongs to
    every node around it. The spans of a file are one array next to its text, which is split once."""
    label = F.lower(F.col("symbol_label"))
    scan = nodes.where(label.contains("function ") | label.contains("method ") | label.startswith("class "))
    spans = scan.groupBy("corpus", "file").agg(F.collect_list(F.struct("symbol_id", "language", "start_line", "end_line")).alias("spans"))
    j = spans.join(files.select("corpus", F.col("path").alias("file"), "content"), ["corpus", "file"])
    ex = explode_once(j, F.split("content", "\r?\n", -1), "raw", "_i").select("corpus", "file", "spans", "raw", (F.col("_i") + 1).alias("line")).where(trim_ws(F.col("raw")) != "")
    around = F.filter("spans", lambda x: (x["start_line"] <= F.col("line")) & (F.col("line") <= x["end_line"]))
    one = explode_once(ex.select("corpus", "file", "line", "raw", around.alias("_around")), F.col("_around"), "n")
    text = F.regexp_replace("raw", OTHER_COMMENT, "")
    for language, pattern in LINE_COMMENT.items():
        text = F.when(F.col("n.language") == language, F.regexp_replace("raw", pattern, "")).otherwise(text)
    return one.select("corpus", "n.symbol_id", "file", "n.language", "line", text.alias("text")).where(trim_ws(F.col("text")) != "")


def extract_sites(lines: DataFrame, calls: bool = True, imports: bool = True) -> DataFrame:
    """(corpus, src, file, line, name, kind): calls without keywords and definitions, and imported
    names, from one pass over the lines."""
    t = F.col("text")
    found = []
    if calls:
        # only a line with a keyword or a body can define something: looked for once per line, and tested before a site is a row
        may_define = t.rlike(r"(?i)(?:function|class|def)\s|=>|\{")
        none = F.array().cast("array<string>")
        named, body = (F.when(may_define, x).otherwise(none) for x in defined_names(t))
        lines = lines.withColumn("_named", named).withColumn("_body", body)
        found.append(F.filter(call_sites(t), lambda s: ~s["name"].isin(X.CALL_KEYWORDS) & ~is_defined(s["name"], F.col("_named"), F.col("_body"))))
    if imports:
        names = F.when(t.contains("import"), import_names(t, F.col("language"))).otherwise(F.array().cast("array<string>"))
        found.append(F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("import").alias("kind"))))
    sites = explode_once(lines, F.concat(*found), "s")
    return sites.select("corpus", F.col("symbol_id").alias("src"), "file", "line", "s.name", "s.kind")


def extract_calls(lines: DataFrame) -> DataFrame:
    return extract_sites(lines, imports=False)


def extract_imports(lines: DataFrame) -> DataFrame:
    return extract_sites(lines, calls=False)


# --- edges ------------------------------------------------------------------------------------
def _nearest(asked: DataFrame, cands: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate whose start line is nearest to each asked line, ties by the candidate struct.

    Candidates are one per (keys, start_line) and asked lines are distinct, so a group is never
    longer than a file has lines, however often a name is called; both neighbours come from
    running windows and no pairs are formed.
    """
    q = asked.select(*keys, F.col("line").alias("pos"), F.lit(True).alias("asks"), F.lit(None).cast(cands.schema["cand"].dataType).alias("cand"))
    c = cands.select(*keys, F.col("start_line").alias("pos"), F.lit(False).alias("asks"), "cand")
    rows = q.unionByName(c)
    up = W.partitionBy(*keys).orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(*keys).orderBy(F.desc("pos")).rangeBetween(W.unboundedPreceding, W.currentRow)
    r = rows.withColumn("_a", F.last("cand", ignorenulls=True).over(up)).withColumn("_b", F.last("cand", ignorenulls=True).over(down)).where("asks")
    near = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(f"{x}.start_line") - F.col("pos")).alias("dist"), F.col(x).alias("cand")))
    best = F.array_min(F.array_compact(F.array(near("_a"), near("_b"))))
    return r.select(*keys, F.col("pos").alias("line"), best["cand"].alias("cand")).where("cand IS NOT NULL")


def resolve(sites: DataFrame, nodes: DataFrame, salts: int = 16) -> DataFrame:
    """Sites with dst and dst_file: the nearest node of that name, in the same file if there is one."""
    idx = symbol_index(nodes)
    cand = F.struct("file", "start_line", "symbol_label", "symbol_id")
    own, anywhere = ["corpus", "name", "file"], ["corpus", "name"]
    # most called names have no node at all: only lines that ask for one go through the windows
    to_ask = lambda cands, keys: sites.join(cands.select(*keys).distinct(), keys, "left_semi").select(*keys, "line").distinct()
    here = idx.groupBy(*own, "start_line").agg(F.min(cand).alias("cand"))
    local = _nearest(to_ask(here, own), here, own).withColumnRenamed("cand", "_l")
    s = sites.join(local, [*own, "line"], "left")
    all_ = idx.groupBy(*anywhere, "start_line").agg(F.min(cand).alias("cand"))
    far = _nearest(to_ask(all_, anywhere), all_, anywhere).withColumnRenamed("cand", "_g")
    far = far.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    s = s.withColumn("_s", F.pmod(F.xxhash64("file", "src"), F.lit(salts)).cast("int")).join(far, ["corpus", "name", "line", "_s"], "left")
    t = F.coalesce("_l", "_g")
    return s.select("corpus", "src", "file", "line", "name", "kind", t["symbol_id"].alias("dst"), t["file"].alias("dst_file"))


def edges(resolved: DataFrame) -> DataFrame:
    """(corpus, src, dst, kind, file, line, confidence), one per source, target, kind and place."""
    same = F.col("dst_file") == F.col("file")
    conf = F.lit(None).cast("double")
    for kind, (near, far) in X.CONFIDENCE.items():
        conf = F.when(F.col("kind") == kind, F.when(same, near).otherwise(far)).otherwise(conf)
    return (resolved.where("dst IS NOT NULL").withColumn("confidence", conf)
            .groupBy("corpus", "src", "dst", "kind", "file", "line").agg(F.max("confidence").alias("confidence")))


def unresolved_notes(resolved: DataFrame) -> DataFrame:
    """Call sites without a target, each once."""
    kind = F.when(F.col("kind") == "dynamic", "dynamic_edge").otherwise("unresolved_edge")
    return (resolved.where("dst IS NULL AND kind <> 'import'").select("corpus", kind.alias("type"), "file", "line", F.col("src").alias("symbol_id"),
            F.concat(F.lit("could not resolve "), "name", F.lit("() from "), "src").alias("detail")).distinct())


def note_order() -> list[Column]:
    return [F.col("file"), F.col("type"), blank_last("symbol_id"), F.col("line").asc_nulls_last(), F.sha1("detail")]


def build_graph(chunks: DataFrame, files: DataFrame, ignore_rules: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, notes) of the graph-capable files of all corpora, without folders of built or
    foreign code and without what ``ignore_rules`` name. Nodes, sites and their targets are written to the shared
    folder: they are read several times and far smaller than the text they come from."""
    chunks, files = in_graph(chunks, ignore_rules=ignore_rules), in_graph(files, ignore_rules=ignore_rules)
    nodes = cut_lineage(symbol_nodes(chunks), "nodes")
    lines = source_lines(nodes, files)
    sites = cut_lineage(extract_sites(lines), "sites")
    found = cut_lineage(resolve(sites, nodes), "resolved")
    return nodes, edges(found), unresolved_notes(found).unionByName(missing_symbol_notes(chunks))


# --- traversal --------------------------------------------------------------------------------
def traverse(seeds: DataFrame, edge_table: DataFrame, max_depth: int = X.TRAVERSE_MAX_DEPTH) -> DataFrame:
    """Breadth-first walk for a table of seeds (seed_id, corpus, symbol_id, direction, depth, edge_limit).

    Gives seed_id, corpus, visited (node ids) and selected (edges in the order they were found).
    ``seed_id`` is unique in a corpus; any positive ``edge_limit`` holds. Edges are numbered in their order, and the walk
    carries numbers; the state of a seed is one row of arrays as long as its own limit, which travels once a level, beside its
    asked symbols. Of a symbol's edges only the first ``edge_limit`` can matter. An edge lies in at most two of the lists that a
    level asks for, so when the lists of the first symbols hold twice the limit, the others cannot add an edge and are not fetched.
    """
    asked = seeds.agg(F.max("edge_limit")).first()[0]
    most = max(1, asked or 1)
    fields = ["src", "dst", "kind", "line", "file"]
    numbered = cut_lineage(edge_table.select("corpus", *fields).distinct().orderBy("corpus", *fields).withColumn("edge", F.monotonically_increasing_id()), "edges")
    both = numbered.select("corpus", "edge", F.explode(F.array(
        F.struct(F.col("src").alias("sym"), F.lit(0).alias("dir"), F.col("dst").alias("peer")),
        F.struct(F.col("dst").alias("sym"), F.lit(1).alias("dir"), F.col("src").alias("peer")))).alias("a")).select("corpus", "edge", "a.*")
    held = lambda d: F.least(F.count_if(F.col("dir") == d), F.lit(most)).cast("int")
    degree = both.groupBy("corpus", F.col("sym").alias("id")).agg(held(0).alias("out"), held(1).alias("into"))
    # a node is its id with the lengths of its two lists, so a seed knows what its frontier holds before it asks
    node = F.struct("id", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("into", F.lit(0)).alias("into"))
    top = F.row_number().over(W.partitionBy("corpus", "sym", "dir").orderBy("edge"))
    adj = (both.withColumn("_n", top).where(F.col("_n") <= most).withColumnRenamed("peer", "id").join(degree, ["corpus", "id"])
           .groupBy("corpus", "sym", "dir").agg(F.array_sort(F.collect_list(F.struct("edge", node.alias("peer")))).alias("list")))
    n = 4 * seeds.sparkSession.sparkContext.defaultParallelism      # by number: the rows are few and their work is much, so sizes would put them in one task
    st = seeds.withColumnRenamed("symbol_id", "id").join(degree, ["corpus", "id"], "left").select(
        "seed_id", "corpus", "direction", F.least(F.greatest(F.col("depth"), F.lit(1)), F.lit(max_depth)).alias("depth"),
        F.greatest(F.col("edge_limit"), F.lit(1)).alias("lim"), F.array(node).alias("visited"), F.array(node).alias("frontier"),
        F.array().cast("array<bigint>").alias("selected")).repartition(n, "seed_id", "corpus")
    dirs = F.when(F.col("direction") == "callees", F.array(F.lit(0))).when(F.col("direction") == "callers", F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    for level in range(1, max_depth + 1):
        lists = F.filter(F.flatten(F.transform("frontier", lambda x, i: F.transform(dirs, lambda d: F.struct(
            i.alias("pos"), d.alias("dir"), x["id"].alias("sym"), F.least(F.when(d == 0, x["out"]).otherwise(x["into"]), F.col("lim")).alias("n"))))), lambda a: a["n"] > 0)
        live = (F.lit(level) <= F.col("depth")) & (F.size("selected") < F.col("lim"))
        s = st.withColumn("_a", F.when(live, lists).otherwise(F.array().cast("array<struct<pos:int,dir:int,sym:string,n:int>>")))
        enough = F.aggregate("_a", F.struct(F.lit(0).alias("held"), F.lit(0).alias("k")), lambda a, x: F.struct(
            (a["held"] + F.when(a["held"] < 2 * F.col("lim"), x["n"]).otherwise(0)).alias("held"), (a["k"] + F.when(a["held"] < 2 * F.col("lim"), 1).otherwise(0)).alias("k")), lambda a: a["k"])
        state = F.struct("direction", "depth", "visited", "selected")
        none = F.lit(None).cast(s.select(state.alias("x")).schema["x"].dataType)
        # the state is a row of its own that no list answers, spread by the seed
        asks = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("dir"), F.col("seed_id").cast("string").alias("sym"), state.alias("state"))),
                        F.transform(F.slice("_a", F.lit(1), enough), lambda x: F.struct(x["pos"].alias("pos"), x["dir"].alias("dir"), x["sym"].alias("sym"), none.alias("state"))))
        rows = s.select("seed_id", "corpus", "lim", F.explode(asks).alias("x")).select("seed_id", "corpus", "lim", "x.*")
        step = (rows.join(adj, ["corpus", "sym", "dir"], "left").groupBy("seed_id", "corpus")
                .agg(F.first("lim").alias("lim"), F.first("state", ignorenulls=True).alias("s"),
                     F.array_sort(F.collect_list(F.when(F.col("dir") >= 0, F.struct("pos", "dir", F.slice("list", F.lit(1), F.col("lim")).alias("list"))))).alias("ls"))
                .select("seed_id", "corpus", "lim", "s.*", F.flatten(F.transform("ls", lambda x: x["list"])).alias("seen")))
        step = step.withColumn("fresh", F.slice(F.array_except(F.transform("seen", lambda x: x["edge"]), F.col("selected")), F.lit(1), F.col("lim") - F.size("selected")))
        # an edge was found from an end that is visited; where it was found from both, both are
        peers = F.transform(F.filter("seen", lambda x: F.array_contains("fresh", x["edge"])), lambda x: x["peer"])
        step = step.withColumn("frontier", F.array_except(peers, F.col("visited")))
        st = step.select("seed_id", "corpus", "direction", "depth", "lim", F.array_union("visited", "frontier").alias("visited"), "frontier",
                         F.concat("selected", "fresh").alias("selected"))
    ids = F.transform("visited", lambda x: x["id"])
    own = F.struct(F.lit(-1).alias("pos"), (F.lit(-1) - F.pmod(F.xxhash64("seed_id", "corpus"), F.lit(1 << 40))).alias("edge"), ids.alias("visited"))
    found = F.transform("selected", lambda e, i: F.struct(i.alias("pos"), e.alias("edge"), F.lit(None).cast("array<string>").alias("visited")))
    rows = st.select("seed_id", "corpus", F.explode(F.concat(F.array(own), found)).alias("x")).select("seed_id", "corpus", "x.*")
    named = rows.join(numbered.select("edge", F.struct(*fields).alias("e")), "edge", "left").groupBy("seed_id", "corpus").agg(
        F.first("visited", ignorenulls=True).alias("visited"), F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "e")))).alias("es"))
    return named.select("seed_id", "corpus", "visited", F.transform("es", lambda x: x["e"]).alias("selected"))


def traversal_edges(walk: DataFrame) -> DataFrame:
    return walk.select("seed_id", "corpus", F.posexplode("selected").alias("found", "e")).select("seed_id", "corpus", "found", "e.*")


def traversal_nodes(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    return walk.select("seed_id", "corpus", F.explode("visited").alias("symbol_id")).join(nodes, ["corpus", "symbol_id"])


def graph_notes(walk: DataFrame, nodes: DataFrame, notes: DataFrame, limit: int = X.NOTE_LIMIT) -> DataFrame:
    """Notes in the files a walk touched, about no symbol or a visited one; total, and whether
    more than ``limit`` (1 to 1000) were there."""
    n = max(1, min(1000, limit))
    seen = walk.select("seed_id", "corpus", F.explode("visited").alias("symbol_id"))
    files = (traversal_nodes(walk, nodes).select("seed_id", "corpus", "file")
             .unionByName(traversal_edges(walk).select("seed_id", "corpus", "file")).distinct())
    about = seen.join(notes.where("symbol_id IS NOT NULL"), ["corpus", "symbol_id"]).join(files, ["seed_id", "corpus", "file"], "left_semi")
    plain = files.join(notes.where("symbol_id IS NULL"), ["corpus", "file"])
    cols = ["seed_id", "corpus", "type", "file", "line", "symbol_id", "detail"]
    w = W.partitionBy("seed_id", "corpus")
    all_ = about.select(*cols).unionByName(plain.select(*cols))
    ranked = all_.withColumn("rank", F.row_number().over(w.orderBy(*note_order())))
    totals = all_.groupBy("seed_id", "corpus").agg(F.count(F.lit(1)).alias("total"))
    return ranked.where(F.col("rank") <= n).join(totals, ["seed_id", "corpus"]).withColumn("truncated", F.col("total") > n)


# --- outline, exact lookup, spans -------------------------------------------------------------
def outline(requests: DataFrame, nodes: DataFrame, notes: DataFrame | None = None, limit: int = X.OUTLINE_LIMIT) -> DataFrame:
    """Symbols of requested files (request_id, corpus, file, window_start?, window_end?) that overlap
    the window, in line order, with has_more and the number of chunks without symbol data."""
    end = F.when(F.col("window_start").isNotNull(), F.greatest("window_start", "window_end")).otherwise(F.col("window_end"))
    r = requests.withColumn("_end", F.when(F.col("window_end").isNotNull(), end))
    j = r.join(nodes, ["corpus", "file"]).where(
        (F.col("_end").isNull() | (F.col("start_line") <= F.col("_end"))) & (F.col("window_start").isNull() | (F.col("end_line") >= F.col("window_start"))))
    j = j.withColumn("label", F.when(trim_ws(F.coalesce("symbol_label", F.lit(""))) != "", F.col("symbol_label")).otherwise(F.col("symbol_id")))
    w = W.partitionBy("request_id")
    j = j.withColumn("rank", F.row_number().over(w.orderBy("start_line", "end_line", "label", "symbol_id"))).where(F.col("rank") <= limit + 1)
    j = j.withColumn("has_more", F.max("rank").over(w) > limit).where(F.col("rank") <= limit)
    cols = ["request_id", "corpus", "file", "rank", "symbol_id", "label", "start_line", "end_line", "has_more"]
    if notes is None:
        return j.select(*cols)
    missing = notes.where("type = 'missing_symbol_metadata'").groupBy("corpus", "file").agg(F.count(F.lit(1)).alias("missing"))
    return j.select(*cols).join(missing, ["corpus", "file"], "left").na.fill(0, ["missing"])


def symbol_exact(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests (request_id, corpus, file, want_id?, want_label?) ⇒ ok, ambiguous or not_found with
    the match count and, when it is one, its id and span."""
    label = F.when(trim_ws(F.coalesce("symbol_label", F.lit(""))) != "", F.col("symbol_label")).otherwise(F.col("symbol_id"))
    n = nodes.select("corpus", "file", "symbol_id", label.alias("_label"), "start_line", "end_line")
    fits = ((F.col("want_id").isNull() | (F.col("symbol_id") == F.col("want_id")))
            & (F.col("want_label").isNull() | (F.col("_label") == F.col("want_label"))))
    first = F.struct("start_line", "end_line", "_label", "symbol_id")
    got = (requests.join(n, ["corpus", "file"]).where(fits).groupBy("request_id")
           .agg(F.count(F.lit(1)).alias("matches"), F.min(first).alias("m")))
    j = requests.join(got, "request_id", "left")
    one = F.col("matches") == 1
    return j.select("request_id", F.when(F.col("matches").isNull(), "not_found").when(one, "ok").otherwise("ambiguous").alias("status"),
                    F.coalesce("matches", F.lit(0)).alias("matches"), F.when(one, F.col("m.symbol_id")).alias("symbol_id"),
                    F.when(one, F.col("m.start_line")).alias("start_line"), F.when(one, F.col("m.end_line")).alias("end_line"))


def read_spans(requests: DataFrame, files: DataFrame, max_lines: int = X.READ_MAX_LINES) -> DataFrame:
    """Text for (request_id, corpus, path, start?, end?). Open-ended reads stop after ``max_lines``
    and say where to go on."""
    ls = F.split("content", "\r?\n", -1)
    ls = F.when(F.element_at(ls, -1) == "", F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls)
    j = requests.join(files.select("corpus", "path", "content"), ["corpus", "path"]).withColumn("_l", ls).withColumn("total", F.size("_l"))
    clamp = lambda c, lo, hi: F.least(F.greatest(c, lo), hi)
    t, s, e = F.col("total"), F.col("start"), F.col("end")
    first = F.when(s.isNotNull(), clamp(s, F.lit(1), t)).otherwise(F.lit(1))
    last = (F.when(s.isNull() & e.isNull(), F.least(t, F.lit(max_lines)))
            .when(e.isNull(), F.least(first + max_lines - 1, t))
            .otherwise(clamp(e, F.when(s.isNotNull(), first).otherwise(F.lit(1)), t)))
    j = j.withColumn("first_line", F.when(t > 0, first).otherwise(1)).withColumn("last_line", F.when(t > 0, last).otherwise(0))
    more = e.isNull() & (F.col("last_line") < t)
    return j.select("request_id", "corpus", "path", "total", "first_line", "last_line", F.when(more, F.col("last_line") + 1).alias("next_start"),
                    F.when(t > 0, F.array_join(F.slice("_l", F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n")).otherwise(F.col("content")).alias("text"))


def read_symbols(requests: DataFrame, nodes: DataFrame, files: DataFrame, max_lines: int = X.READ_MAX_LINES) -> DataFrame:
    """read_spans for symbols: only requests that resolve to one symbol give text."""
    found = symbol_exact(requests, nodes).where("status = 'ok'").select("request_id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    r = requests.select("request_id", "corpus", F.col("file").alias("path")).join(found, "request_id")
    return read_spans(r, files, max_lines)


def in_graph(files: DataFrame, path: str = "path", ignore_rules: list[str] | None = None) -> DataFrame:
    """Rows of files that a graph is built from."""
    rules = GRAPH_IGNORED + (ignore_rules or [])
    return files.where(graph_capable(F.lit("unknown"), extension(F.col(path))) & normalize_path(F.col(path)).isNotNull() & ~is_ignored(F.col(path), rules))
