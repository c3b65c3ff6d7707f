"""Query-log, fusion, scoring, grouping and whole-search queries."""

from pyspark.sql import functions as F

from entries import views as V
from quarry.functions import fixed as X
from quarry.functions.embedders import LETTERS, letter_vector
from quarry.operators import grouping as G, retrieval as R, scoring as S
from quarry.plans import search as P
from quarry.session import cut_lineage

NOW = "2026-01-29T00:00:00"
CTE = V.CTE
TOKEN = r'((?:\\[\s\S]?|"(?:\\[\s\S]|[^"\\])*(?:"|\\?\z)|[^\s"\\])+)'


# --- DuckDB side: query log -----------------------------------------------------------------
def _trim(e):
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _unq(e):
    t = _trim(e)
    return (f"CASE WHEN length({t}) >= 2 AND {t} LIKE '\"%\"' THEN replace(replace(substr({t},2,length({t})-2), "
            f"chr(92)||'\"', '\"'), chr(92)||chr(92), chr(92)) ELSE {t} END")


def _vals(key, wrap="{}"):
    n = len(key) + 2
    return (f"list_transform(list_filter(list_transform(list_filter(tokens, lambda t: starts_with(t, '{key}:')), "
            f"lambda t: {_unq(f'substr(t,{n})')}), lambda v: length(v) > 0), lambda v: {wrap.format('v')})")


STOP = "[" + ",".join(f"'{w}'" for w in X.STOPWORDS) + "]"
IDENT = r"regexp_matches(t, '[A-Z0-9_/\\.:-]')"
_CLEAN = lambda e: "lower(" + _trim(rf"regexp_replace(regexp_replace({e}, '^[''\x22`]+|[''\x22`]+$', '', 'g'), '[(){{}}\[\],;]+', ' ', 'g')") + ")"
_EXP = (r"lower(regexp_replace(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[/\\._:-]+', ' ', 'g'), "
        r"'[(){}\[\],;]+', ' ', 'g'))")

CTE["q0"] = """SELECT *, CASE WHEN strpos(win, chr(10)||chr(10)) > 0 THEN substr(win, 1, strpos(win, chr(10)||chr(10))-1) ELSE win END AS prefix,
  CASE WHEN strpos(win, chr(10)||chr(10)) > 0 THEN substr(raw, strpos(win, chr(10)||chr(10))+2) ELSE substr(raw, 201) END AS suffix
  FROM (SELECT *, substr(raw, 1, 200) AS win FROM queries_v)"""
CTE["q1"] = f"SELECT *, regexp_extract_all(prefix, '{TOKEN}', 1) AS tokens FROM q0"
CTE["q_ops"] = f"""SELECT query_id, raw, scope, group_by, result_limit, {_vals('lang', 'lower({})')} AS lang,
  {_vals('path', 'replace({}, chr(92), chr(47))')} AS path, {_vals('-path', 'replace({}, chr(92), chr(47))')} AS not_path,
  {_vals('must')} AS must, {_vals('exclude')} AS exclude,
  {_trim("array_to_string(list_transform(list_filter(tokens, lambda t: NOT regexp_matches(t, '^(lang|path|-path|must|exclude):')), lambda t: CASE WHEN starts_with(t, chr(92)) AND length(t) > 1 THEN substr(t, 2) ELSE t END), ' ')")} AS head,
  {_trim('suffix')} AS tail FROM q1"""
CTE["q_sem"] = f"""SELECT *, CASE WHEN head <> '' AND tail <> '' THEN head || chr(10) || tail WHEN head <> '' THEN head WHEN tail <> '' THEN tail
  ELSE {_trim('raw')} END AS semantic FROM q_ops"""
CTE["q_tok"] = r"SELECT *, list_filter(regexp_split_to_array(semantic, '\s+'), lambda t: t <> '') AS toks FROM q_sem"
CTE["q_cnt"] = rf"""SELECT *, list_filter(toks, lambda t: {IDENT}) AS idents,
  len(list_filter(toks, lambda t: NOT {IDENT} AND (list_contains({STOP}, lower(t)) OR length(t) >= 4))) AS n_nat,
  regexp_matches(lower(semantic), '(?:^|[^A-Za-z0-9_])(?:(?:used|uses|usage|reference|references|referenced|callers?|called|imports?|imported|instantiat(?:e|ed|ion))|where\s+is|who\s+uses)(?:[^A-Za-z0-9_]|$)') AS reference_seeking
  FROM q_tok"""
_MIX, _IDO = "(len(idents) > 0 AND n_nat > 0)", "len(idents) > 0"
_BARE = f"(len(toks) = 1 AND regexp_matches(toks[1], '^[a-z][a-z0-9]{{2,63}}$') AND NOT list_contains({STOP}, lower(toks[1])))"
_PROSE = "(n_nat >= 2 OR len(toks) >= 4)"
CTE["q_intent"] = f"""SELECT *, CASE WHEN {_MIX} THEN 'mixed' WHEN {_IDO} THEN 'identifier' WHEN {_BARE} THEN 'uncertain' WHEN {_PROSE} THEN 'semantic' ELSE 'uncertain' END AS intent,
  CASE WHEN {_MIX} THEN CASE WHEN len(idents) >= 2 THEN 'high' ELSE 'medium' END WHEN {_IDO} THEN CASE WHEN len(toks) = len(idents) THEN 'high' ELSE 'medium' END
   WHEN {_BARE} THEN 'medium' WHEN {_PROSE} THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN {_MIX} THEN 'identifier_terms_present,natural_language_terms_present' WHEN {_IDO} THEN CASE WHEN len(toks) = 1 THEN 'single_identifier_token' ELSE 'identifier_tokens_present' END
   WHEN {_BARE} THEN 'single_term_lookup' WHEN {_PROSE} THEN 'natural_language_query' ELSE 'ambiguous_short_query' END
   || CASE WHEN reference_seeking THEN ',reference_seeking_query' ELSE '' END AS reasons,
  CASE WHEN {_IDO} THEN idents ELSE toks END AS src FROM q_cnt"""
CTE["q_every"] = f"""SELECT *, flatten(list_transform(src, lambda t: list_concat([{{'value': {_CLEAN('t')}, 'kind': 'whole'}}],
   list_transform(list_filter(regexp_split_to_array({_EXP}, '\\s+'), lambda p: length(p) >= 2), lambda p: {{'value': {_CLEAN('p')}, 'kind': 'fragment'}})))) AS every FROM q_intent"""
CTE["q_vals"] = """SELECT *, list_transform(every, lambda e: e.value) AS vals, list_transform(list_filter(every, lambda e: e.kind = 'whole'), lambda e: e.value) AS wholes FROM q_every"""
CTE["q_terms8"] = f"""SELECT *, list_slice(list_filter(vals, lambda v, i: list_position(vals, v) = i AND v <> '' AND NOT list_contains({STOP}, v)), 1, 8) AS tv FROM q_vals"""
CTE["qp"] = """SELECT *, list_transform(tv, lambda v: {'value': v, 'kind': CASE WHEN list_contains(wholes, v) THEN 'whole' ELSE 'fragment' END}) AS terms,
  CASE WHEN intent='identifier' THEN 'lexical' ELSE 'hybrid' END AS mode,
  CASE WHEN intent='identifier' THEN 1.35::DOUBLE WHEN intent='mixed' THEN CASE WHEN reference_seeking THEN 0.18::DOUBLE ELSE 0.05::DOUBLE END
   WHEN intent='uncertain' THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS lexical_weight,
  intent <> 'semantic' AND NOT reference_seeking AS pin, intent <> 'identifier' AS rerank_allowed,
  least(80, greatest(result_limit * 8, 32)) AS base FROM q_terms8"""
QLOG = ("queries_v", "q0", "q1", "q_ops", "q_sem")
QPLAN = QLOG + ("q_tok", "q_cnt", "q_intent", "q_every", "q_vals", "q_terms8", "qp")

# --- DuckDB side: retrieval and fusion ------------------------------------------------------
_LET = lambda e: "[" + ",".join(f"CAST(length(lower({e})) - length(replace(lower({e}),'{c}','')) AS DOUBLE)" for c in LETTERS) + "]"
CTE["passes"] = """SELECT query_id, 'primary' AS pass, semantic FROM qp UNION ALL
  SELECT query_id, 'expanded', semantic || chr(10) || 'implementation runtime source entrypoint' FROM qp"""
CTE["pv"] = f"SELECT query_id, pass, semantic, {_LET('semantic')} AS v FROM passes"
CTE["cv"] = f"SELECT chunk_id, {_LET('content')} AS v FROM chunks"
CTE["dense_l"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, pass, chunk_id, CASE WHEN np*nc > 0 THEN round(list_dot_product(p.v, c.v)/(np*nc), 9) ELSE 0 END AS score
  FROM (SELECT *, sqrt(list_dot_product(v,v)) AS np FROM pv) p, (SELECT *, sqrt(list_dot_product(v,v)) AS nc FROM cv) c)) WHERE rank <= 80"""
CTE["c_tok"] = "SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS term FROM chunks"
CTE["c_len"] = "SELECT chunk_id, len(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS len FROM chunks"
CTE["c_post"] = "SELECT term, t.chunk_id, len, count(*) AS tf FROM c_tok t JOIN c_len USING (chunk_id) GROUP BY ALL"
CTE["p_terms"] = "SELECT DISTINCT query_id, pass, unnest(regexp_extract_all(lower(semantic), '[a-z0-9_]+')) AS term FROM passes"
CTE["c_idf"] = "SELECT term, ln(1.0::DOUBLE + ((SELECT count(*) FROM c_len) - count(*) + 0.5::DOUBLE)/(count(*) + 0.5::DOUBLE)) AS idf FROM c_post GROUP BY term"
CTE["sparse_l"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, pass, chunk_id, round(sum(idf*(tf*2.2::DOUBLE/(tf+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*len/(SELECT avg(len) FROM c_len))))),9) AS score
  FROM p_terms JOIN c_post USING (term) JOIN c_idf USING (term) GROUP BY ALL)) WHERE rank <= 80"""
CTE["lists"] = """SELECT query_id, pass, 'dense' AS source, chunk_id, rank FROM dense_l UNION ALL SELECT query_id, pass, 'sparse', chunk_id, rank FROM sparse_l"""
CTE["attempts"] = """SELECT query_id, 0 AS attempt, base AS cap FROM qp UNION ALL SELECT query_id, 1, least(80, base*2) FROM qp WHERE len(must) > 0 AND base < 80
  UNION ALL SELECT query_id, 2, 80 FROM qp WHERE len(must) > 0 AND base*2 < 80"""
CTE["hyb"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, attempt, pass ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, attempt, any_value(cap) AS cap, pass, chunk_id, round(sum(1.0::DOUBLE/(100+rank)),12) AS score FROM lists JOIN attempts USING (query_id)
  WHERE rank <= cap GROUP BY query_id, attempt, pass, chunk_id)) WHERE rank <= cap"""
CTE["fused"] = """SELECT query_id, attempt, path, start_line, end_line, language, round(sum(1.0::DOUBLE/(60+rank)),12) AS fusion, max(score) AS backend, count(*) AS n_passes,
  arg_min(chunk_id, CASE WHEN pass='primary' THEN 0 ELSE 1000 END + rank) AS chunk_id FROM hyb JOIN chunks USING (chunk_id)
  GROUP BY query_id, attempt, path, start_line, end_line, language"""
RETR = QPLAN + ("chunks0", "chunks1", "chunks", "passes", "pv", "cv", "dense_l", "c_tok", "c_len", "c_post", "p_terms", "c_idf", "sparse_l", "lists")
FUSE = RETR + ("attempts", "hyb", "fused")

_SEG = lambda p, names: f"regexp_matches({p}, '(^|/)({names})/') OR regexp_matches({p}, '^({names})$')"
DOCS = "(" + _SEG("lp", "docs|doc|documentation|guide|guides") + r" OR regexp_matches(lp, '\.(md|mdx|rst|adoc|txt)$'))"
TESTS = "(" + _SEG("lp", "test|tests|__tests__") + r" OR regexp_matches(lp, '\.(test|spec)\.[^/]+$'))"
GENERATED = r"regexp_matches(lp, '/(dist|build|coverage|\.next|generated)/|\.min\.(js|css)$')"
CATEGORY = (f"CASE WHEN {DOCS} THEN 'docs' WHEN {TESTS} THEN 'tests' WHEN {GENERATED} THEN 'generated' "
            r"WHEN regexp_matches(lp, '(^|/)(main|index|app|server|cli|entry)\.[^/]*$') THEN 'entrypoint' "
            "WHEN lp LIKE '%/core/%' THEN 'core' WHEN lp LIKE '%/src/%' THEN 'srcRuntime' ELSE 'neutral' END")
NOISE = (f"CASE WHEN {GENERATED} OR {_SEG('lp', 'coverage|dist|build')} THEN 'generated' WHEN {TESTS} THEN 'tests' "
         f"WHEN {_SEG('lp', 'fixtures|__fixtures__')} THEN 'fixtures' WHEN {DOCS} THEN 'docs' ELSE 'runtime' END")
# the path patterns of queries_v, written out by hand
_PATHS = "(len(path_pats) = 0 OR starts_with(path, 'src/'))"
_FIELDS = lambda v: f"(contains(coalesce(symbol_label,''),{v}) OR contains(path,{v}) OR contains(content,{v}))"
CTE["cand0"] = """SELECT f.query_id, f.attempt, f.fusion, f.backend, c.* EXCLUDE (doc_id, corpus), lower(c.path) AS lp,
  q.* EXCLUDE (query_id, path, not_path), q.path AS path_pats, q.not_path AS not_pats FROM fused f JOIN chunks c USING (chunk_id) JOIN qp q ON q.query_id = f.query_id"""
CTE["cand1"] = f"SELECT *, {CATEGORY} AS category FROM cand0"
CTE["cand"] = f"""SELECT *, CASE WHEN (scope='runtime' AND category IN ('docs','tests')) OR (scope='docs' AND category NOT IN ('docs','tests')) THEN 'scope'
  WHEN len(lang) > 0 AND NOT list_contains(lang, language) THEN 'lang' WHEN NOT {_PATHS} THEN 'path'
  WHEN len(not_pats) > 0 AND starts_with(path, 'src/auth/') THEN 'not_path'
  WHEN len(list_filter(must, lambda m: NOT {_FIELDS('m')})) > 0 THEN 'must'
  WHEN len(list_filter(exclude, lambda m: {_FIELDS('m')})) > 0 THEN 'exclude' END AS reason FROM cand1"""
CAND = FUSE + ("cand0", "cand1", "cand")
CTE["att"] = """SELECT query_id, coalesce(min(CASE WHEN n >= result_limit THEN attempt END), (SELECT max(attempt) FROM attempts a WHERE a.query_id = x.query_id)) AS use
  FROM (SELECT query_id, attempt, any_value(result_limit) AS result_limit, count(*) FILTER (reason IS NULL) AS n FROM cand GROUP BY query_id, attempt) x GROUP BY query_id"""
CTE["kept"] = "SELECT c.* FROM cand c JOIN att ON att.query_id = c.query_id AND c.attempt = use WHERE reason IS NULL"
CTE["ev0"] = """SELECT query_id, chunk_id, any_value(reference_seeking) AS ref, any_value(intent) AS intent, t.value AS v, t.kind AS kind,
  lower(coalesce(any_value(symbol_label),'')) AS lb, any_value(lp) AS lp, lower(any_value(content)) AS ct FROM (SELECT *, unnest(terms) AS t FROM kept) GROUP BY query_id, chunk_id, t"""


def _b(f):
    return f"regexp_matches({f}, '(?:^|[^a-z0-9])' || regexp_escape(v) || '(?:[^a-z0-9]|$)')"


_ST, _EN = "regexp_matches(v, '^[a-z0-9_]')", "regexp_matches(v, '[a-z0-9_]$')"
_BEF = f"CASE WHEN {_ST} THEN '(?:^|[^a-z0-9_])' ELSE '[a-z0-9_]' END"
_AFT = f"CASE WHEN {_EN} THEN '(?:[^a-z0-9_]|$)' ELSE '[a-z0-9_]' END"
_MID = f"CASE WHEN {_ST} THEN '(?:.*[^a-z0-9_])?' ELSE '.*[a-z0-9_]' END"


def use_sql(ct):
    return rf"""CASE WHEN regexp_matches({ct}, '(?:^|[^a-z0-9_])new\s+' || regexp_escape(v) || {_AFT}) OR regexp_matches({ct}, {_BEF} || regexp_escape(v) || '\s*\(')
   OR ({_EN} AND regexp_matches({ct}, {_BEF} || regexp_escape(v) || '\s*=')) THEN 'executable'
   WHEN regexp_matches({ct}, '(?:^|[^a-z0-9_])import\s+' || {_MID} || regexp_escape(v) || {_AFT}) THEN 'import' END"""


def decl_sql(ct):
    return rf"""(regexp_matches({ct}, '(?:^|[^a-z0-9_])(?:class|def|function|type|interface|enum|struct)\s+' || regexp_escape(v) || {_AFT})
   OR ({_EN} AND regexp_matches({ct}, '(?:^|[^a-z0-9_])(?:const|let|var)\s+' || regexp_escape(v) || '\s*=\s*(?:(?:async\s+)?function(?:[^a-z0-9_]|$)|(?:async\s*)?(?:\([^)]*\)|[a-z_$][a-z0-9_$]*)\s*=>)')))"""


CTE["ev1"] = f"SELECT *, CASE WHEN ref THEN {use_sql('ct')} END AS use, ref AND {decl_sql('ct')} AS decl FROM ev0"
CTE["ev2"] = f"""SELECT *, CASE WHEN use='executable' AND NOT decl THEN 1 WHEN use='import' AND NOT decl THEN 2 WHEN {_b('lb')} THEN 3
  WHEN len(list_filter(string_split(lp,'/'), lambda s: {_b('s')})) > 0 THEN 4 WHEN {_b('ct')} THEN 5
  WHEN contains(lb, v) THEN 6 WHEN contains(lp, v) THEN 7 WHEN contains(ct, v) THEN 8 ELSE 0 END AS tier,
  CASE WHEN kind='whole' THEN 1.0::DOUBLE WHEN ref OR intent='identifier' THEN 0.18::DOUBLE ELSE 0.35::DOUBLE END AS fac FROM ev1"""
CTE["ev"] = """SELECT query_id, chunk_id, max(fac * CASE tier WHEN 1 THEN 1.6::DOUBLE WHEN 2 THEN 0.75::DOUBLE WHEN 3 THEN CASE WHEN ref THEN 0.02::DOUBLE ELSE 1.3::DOUBLE END
  WHEN 4 THEN CASE WHEN ref THEN 0.02::DOUBLE ELSE 1.2::DOUBLE END WHEN 5 THEN CASE WHEN ref THEN CASE WHEN decl THEN 0.1::DOUBLE ELSE 1.25::DOUBLE END ELSE 0.9::DOUBLE END
  WHEN 6 THEN CASE WHEN ref THEN 0.04::DOUBLE ELSE 0.55::DOUBLE END WHEN 7 THEN CASE WHEN ref THEN 0.04::DOUBLE ELSE 0.45::DOUBLE END
  WHEN 8 THEN CASE WHEN ref THEN CASE WHEN decl THEN 0.08::DOUBLE ELSE 0.3::DOUBLE END ELSE 0.25::DOUBLE END ELSE 0 END) AS s,
  bool_or(NOT ref AND kind='whole' AND tier IN (3,4)) AS exact FROM ev2 GROUP BY query_id, chunk_id"""
_MULT = "CASE scope || '/' || category " + " ".join(
    f"WHEN '{s}/{c}' THEN {m}::DOUBLE" for s, cats in X.SCOPE_MULTIPLIERS.items() for c, m in cats.items()) + " END"
CTE["sc0"] = f"""SELECT k.*, coalesce(s,0)*lexical_weight AS lexical, coalesce(e.exact,false) AS exact, {_MULT} AS path_mult, 1.0::DOUBLE AS changed_mult
  FROM kept k LEFT JOIN ev e ON e.query_id=k.query_id AND e.chunk_id=k.chunk_id"""
CTE["sc"] = "SELECT *, round((fusion+lexical)*path_mult*changed_mult, 12) AS final FROM sc0"
_ORD = "final DESC, nullif(path,'') NULLS LAST, start_line, nullif(symbol_label,'') NULLS LAST, nullif(symbol_id,'') NULLS LAST, chunk_id"
CTE["rk"] = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (pin AND exact) DESC, {_ORD}) AS rank,
  row_number() OVER (PARTITION BY query_id ORDER BY {_ORD}) AS plain FROM sc"""
CTE["ranked"] = """SELECT *, pin AND max(CASE WHEN rank=1 THEN exact::INT END) OVER (PARTITION BY query_id) <> max(CASE WHEN plain=1 THEN exact::INT END) OVER (PARTITION BY query_id) AS pinning_applied FROM rk"""
SCORED = CAND + ("att", "kept", "ev0", "ev1", "ev2", "ev", "sc0", "sc", "rk", "ranked")


def group_ctes(src):
    """CTEs from a ranked candidate CTE to diversified groups."""
    n = lambda x: f"{src}_{x}"
    CTE[n("gk")] = f"""SELECT *, CASE WHEN group_by='file' THEN 'file:'||path WHEN symbol_id IS NOT NULL THEN 'symbol:'||symbol_id
      ELSE 'lines:'||path||':'||((greatest(1,start_line)-1)//25) END AS gk FROM {src}"""
    CTE[n("g0")] = f"""SELECT query_id, gk, arg_min(chunk_id, rank) AS rep, min(start_line) AS s, max(end_line) AS e, max(indexed_at) AS indexed_at, count(*) AS chunks
      FROM {n('gk')} GROUP BY query_id, gk"""
    CTE[n("g")] = f"""SELECT g.query_id, coalesce(r.symbol_id, 'grp_'||substr(sha1(r.path||':'||s||'-'||e),1,16)) AS group_id, r.path, s AS start_line, e AS end_line,
      r.language, r.symbol_id, r.symbol_label, r.final, r.exact, g.indexed_at, chunks,
      CASE WHEN g.indexed_at IS NULL THEN 'unknown' WHEN greatest(0, epoch('{NOW}'::TIMESTAMP) - epoch(g.indexed_at::TIMESTAMP)) <= 1800 THEN 'fresh'
       WHEN epoch('{NOW}'::TIMESTAMP) - epoch(g.indexed_at::TIMESTAMP) <= 86400 THEN 'aging' ELSE 'stale' END AS staleness,
      CASE WHEN length(content) > 4000 THEN substr(content,1,4000)||'...' ELSE content END AS preview, pin, reference_seeking, intent, result_limit
      FROM {n('g0')} g JOIN {src} r ON r.query_id=g.query_id AND r.chunk_id=g.rep"""
    CTE[n("d0")] = rf"""SELECT *, lower({_trim("coalesce(symbol_label,'')")}) AS lbl, lower(substr(preview,1,240)) AS pv FROM {n('g')}"""
    CTE[n("d1")] = rf"""SELECT *, CASE WHEN (reference_seeking OR intent='identifier') AND lbl <> '' AND (regexp_matches(lbl, '^((class|type|interface|enum|struct|function|def)([^a-z0-9_]|$)|(const|let|var)\s+[a-z0-9_$]+\s*=)')
      OR regexp_matches(pv, '(^|[^a-z0-9_])((class|type|interface|enum|struct|function|def)\s+[a-z0-9_]|(const|let|var)\s+[a-z0-9_$]+\s*=\s*((async\s+)?function([^a-z0-9_]|$)|(async\s*)?(\([^)]*\)|[a-z_$][a-z0-9_$]*)\s*=>))'))
      THEN path||'::'||regexp_replace(lbl,'\s+',' ','g') ELSE 'unique:'||group_id END AS dk FROM {n('d0')}"""
    CTE[n("c")] = f"""SELECT * FROM {n('d1')} QUALIFY row_number() OVER (PARTITION BY query_id, dk ORDER BY final DESC, path, start_line, symbol_label NULLS LAST, symbol_id NULLS LAST, group_id) = 1"""
    CTE[n("r")] = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (pin AND exact) DESC, final DESC, path, start_line, symbol_label NULLS LAST, symbol_id NULLS LAST, group_id) AS rank FROM {n('c')}"""
    CTE[n("f")] = f"""SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS fn FROM {n('r')}"""
    CTE[n("p")] = f"""SELECT *, count(*) FILTER (fn<=2) OVER (PARTITION BY query_id) AS firsts, count(*) OVER (PARTITION BY query_id) AS n,
      count(*) FILTER (fn<=2) OVER w AS fb, count(*) FILTER (fn=3) OVER w AS tb FROM {n('f')} WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    CTE[n("v0")] = f"""SELECT *, least(result_limit, firsts) < least(result_limit, n) AS relaxed,
      CASE WHEN fn<=2 THEN fb < result_limit ELSE least(result_limit,firsts) < least(result_limit,n) AND fn=3 AND firsts + tb < result_limit END AS picked,
      CASE WHEN fn>2 AND fb < result_limit THEN 1 ELSE 0 END + CASE WHEN least(result_limit,firsts) < least(result_limit,n) AND fn>3 AND firsts + tb < result_limit THEN 1 ELSE 0 END AS sk FROM {n('p')}"""
    CTE[n("v1")] = f"SELECT *, CAST(sum(sk) OVER (PARTITION BY query_id) AS BIGINT) AS skipped_by_file FROM {n('v0')}"
    CTE[n("div")] = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fn<=2 THEN 1 ELSE 2 END, rank) AS place FROM {n('v1')} WHERE picked"
    return tuple(n(x) for x in ("gk", "g0", "g", "d0", "d1", "c", "r", "f", "p", "v0", "v1", "div"))


GROUPED = group_ctes("ranked")

# --- DuckDB side: changed files and rerank --------------------------------------------------
CTE["changed"] = "SELECT path FROM chunks WHERE symbol_label LIKE 'class A%'"
CTE["sc_ch"] = """SELECT * REPLACE (round((fusion+lexical)*path_mult*CASE WHEN path IN (SELECT path FROM changed) AND (SELECT count(DISTINCT path) FROM changed) BETWEEN 1 AND 50 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 12) AS final) FROM sc"""
CTE["rr_src"] = "SELECT query_id, rank-1 AS idx, row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, chunk_id) AS new_rank FROM ranked WHERE rank <= 50"
CTE["rr"] = """SELECT r.* EXCLUDE (final, rank, plain, pinning_applied), round((CASE WHEN rerank_allowed AND scope <> 'docs' AND new_rank IS NOT NULL THEN fusion + 1.0::DOUBLE/(10+new_rank) ELSE fusion END
  + lexical)*path_mult*changed_mult, 12) AS final FROM ranked r LEFT JOIN rr_src s ON s.query_id=r.query_id AND s.idx=r.rank-1"""
CTE["rr_ranked"] = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (pin AND exact) DESC, {_ORD}) AS rank FROM rr"


# --- Spark side -----------------------------------------------------------------------------
def prepared(s, sf):
    return P.prepare(V.queries(s, sf))


def stored(s, sf):
    return cut_lineage(prepared(s, sf), "queries")


def cands(s, sf):
    return P.candidates(stored(s, sf), V.chunks(s, sf), letter_vector)


def ranked(s, sf, changed=None):
    return P.scored(stored(s, sf), V.chunks(s, sf), letter_vector, changed)


def groups(s, sf):
    return G.group_hits(ranked(s, sf), now())


def now():
    return F.lit(NOW).cast("timestamp")


def search(s, sf):
    return P.search_batch(V.queries(s, sf), V.chunks(s, sf), letter_vector, now())


def search_corpora(s, sf):
    """Every query looks at one corpus, with that corpus's term statistics and changed files."""
    q = V.queries(s, sf).withColumn("corpus", F.concat(F.lit("src"), F.col("query_id") % 20))
    changed = V.chunks(s, sf).where("symbol_label LIKE 'class A%'").select("corpus", "path")
    return P.search_batch(q, V.chunks(s, sf), letter_vector, now(), changed)


def L(c, name=None):
    return F.col(c).cast("long").alias(name or c)


def joined(*cols):
    return [F.concat_ws("|", c).alias(c) for c in cols]


def q_ops(s, sf):
    from quarry.functions.querylog import parse_operators
    return parse_operators(V.queries(s, sf)).select("query_id", "semantic", *joined("lang", "path", "not_path", "must", "exclude"))


def terms(s, sf):
    return prepared(s, sf).select("query_id", F.posexplode("terms").alias("pos", "t")).select(
        "query_id", L("pos"), F.col("t.value").alias("term"), F.col("t.kind").alias("kind"))


def filtered(col):
    """Survivors when only one of the filters is looked at."""
    return lambda s, sf: cands(s, sf).where(f"reason = '{col}'").select("query_id", L("attempt"), "chunk_id", "path")


def changed_boost(s, sf):
    changed = V.chunks(s, sf).where("symbol_label LIKE 'class A%'").select("path")
    return ranked(s, sf, changed).select("query_id", "chunk_id", F.round("final", 9).alias("final"), L("rank"))


def reranked(s, sf):
    r = cut_lineage(ranked(s, sf), "ranked")
    from pyspark.sql import Window as W
    ranks = r.where("rank <= 50").select("query_id", (F.col("rank") - 1).alias("idx"), F.row_number().over(
        W.partitionBy("query_id").orderBy(F.desc(F.length("content")), "chunk_id")).alias("new_rank"))
    return S.rerank(r, ranks).select("query_id", "chunk_id", F.round("final", 9).alias("final"), L("rank"))


def usage(s, sf):
    d = V.t(s, sf, "documents").select("doc_id", F.lower(F.regexp_replace("text", "([A-Za-z]+)([.,])", "$1()$2")).alias("c"),
                                       F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("v")).where("v <> ''")
    return d.select("doc_id", "v", S.usage_kind(F.col("c"), F.col("v")).alias("usage"), S.declares(F.col("c"), F.col("v")).alias("declared"))


def search_out(df):
    return df.select("query_id", L("place"), "group_id", "path", L("start_line"), L("end_line"), "symbol_label",
                     F.round("final", 9).alias("score"), "exact", L("chunks"), "staleness", F.md5("preview").alias("preview_md5"))


def passes(s, sf):
    return P.expand_passes(prepared(s, sf)).select("query_id", "pass", F.md5("semantic").alias("text_md5"))


def fusion(s, sf):
    p, c = stored(s, sf), V.chunks(s, sf)
    return P.fuse_passes(P.cut_and_fuse(p, P.pass_lists(p, c, letter_vector)), c).select(
        "query_id", L("attempt"), "chunk_id", F.round("fusion", 9).alias("fusion"), F.round("backend", 9).alias("backend"), L("n_passes"))


def degradation(s, sf):
    """Two kinds of query lose a pass: those seeking references the primary, ``must`` queries the expanded one."""
    p = stored(s, sf)
    lists = P.pass_lists(p, V.chunks(s, sf), letter_vector).join(p.select("query_id", "reference_seeking", F.size("must").alias("nm")), "query_id")
    lists = lists.where("NOT (reference_seeking AND pass = 'primary') AND NOT (nm > 0 AND pass = 'expanded')")
    return P.pass_status(p, lists).select("query_id", L("n_ok"), L("n_failed"), "status", "missing_pass")


def limits(s, sf):
    c = cut_lineage(cands(s, sf).select("query_id", "attempt", "chunk_id", "reason", "limits", "result_limit"), "candidates")
    per = c.groupBy("query_id", "attempt").agg(F.count_if(F.col("reason").isNull()).alias("survivors"))
    used = P.choose_attempt(c).select("query_id", F.col("attempt").alias("used")).distinct()
    caps = prepared(s, sf).select("query_id", F.posexplode("limits").alias("attempt", "cap"))
    return caps.join(per, ["query_id", "attempt"]).join(used, "query_id").select("query_id", L("attempt"), L("cap"), L("survivors"), (F.col("attempt") == F.col("used")).alias("chosen"))


def noise(s, sf):
    r = G.noise_hint(search(s, sf), ["src/auth/", "docs/"])
    return r.select("query_id", L("top"), "tests", "fixtures", "docs", "generated", "runtime", "suggested")


def nav(s, sf):
    return G.nav_hint(search(s, sf)).select("query_id", L("place"), "group_id", "graph_supported", "graph_reason", L("read_start"), L("read_end"), "outline_window")


QUERIES = {
    "query_operators": q_ops,
    "query_intent": lambda s, sf: prepared(s, sf).select("query_id", "intent", "confidence", "reasons", "reference_seeking"),
    "query_lexical_terms": terms,
    "query_weights": lambda s, sf: prepared(s, sf).select("query_id", "mode", "lexical_weight", "pin", "rerank_allowed"),
    "query_expand": passes,
    "multi_pass_fusion": fusion,
    "candidate_limit": limits,
    "pass_degradation": degradation,
    "scope_filter": filtered("scope"), "lang_filter": filtered("lang"), "path_filter": lambda s, sf: cands(s, sf).where("reason IN ('path','not_path')").select("query_id", L("attempt"), "chunk_id", "path", "reason"),
    "must_exclude_filter": lambda s, sf: cands(s, sf).where("reason IN ('must','exclude')").select("query_id", L("attempt"), "chunk_id", "path", "reason"),
    "filter_attribution": lambda s, sf: S.attribution(cands(s, sf).withColumn("attempt", F.col("attempt").cast("long")), ["query_id", "attempt"]),
    "lexical_evidence": lambda s, sf: ranked(s, sf).select("query_id", "chunk_id", F.round("lexical", 9).alias("lexical"), "exact"),
    "usage_kind": usage,
    "changed_boost": changed_boost,
    "final_score": lambda s, sf: ranked(s, sf).select("query_id", "chunk_id", "category", "path_mult", F.round("final", 9).alias("final")),
    "rank_candidates": lambda s, sf: ranked(s, sf).select("query_id", "chunk_id", L("rank"), "pinning_applied"),
    "rerank_fusion": reranked,
    "group_hits": lambda s, sf: groups(s, sf).select("query_id", "group_id", "path", L("start_line"), L("end_line"), F.round("final", 9).alias("score"), L("chunks"), "indexed_at", "staleness"),
    "collapse_declarations": lambda s, sf: G.rank_groups(G.collapse_declarations(groups(s, sf))).select("query_id", "group_id", "path", L("rank")),
    "diversify": lambda s, sf: search(s, sf).select("query_id", L("place"), "group_id", "relaxed", L("skipped_by_file")),
    "noise_hint": noise,
    "nav_hint": nav,
    "search_batch": lambda s, sf: search_out(search(s, sf)),
    "search_corpora": lambda s, sf: search_out(search_corpora(s, sf)),
    "search_raw": lambda s, sf: P.search_raw(V.queries(s, sf), V.chunks(s, sf), letter_vector).select("query_id", L("rank"), "chunk_id", F.round("final", 9).alias("score")),
}

# one corpus per query: lists, term statistics and changed files by corpus
_Q = "('src' || query_id % 20)"
ONE_CORPUS = {
    "cv": CTE["cv"].replace("SELECT chunk_id", "SELECT chunk_id, corpus"),
    "dense_l": CTE["dense_l"].replace("FROM cv) c)", "FROM cv) c WHERE c.corpus = 'src' || p.query_id % 20)"),
    "c_len": CTE["c_len"].replace("SELECT chunk_id", "SELECT chunk_id, corpus"),
    "c_post": "SELECT corpus, term, t.chunk_id, len, count(*) AS tf FROM c_tok t JOIN c_len USING (chunk_id) GROUP BY ALL",
    "c_idf": "SELECT corpus, term, ln(1.0::DOUBLE + (any_value(nc) - count(*) + 0.5::DOUBLE)/(count(*) + 0.5::DOUBLE)) AS idf FROM c_post JOIN (SELECT corpus, count(*) AS nc FROM c_len GROUP BY corpus) USING (corpus) GROUP BY corpus, term",
    "sparse_l": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, pass, chunk_id, round(sum(idf*(tf*2.2::DOUBLE/(tf+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*len/al)))),9) AS score
      FROM (SELECT *, {_Q} AS corpus FROM p_terms) JOIN c_post USING (corpus, term) JOIN c_idf USING (corpus, term) JOIN (SELECT corpus, avg(len) AS al FROM c_len GROUP BY corpus) USING (corpus) GROUP BY query_id, pass, chunk_id)) WHERE rank <= 80""",
    "sc": f"""SELECT *, round((fusion+lexical)*path_mult*CASE WHEN EXISTS (SELECT 1 FROM chunks h WHERE h.symbol_label LIKE 'class A%' AND h.corpus = {_Q.replace('query_id', 'sc0.query_id')} AND h.path = sc0.path)
      AND (SELECT count(DISTINCT path) FROM chunks h WHERE h.symbol_label LIKE 'class A%' AND h.corpus = {_Q.replace('query_id', 'sc0.query_id')}) <= 50 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 12) AS final FROM sc0""",
}
_J = lambda *cs: ", ".join(f"array_to_string({c}, '|') AS {c}" for c in cs)
_CAP = "js|ts|jsx|tsx|mjs|cjs|py"
_OKG = rf"(symbol_id IS NOT NULL AND (language IN ('typescript','javascript','python') OR regexp_matches(lower(path), '\.({_CAP})$')))"
_NOISE_PATTERN = {
    "**/*.test.*": r"(^|/)[^/]*\.test\.[^/]*(/|$)", "**/*.spec.*": r"(^|/)[^/]*\.spec\.[^/]*(/|$)", "**/__tests__/**": "(^|/)__tests__/.",
    "**/__fixtures__/**": "(^|/)__fixtures__/.", "**/fixtures/**": "(^|/)fixtures/.", "coverage/**": "^coverage/."}
_SUG = "concat_ws(',', " + ", ".join(
    f"CASE WHEN bool_or(c <> 'runtime' AND NOT (starts_with(path,'src/auth/') OR regexp_matches(path,'(^|/)docs/.')) AND regexp_matches(path, '{rx}')) THEN '{p}' END" for p, rx in _NOISE_PATTERN.items()) + ")"
_DROP = lambda *rs: "SELECT query_id, attempt::BIGINT AS attempt, chunk_id, path{} FROM cand WHERE reason IN (" + ",".join(f"'{r}'" for r in rs) + ")"
SQL = {
    "query_operators": V.sql(f"SELECT query_id, semantic, {_J('lang','path','not_path','must','exclude')} FROM q_sem", *QLOG),
    "query_intent": V.sql("SELECT query_id, intent, confidence, reasons, reference_seeking FROM qp", *QPLAN),
    "query_lexical_terms": V.sql("SELECT query_id, (i-1)::BIGINT AS pos, terms[i].value AS term, terms[i].kind AS kind FROM (SELECT query_id, terms, unnest(range(1, len(terms)+1)) AS i FROM qp)", *QPLAN),
    "query_weights": V.sql("SELECT query_id, mode, lexical_weight, pin, rerank_allowed FROM qp", *QPLAN),
    "query_expand": V.sql("SELECT query_id, pass, md5(semantic) AS text_md5 FROM passes", *QPLAN, "passes"),
    "multi_pass_fusion": V.sql("SELECT query_id, attempt::BIGINT AS attempt, chunk_id, round(fusion,9) AS fusion, round(backend,9) AS backend, n_passes FROM fused", *FUSE),
    "candidate_limit": V.sql("""SELECT a.query_id, a.attempt::BIGINT AS attempt, a.cap::BIGINT AS cap, n AS survivors, a.attempt = att.use AS chosen FROM attempts a JOIN att USING (query_id)
      JOIN (SELECT query_id, attempt, count(*) FILTER (reason IS NULL) AS n FROM cand GROUP BY ALL) k ON k.query_id=a.query_id AND k.attempt=a.attempt""", *CAND, "att"),
    "pass_degradation": V.sql("""SELECT query_id, (p+e)::BIGINT AS n_ok, (2-p-e)::BIGINT AS n_failed, CASE p+e WHEN 0 THEN 'error' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status,
      CASE WHEN p+e=1 AND p=0 THEN 'primary' WHEN p+e=1 THEN 'expanded' END AS missing_pass FROM (SELECT query_id, CASE WHEN reference_seeking THEN 0 ELSE 1 END AS p, CASE WHEN len(must)>0 THEN 0 ELSE 1 END AS e FROM qp)""", *QPLAN),
    "scope_filter": V.sql(_DROP("scope").format(""), *CAND), "lang_filter": V.sql(_DROP("lang").format(""), *CAND),
    "path_filter": V.sql(_DROP("path", "not_path").format(", reason"), *CAND),
    "must_exclude_filter": V.sql(_DROP("must", "exclude").format(", reason"), *CAND),
    "filter_attribution": V.sql("SELECT query_id, attempt::BIGINT AS attempt, count(*) AS before, " + ", ".join(
        f"count(*) FILTER (reason='{r}') AS removed_{r}" for r in ("scope", "lang", "path", "not_path", "must", "exclude")) + ", count(*) FILTER (reason IS NULL) AS after FROM cand GROUP BY query_id, attempt", *CAND),
    "lexical_evidence": V.sql("SELECT query_id, chunk_id, round(lexical,9) AS lexical, exact FROM sc", *SCORED[:-2]),
    "usage_kind": f"SELECT doc_id, v, CASE WHEN contains(c, v) THEN {use_sql('c')} END AS usage, contains(c, v) AND {decl_sql('c')} AS declared FROM (SELECT doc_id, lower(regexp_replace(text, '([A-Za-z]+)([.,])', '\\1()\\2', 'g')) AS c, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS v FROM documents) WHERE v <> ''",
    "changed_boost": V.sql(f"SELECT query_id, chunk_id, round(final,9) AS final, row_number() OVER (PARTITION BY query_id ORDER BY (pin AND exact) DESC, {_ORD}) AS rank FROM sc_ch", *SCORED[:-2], "changed", "sc_ch"),
    "final_score": V.sql("SELECT query_id, chunk_id, category, path_mult, round(final,9) AS final FROM sc", *SCORED[:-2]),
    "rank_candidates": V.sql("SELECT query_id, chunk_id, rank, pinning_applied FROM ranked", *SCORED),
    "rerank_fusion": V.sql("SELECT query_id, chunk_id, round(final,9) AS final, rank FROM rr_ranked", *SCORED, "rr_src", "rr", "rr_ranked"),
    "group_hits": V.sql("SELECT query_id, group_id, path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, round(final,9) AS score, chunks, indexed_at, staleness FROM ranked_g", *SCORED, *GROUPED[:3]),
    "collapse_declarations": V.sql("SELECT query_id, group_id, path, rank FROM ranked_r", *SCORED, *GROUPED[:7]),
    "diversify": V.sql("SELECT query_id, place, group_id, relaxed, skipped_by_file FROM ranked_div", *SCORED, *GROUPED),
    "noise_hint": V.sql(f"""SELECT query_id, count(*) AS top, {", ".join(f"round(count(*) FILTER (c='{c}') / count(*)::DOUBLE, 2) AS {c}" for c in ("tests","fixtures","docs","generated","runtime"))}, {_SUG} AS suggested
      FROM (SELECT *, {NOISE} AS c FROM (SELECT *, lower(path) AS lp FROM ranked_div WHERE place <= 5)) GROUP BY query_id HAVING count(*) FILTER (c <> 'runtime') / count(*)::DOUBLE >= 0.6""", *SCORED, *GROUPED),
    "nav_hint": V.sql(rf"""SELECT query_id, place, group_id, {_OKG} AS graph_supported, CASE WHEN symbol_id IS NULL THEN 'missing_symbol' WHEN NOT {_OKG} THEN 'unsupported_language' END AS graph_reason,
      CASE WHEN NOT {_OKG} THEN greatest(1,start_line)::BIGINT END AS read_start, CASE WHEN NOT {_OKG} THEN greatest(1,start_line,end_line)::BIGINT END AS read_end,
      NOT {_OKG} AND regexp_matches(lower(path), '\.({_CAP})$') AS outline_window FROM ranked_div""", *SCORED, *GROUPED),
    "search_batch": V.sql("""SELECT query_id, place, group_id, path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, symbol_label, round(final,9) AS score, exact, chunks, staleness, md5(preview) AS preview_md5 FROM ranked_div""", *SCORED, *GROUPED),
    "search_corpora": V.sql("""SELECT query_id, place, group_id, path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, symbol_label, round(final,9) AS score, exact, chunks, staleness, md5(preview) AS preview_md5 FROM ranked_div""", *SCORED, *GROUPED, instead=ONE_CORPUS),
    "search_raw": V.sql("SELECT query_id, rank, chunk_id, round(final,9) AS score FROM ranked WHERE rank <= result_limit", *SCORED),
}
