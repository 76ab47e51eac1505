"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code: keyword queries are evaluated by the
plain per-row algorithm on the query string, HTML by DuckDB's RE2, and every
derived input comes from the same view text (``sieve.plans.fixtures``).
"""

from __future__ import annotations

import html.entities

from sieve.plans import fixtures

# Python whitespace (str.isspace) in RE2 syntax
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
TOKEN = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[^>]*>|&#?[A-Za-z0-9]+;|[^<&]+|[<&]"
RANKS = ["MISSING", "A_STAR", "A", "B", "C"]


def lit(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, (int, float)):
        return str(s)
    if isinstance(s, (list, tuple)):
        return "[" + ", ".join(lit(x) for x in s) + "]"
    return "'" + str(s).replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def entity_map() -> str:
    table = {n: chr(c) for n, c in html.entities.name2codepoint.items()}
    table["apos"] = "'"
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in sorted(table.items())) + "}"


def markup_text(x: str, drop_tags: bool = True) -> str:
    tag = "WHEN starts_with(t_, '<') AND length(t_) > 1 THEN '' " if drop_tags else ""
    ent = entity_map()
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '{TOKEN}', 0), lambda t_: CASE "
        "WHEN starts_with(t_, '<![CDATA[') THEN substr(t_, 10, length(t_) - 12) "
        f"{tag}"
        "WHEN regexp_full_match(t_, '&#[0-9]{1,7};') THEN chr(CAST(regexp_extract(t_, '&#([0-9]+);', 1) AS INTEGER)) "
        f"WHEN starts_with(t_, '&') AND map_extract_value({ent}, regexp_extract(t_, '^&([A-Za-z0-9]+);$', 1)) IS NOT NULL "
        f"THEN map_extract_value({ent}, regexp_extract(t_, '^&([A-Za-z0-9]+);$', 1)) "
        "ELSE t_ END), '')"
    )


def or_match(text: str, expr: str) -> str:
    return (f"list_bool_or(list_transform(string_split_regex({expr}, '(?i)or'), "
            f"lambda p_: contains(lower({text}), lower({strip('p_')}))))")


def and_match(text: str, expr: str) -> str:
    return (f"(len(list_filter(string_split_regex({expr}, '(?i)and'), "
            f"lambda p_: NOT contains(lower({text}), lower({strip('p_')})))) = 0)")


def groups_list(expr: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, '\\(([^)]+)\\)', 1), lambda g_: {strip('g_')})"


def cnf(text: str, expr: str) -> str:
    """The per-row CNF algorithm on a query string (literal or column)."""
    groups = groups_list(expr)
    ors = (f"(len(list_filter({groups}, lambda g2_: NOT "
           f"list_bool_or(list_transform(string_split_regex(g2_, '(?i)or'), "
           f"lambda p_: contains(lower({text}), lower({strip('p_')})))))) = 0)")
    rest = f"list_reduce({groups}, lambda acc_, g3_: replace(acc_, '(' || g3_ || ')', ''), {expr})"
    return f"({ors} AND {and_match(text, rest)})"


def groups_query(groups_sql: str) -> str:
    """Keyword groups (a DuckDB list of lists) → query string, words de-duplicated and sorted."""
    return (f"coalesce(array_to_string(list_transform({groups_sql}, lambda w_: '(' || "
            f"array_to_string(list_sort(list_distinct(w_)), ' OR ') || ')'), ' AND '), '')")


def token_groups(text: str, groups) -> str:
    """Token split: each word one literal, stripped and lower-cased."""
    if not groups:
        return "TRUE"
    parts = []
    for g in groups:
        words = [w.strip().lower() for w in g]
        if "" in words:
            continue
        if not words:
            return "FALSE"
        parts.append("(" + " OR ".join(f"contains(lower({text}), {lit(w)})" for w in words) + ")")
    return "(" + " AND ".join(parts) + ")" if parts else "TRUE"


def prefix_any(col: str, prefixes) -> str:
    if prefixes is None:
        return f"({col} IS NOT NULL)"
    if not prefixes:
        return "FALSE"
    return "(" + " OR ".join(f"starts_with({col}, {lit(p)})" for p in prefixes) + ")"


def parse_rank(x: str) -> str:
    return (f"(CASE WHEN {x} = 'A*' THEN 'A_STAR' WHEN upper({x}) IN ('MISSING','A_STAR','A','B','C') "
            f"THEN upper({x}) ELSE 'MISSING' END)")


def rank_ord(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = '{r}' THEN {i}" for i, r in enumerate(RANKS)) + " ELSE 0 END)"


def views(*names: str) -> str:
    return ",\n".join(f"{n} AS ({fixtures.duckdb_view_sql(n)})" for n in names)


def spec(i: int) -> dict:
    return fixtures.REVIEW_SPECS[i - 1]


def candidates_where(i: int, title: str = "title") -> str:
    s = spec(i)
    q = groups_query(lit(s.get("search_word_groups") or []) + "::VARCHAR[][]")
    return (f"{prefix_any('key', s.get('accepted_venue_types'))} AND year BETWEEN {s['year_min']} AND {s['year_max']} "
            f"AND {cnf(title, q)}")


FIRST_TABLE = r"(?is)<table(?:\s[^>]*)?>(.*?)</table>"
ROW = r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"
CELL = r"(?is)<td(?:\s[^>]*)?>(.*?)</td>"


def rank_rows_cte(kind: str) -> str:
    key_cell = 2 if kind == "conference" else 1
    return f"""(SELECT '{kind}' AS kind, {strip(markup_text(f'cells[{key_cell}]'))} AS lookup_key, page_id,
        CAST(pos AS INTEGER) AS pos, {strip(markup_text('cells[4]'))} AS rank_text
      FROM (SELECT page_id, pos, regexp_extract_all(row_, '{CELL}', 1) AS cells
            FROM (SELECT page_id, unnest(rows_) AS row_, generate_subscripts(rows_, 1) - 1 AS pos
                  FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '{FIRST_TABLE}', 1), '{ROW}', 1) AS rows_
                        FROM rank_html)))
      WHERE pos >= 1 AND len(cells) > 3)"""


def dim_cte() -> str:
    return f"""(SELECT kind, lkey, {parse_rank('rank_text')} AS venue_rank FROM
      (SELECT kind, lower(lookup_key) AS lkey, arg_min(rank_text, (page_id, pos)) AS rank_text
       FROM ({rank_rows_cte('conference')} UNION ALL {rank_rows_cte('journal')}) GROUP BY 1, 2))"""


def ranked_candidates(i: int) -> str:
    """CTE text: candidates of review i, split and ranked (needs bib, rank_html)."""
    return f"""cand AS (SELECT *, string_split(key, '/') AS parts FROM bib WHERE {candidates_where(i)}),
split AS (SELECT * FROM cand WHERE len(parts) = 3),
dim AS {dim_cte()},
ranked AS (SELECT split.*, coalesce(dim.venue_rank, 'MISSING') AS venue_rank
           FROM split LEFT JOIN dim
             ON dim.kind = CASE parts[1] WHEN 'conf' THEN 'conference' WHEN 'journals' THEN 'journal' END
            AND dim.lkey = lower(parts[2]))"""


def gate_sql(i: int, missing_passes: bool = True) -> str:
    s = spec(i)
    th = s.get("venue_rank_threshold")
    allow = prefix_any("key", s.get("manually_accepted_venue_codes") or [])
    if th is None:
        valid = "TRUE"
    else:
        valid = f"({rank_ord('venue_rank')} <= {rank_ord(parse_rank(lit(th)))})"
        if not missing_passes:
            valid = f"({valid} AND venue_rank <> 'MISSING')"
    return f"({allow} OR {valid})"


def paper_select(i: int) -> str:
    return (f"SELECT CAST({i} AS BIGINT) AS study_id, rec_id, nullif(regexp_extract(ee, '{DOI}', 0), '') AS doi, "
            "CAST(NULL AS VARCHAR) AS semantic_scholar_id, title, year, parts[1] AS venue_type, "
            "parts[2] AS venue_code, parts[3] AS venue_key, venue_rank, ee AS publisher_source, "
            "CAST(NULL AS VARCHAR) AS pdf_source")


CNF_QUERY = "(ring OR anvil OR gizmo) AND (economy or promo) AND workload"

ORACLES: dict[str, str] = {}

ORACLES["screen"] = f"""WITH {views('bib', 'rank_html')},
{ranked_candidates(1)}
{paper_select(1)} FROM ranked WHERE {gate_sql(1)}"""

ORACLES["venue_type_filter"] = f"""WITH {views('bib')}
SELECT rec_id, key FROM bib WHERE {prefix_any('key', ['conf', 'journals'])}"""

ORACLES["year_filter"] = f"""WITH {views('bib')}
SELECT rec_id, year FROM bib WHERE year BETWEEN 1996 AND 1998"""

ORACLES["cnf_match"] = f"""WITH {views('bib')}
SELECT rec_id, {cnf('title', lit(CNF_QUERY))} AS matched FROM bib"""

ORACLES["cnf_match_column"] = f"""WITH {views('exprs')}
SELECT rec_id, {cnf('title', 'cnf_expr')} AS matched FROM exprs"""

ORACLES["or_match"] = f"""WITH {views('exprs')}
SELECT rec_id, {or_match('title', 'or_expr')} AS matched FROM exprs"""

ORACLES["and_match"] = f"""WITH {views('exprs')}
SELECT rec_id, {and_match('title', 'and_expr')} AS matched FROM exprs"""

ORACLES["paren_groups"] = f"""WITH {views('exprs')}
SELECT rec_id, array_to_string({groups_list('cnf_expr')}, '|') AS groups FROM exprs"""

_G1 = spec(1)["search_word_groups"]
ORACLES["keyword_groups"] = f"""SELECT doc_id, {cnf('text', groups_query(lit(_G1) + '::VARCHAR[][]'))} AS matched FROM documents"""
ORACLES["keyword_groups_token"] = f"""SELECT doc_id, {token_groups('text', _G1)} AS matched FROM documents"""

ORACLES["batch_limit"] = f"""WITH {views('bib')}
SELECT rec_id FROM bib WHERE {candidates_where(2)} ORDER BY ord LIMIT 100"""

ORACLES["split_key"] = f"""WITH {views('bib')}
SELECT rec_id, p[1] AS venue_type, p[2] AS venue_code, p[3] AS venue_key
FROM (SELECT rec_id, string_split(key, '/') AS p FROM bib) WHERE len(p) = 3"""

ORACLES["extract_doi"] = f"""WITH {views('bib')}
SELECT rec_id, nullif(regexp_extract(ee, '{DOI}', 0), '') AS doi FROM bib"""

ORACLES["parse_rank"] = f"""WITH {views('ranks')}
SELECT venue_code, rank_text, {parse_rank('rank_text')} AS venue_rank FROM ranks"""

ORACLES["rank_rows"] = f"""WITH {views('rank_html')}
SELECT * FROM {rank_rows_cte('conference')}"""

ORACLES["venue_rank_join"] = f"""WITH {views('bib', 'rank_html')},
{ranked_candidates(2)}
SELECT rec_id, parts[1] AS venue_type, parts[2] AS venue_code, venue_rank FROM ranked"""

ORACLES["venue_gate"] = f"""WITH {views('bib', 'rank_html')},
{ranked_candidates(1)}
SELECT rec_id, venue_rank, {gate_sql(1)} AS accepted FROM ranked"""

ORACLES["venue_gate_strict"] = f"""WITH {views('bib', 'rank_html')},
{ranked_candidates(1)}
SELECT rec_id, venue_rank, {gate_sql(1, missing_passes=False)} AS accepted FROM ranked"""


# --- text ----------------------------------------------------------------------
def clean(x: str) -> str:
    return f"coalesce(replace({strip(x)}, chr(10), ''), '')"


def words(x: str, v: str = "w_") -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda {v}: {v} <> '')"


def long_paras(x: str, n: int) -> str:
    return f"list_filter(string_split_regex({x}, '\\n\\n+'), lambda pp_: len({words('pp_', 'ww_')}) > {n})"


META_TAG = r"""(?is)<meta\s[^>]*property\s*=\s*["']og:description["'][^>]*>"""
CONTENT_DQ = r'''(?is)\scontent\s*=\s*"([^"]*)"'''
CONTENT_SQ = r"""(?is)\scontent\s*=\s*'([^']*)'"""


def meta_desc(html: str) -> str:
    tag = f"regexp_extract({html}, {lit(META_TAG)}, 0)"
    raw = (f"(CASE WHEN regexp_matches({tag}, {lit(CONTENT_DQ)}) THEN regexp_extract({tag}, {lit(CONTENT_DQ)}, 1) "
           f"WHEN regexp_matches({tag}, {lit(CONTENT_SQ)}) THEN regexp_extract({tag}, {lit(CONTENT_SQ)}, 1) END)")
    return f"(CASE WHEN {tag} <> '' THEN {markup_text(raw, drop_tags=False)} END)"


def page_text(html: str) -> str:
    h = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for e in ["script", "style", "li", "ul"]:
        h = f"regexp_replace({h}, '(?is)<{e}(?:[\\s/][^>]*)?>.*?</{e}\\s*>', '', 'g')"
    h = f"regexp_replace({h}, '(?s)<![^>]*>', '', 'g')"
    return markup_text(h)


def fallback(html: str, n: int = 200) -> str:
    body = clean(f"array_to_string({long_paras(page_text(html), n)}, '')")
    return (f"(CASE WHEN strpos(lower({body}), 'abstract') > 0 "
            f"THEN substr({body}, strpos(lower({body}), 'abstract')) ELSE {body} END)")


ROUTES = [(("sciencedirect",), "id", "abstracts"), (("ieee",), "meta", None), (("arxiv",), "id", "abs"),
          (("emerald", "acm"), "id", "abstract"), (("springer",), "id", "Abs1-content")]


def route(url: str) -> tuple[str, str]:
    r, e = "CASE", "CASE"
    for subs, kind, elem in ROUTES:
        cond = " OR ".join(f"contains({url}, {lit(s)})" for s in subs)
        r += f" WHEN {cond} THEN {lit(kind)}"
        e += f" WHEN {cond} THEN {lit(elem)}"
    return r + " ELSE 'fallback' END", e + " ELSE NULL END"


def id_text(html: str, elem: str) -> str:
    """Element text by id for this fixture's markup (a plain <div> without
    nested <div>): RE2 cannot follow nesting, the Spark side uses a parser."""
    inner = f"regexp_extract({html}, {lit('(?s)<div[^>]*[ ]id=\"' + elem + '\"[^>]*>(.*?)</div>')}, 1)"
    return clean(markup_text(inner))


def extract(url: str, html: str) -> str:
    r, _ = route(url)
    ids = " ".join(f"WHEN contains({url}, {lit(s)}) THEN {id_text(html, elem)}"
                   for subs, kind, elem in ROUTES if kind == "id" for s in subs)
    id_expr = f"(CASE {ids} END)"
    return f"(CASE {r} WHEN 'id' THEN {id_expr} WHEN 'meta' THEN {meta_desc(html)} ELSE {fallback(html)} END)"


LIKERT = ["strongly_disagree", "disagree", "somewhat_disagree", "neither_agree_or_disagree",
          "somewhat_agree", "agree", "strongly_agree"]


def likert(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = {i + 1} THEN {lit(l)}" for i, l in enumerate(LIKERT)) + " END)"


ORACLES["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"

_LP = long_paras("replace(text, chr(10), chr(10) || chr(10))", 40)
ORACLES["long_paragraphs"] = f"SELECT doc_id, CAST(len({_LP}) AS INTEGER) AS n_long, array_to_string({_LP}, '') AS long_text FROM documents"

ORACLES["meta_description"] = f"""WITH {views('web')}
SELECT page_id, {meta_desc('html')} AS description FROM web"""

ORACLES["fallback_abstract"] = f"SELECT page_id, {fallback('html')} AS abstract FROM pages"

_R, _E = route("url")
ORACLES["abstract_route"] = f"""WITH {views('web')}
SELECT page_id, {_R} AS route, {_E} AS element_id FROM web"""

ORACLES["text_by_id"] = f"""WITH {views('web')}
SELECT page_id, {id_text('html', 'abs')} AS text FROM web"""

ORACLES["extract_abstract"] = f"""WITH {views('web')}
SELECT page_id, {_R} AS route, {extract('url', 'html')} AS abstract FROM web"""

ORACLES["likert_label"] = f"SELECT l_orderkey, l_linenumber, {likert('l_linenumber')} AS label FROM lineitem"

NL = "chr(10)"
ORACLES["section_text"] = f"""WITH {views('meta')}
SELECT doi, 'tldr:' || {NL} || coalesce(tldr, 'None') || {NL} || {NL} || 'abstract:' || {NL} || coalesce(abstract, 'None') || {NL} AS text FROM meta"""

# --- responses, specs ---------------------------------------------------------------
JWS = r"[ \t\n\r]*"
JSTR = r'"(?:[^"\\]|\\.)*"'
SHAPE = f"{JWS}\\{{{JWS}\"ratings\"{JWS}:{JWS}\\[{JWS}(?:{JSTR}(?:{JWS},{JWS}{JSTR})*)?{JWS}\\]{JWS}\\}}{JWS}"


def response_ok(r: str) -> str:
    return (f"coalesce(json_valid({r}) AND (CASE WHEN json_valid({r}) THEN json_type({r}) = 'OBJECT' "
            f"AND json_keys({r}) = ['ratings'] ELSE FALSE END) AND regexp_full_match({r}, {lit(SHAPE)}), FALSE)")


ORACLES["valid_responses"] = f"""WITH {views('raw_responses')}
SELECT doc_id, {response_ok('response')} AS valid FROM raw_responses"""

THRESHOLDS = ["A*", "A", "B", "C"]
VTYPES = ["conf", "journals", "workshops", "informal", "phd", "books"]


def spec_errors(doc: str) -> str:
    t = lambda f: f"json_type({doc}, '$.{f}')"
    els = lambda f: f"json_type({doc}, '$.{f}[*]')"
    all_str = lambda f: f"coalesce(list_bool_and(list_transform({els(f)}, lambda x_: x_ = 'VARCHAR')), TRUE)"
    checks = []
    for f in ["search_word_groups", "inclusion_criteria", "year_min", "year_max"]:
        checks.append(f"CASE WHEN NOT list_contains(json_keys({doc}), '{f}') THEN 'missing:{f}' END")
    for f in ["study_name", "research_goal", "venue_rank_threshold"]:
        checks.append(f"CASE WHEN {t(f)} IS NOT NULL AND {t(f)} <> 'VARCHAR' THEN 'type:{f}' END")
    for f in ["research_questions", "inclusion_criteria", "accepted_venue_types", "manually_accepted_venue_codes"]:
        checks.append(f"CASE WHEN {t(f)} IS NOT NULL AND ({t(f)} <> 'ARRAY' OR NOT {all_str(f)}) THEN 'type:{f}' END")
    g = "search_word_groups"
    inner_ok = (f"coalesce(list_bool_and(list_transform({els(g)}, lambda x_: x_ = 'ARRAY')), TRUE) AND "
                f"coalesce(list_bool_and(list_transform(json_type({doc}, '$.{g}[*][*]'), lambda x_: x_ = 'VARCHAR')), TRUE)")
    checks.append(f"CASE WHEN {t(g)} IS NOT NULL AND ({t(g)} <> 'ARRAY' OR NOT ({inner_ok})) THEN 'type:{g}' END")
    for f in ["year_min", "year_max"]:
        checks.append(f"CASE WHEN {t(f)} IS NOT NULL AND {t(f)} NOT IN ('UBIGINT', 'BIGINT') THEN 'type:{f}' END")
        checks.append(f"CASE WHEN {t(f)} = 'BIGINT' THEN 'minimum:{f}' END")
    checks.append(f"CASE WHEN {t('venue_rank_threshold')} = 'VARCHAR' AND json_extract_string({doc}, '$.venue_rank_threshold') "
                  f"NOT IN ({', '.join(lit(x) for x in THRESHOLDS)}) THEN 'enum:venue_rank_threshold' END")
    vt = "accepted_venue_types"
    checks.append(f"CASE WHEN {t(vt)} = 'ARRAY' AND {all_str(vt)} AND len({els(vt)}) > 0 AND NOT coalesce(list_bool_and(list_transform("
                  f"json_extract_string({doc}, '$.{vt}[*]'), lambda x_: x_ IN ({', '.join(lit(x) for x in VTYPES)}))), TRUE) "
                  f"THEN 'enum:{vt}' END")
    errs = f"list_sort(list_filter([{', '.join(checks)}], lambda e_: e_ IS NOT NULL))"
    return (f"(CASE WHEN NOT json_valid({doc}) THEN ['invalid_json'] WHEN json_type({doc}) <> 'OBJECT' THEN ['not_object'] "
            f"ELSE {errs} END)")


ORACLES["validate_studies"] = f"""WITH {views('spec_docs')}
SELECT doc_id, len(e) = 0 AS valid, array_to_string(e, ';') AS errors
FROM (SELECT doc_id, {spec_errors('doc')} AS e FROM spec_docs)"""


# --- review pipeline ------------------------------------------------------------------
def norm_title(x: str) -> str:
    return f"lower({strip(f'regexp_replace({x}, {lit(WS + chr(43))}, {lit(chr(32))}, {lit(chr(103))})')})"


def studies_values() -> str:
    rows = []
    for i, s in enumerate(fixtures.REVIEW_SPECS, start=1):
        rows.append(f"(CAST({i} AS BIGINT), {lit(s.get('study_name'))}, {lit(s.get('inclusion_criteria') or [])}::VARCHAR[])")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(study_id, study_name, inclusion_criteria)"


def cand_union(with_parts: bool = False) -> str:
    parts = []
    for i in range(1, len(fixtures.REVIEW_SPECS) + 1):
        parts.append(f"SELECT CAST({i} AS BIGINT) AS study_id, bib.*, string_split(key, '/') AS parts FROM bib WHERE {candidates_where(i)}")
    return " UNION ALL ".join(parts)


def gate_case() -> str:
    return "(CASE study_id " + " ".join(f"WHEN {i} THEN {gate_sql(i)}" for i in range(1, len(fixtures.REVIEW_SPECS) + 1)) + " END)"


HEAD = ("Assume you are a software engineering researcher conducting a systematic literature review (SLR). \n"
        "Consider the title and abstract of a primary study.\n"
        "Using a 1-7 Likert scale (1 - Strongly disagree, 2 - Disagree, 3 - Somewhat disagree, "
        "4 - Neither agree nor disagree, 5 - Somewhat agree, 6 - Agree, and 7 - Strongly agree) "
        "rate your agreement with each of the following statements:\n\n")
TAIL = ("\n\nYour should only provide a RFC8259 compliant JSON response following this format without deviation:\n"
        '{\n    "ratings": [\n        "2",\n        "4",\n        "1",\n        ...\n    ]\n}\n\n'
        "Lastly, keep the same order in your ratings as the order of the provided statements.")
RATINGS = ["1", "2", "3", "4", "5", "6", "7"]


def review_ctes() -> str:
    """CTEs of a whole review run: studies, cands, dim, gated, papers, wide,
    contents, metrics, requests, responses, rated, assessments, reports, summary."""
    usable = (f"(ratings IS NOT NULL AND len(list_filter(ratings, lambda x_: x_ NOT IN ({', '.join(lit(r) for r in RATINGS)}))) = 0 "
              f"AND len(ratings) <= len(inclusion_criteria))")
    ex = extract("lp.final_url", "lp.html")
    return f"""{views('bib', 'rank_html', 'title_index', 'meta', 'landing', 'responses')},
studies AS ({studies_values()}),
cands AS ({cand_union()}),
dim AS {dim_cte()},
ranked AS (SELECT c.*, coalesce(dim.venue_rank, 'MISSING') AS venue_rank
           FROM (SELECT * FROM cands WHERE len(parts) = 3) c LEFT JOIN dim
             ON dim.kind = CASE parts[1] WHEN 'conf' THEN 'conference' WHEN 'journals' THEN 'journal' END
            AND dim.lkey = lower(parts[2])),
gated AS (SELECT *, {gate_case()} AS passed_gate FROM ranked),
ix AS (SELECT {norm_title('title')} AS t,
         arg_min({{'ss': semantic_scholar_id, 'doi': doi}}, (hit_rank, coalesce(semantic_scholar_id, ''), coalesce(doi, ''))) AS hit
       FROM title_index GROUP BY 1),
acc0 AS (SELECT *, nullif(regexp_extract(ee, '{DOI}', 0), '') AS doi0 FROM gated WHERE passed_gate),
papers AS (SELECT a.study_id, a.rec_id,
             CASE WHEN a.doi0 IS NULL THEN ix.hit.doi ELSE a.doi0 END AS doi,
             CASE WHEN a.doi0 IS NULL THEN ix.hit.ss END AS semantic_scholar_id,
             a.title, a.year, a.parts[1] AS venue_type, a.parts[2] AS venue_code, a.parts[3] AS venue_key,
             a.venue_rank, a.ee AS publisher_source
           FROM acc0 a LEFT JOIN ix ON a.doi0 IS NULL AND ix.t = {norm_title('a.title')}),
wide AS (SELECT p.*,
           CASE WHEN p.semantic_scholar_id IS NOT NULL THEN ms.semantic_scholar_id ELSE md.semantic_scholar_id END AS meta_id,
           CASE WHEN p.semantic_scholar_id IS NOT NULL THEN ms.tldr ELSE md.tldr END AS m_tldr,
           CASE WHEN p.semantic_scholar_id IS NOT NULL THEN ms.abstract ELSE md.abstract END AS m_abstract,
           CASE WHEN p.semantic_scholar_id IS NOT NULL THEN ms.is_open_access ELSE md.is_open_access END AS m_oa,
           CASE WHEN p.semantic_scholar_id IS NOT NULL THEN ms.pdf_url ELSE md.pdf_url END AS m_pdf,
           CASE WHEN p.semantic_scholar_id IS NOT NULL THEN ms.citations ELSE md.citations END AS m_cit,
           CASE WHEN p.semantic_scholar_id IS NOT NULL THEN ms.influential_citations ELSE md.influential_citations END AS m_infl
         FROM papers p
         LEFT JOIN meta ms ON ms.semantic_scholar_id = p.semantic_scholar_id
         LEFT JOIN meta md ON p.semantic_scholar_id IS NULL AND md.doi = p.doi),
all_papers AS (SELECT study_id, rec_id, doi, semantic_scholar_id, title, year, venue_type, venue_code, venue_key,
                 venue_rank, publisher_source,
                 CASE WHEN m_oa AND coalesce(m_pdf, '') <> '' THEN m_pdf END AS pdf_source FROM wide),
contents AS (SELECT w.study_id, w.rec_id, nullif(w.m_tldr, '') AS tldr,
               CASE WHEN coalesce(w.m_abstract, '') = '' THEN {ex} ELSE w.m_abstract END AS abstract
             FROM wide w LEFT JOIN landing lp ON coalesce(w.m_abstract, '') = '' AND lp.url = w.publisher_source
             WHERE w.meta_id IS NOT NULL),
metrics AS (SELECT study_id, rec_id, m_cit AS citations, m_infl AS influential_citations FROM wide WHERE meta_id IS NOT NULL),
requests AS (SELECT w.study_id, w.rec_id, w.meta_id,
               {lit(HEAD)} || array_to_string(list_transform(s.inclusion_criteria, lambda c_, i_: CAST(i_ AS VARCHAR) || '. ' || c_), chr(10)) || {lit(TAIL)} AS system_prompt,
               'tldr:' || chr(10) || coalesce(c.tldr, 'None') || chr(10) || chr(10) || 'abstract:' || chr(10) || coalesce(c.abstract, 'None') || chr(10) AS user_content
             FROM wide w LEFT JOIN contents c ON c.study_id = w.study_id AND c.rec_id = w.rec_id
             JOIN studies s ON s.study_id = w.study_id),
answers AS (SELECT r.study_id, r.rec_id, l.response FROM requests r JOIN responses l ON CAST(l.doc_id AS VARCHAR) = r.meta_id),
rated AS (SELECT r.study_id, r.rec_id, s.inclusion_criteria,
            CASE WHEN {response_ok('r.response')} THEN json_extract_string(r.response, '$.ratings[*]') END AS ratings
          FROM answers r JOIN studies s ON s.study_id = r.study_id),
usable AS (SELECT * FROM rated WHERE {usable}),
assessments AS (SELECT study_id, rec_id, CAST(i AS INTEGER) AS pos, inclusion_criteria[i] AS criteria,
                  CAST(v AS INTEGER) AS rating, {likert('CAST(v AS INTEGER)')} AS label
                FROM (SELECT study_id, rec_id, inclusion_criteria, unnest(ratings) AS v, generate_subscripts(ratings, 1) AS i FROM usable)),
reports AS (SELECT p.study_id, p.rec_id,
              CASE WHEN u.ratings IS NOT NULL AND len(u.ratings) > 0
                   THEN len(u.ratings) = len(u.inclusion_criteria)
                        AND len(list_filter(u.ratings, lambda x_: CAST(x_ AS INTEGER) < 5)) = 0 END AS passed_criteria
            FROM all_papers p LEFT JOIN usable u ON u.study_id = p.study_id AND u.rec_id = p.rec_id),
summary AS (SELECT s.study_id, s.study_name, DATE '{fixtures.RUN_DATE}' AS study_date, '{fixtures.DUMP_NAME}' AS dblp_used,
              CAST(coalesce(c.n, 0) AS INTEGER) AS papers_collected, CAST(coalesce(d.n, 0) AS INTEGER) AS reports_collected,
              CAST(NULL AS INTEGER) AS total_tokens_used_llm, CAST(0.0 AS DOUBLE) AS total_runtime
            FROM studies s
            LEFT JOIN (SELECT study_id, count(*) AS n FROM cands GROUP BY 1) c ON c.study_id = s.study_id
            LEFT JOIN (SELECT study_id, count(*) AS n FROM reports r
                       WHERE EXISTS (SELECT 1 FROM assessments a WHERE a.study_id = r.study_id AND a.rec_id = r.rec_id)
                       GROUP BY 1) d ON d.study_id = s.study_id)"""


def R(select: str) -> str:
    return f"WITH {review_ctes()}\n{select}"


PAPER_COLS = ("study_id, rec_id, doi, semantic_scholar_id, title, year, venue_type, venue_code, venue_key, "
              "venue_rank, publisher_source, pdf_source")

ORACLES["all_papers"] = R(f"SELECT {PAPER_COLS} FROM all_papers")
ORACLES["write_papers"] = ORACLES["all_papers"]
ORACLES["study_summary"] = R("SELECT * FROM summary")
ORACLES["study_by_id"] = R("SELECT * FROM summary WHERE study_id = 3")
ORACLES["studies_of_date"] = R(f"SELECT * FROM summary WHERE study_date = DATE '{fixtures.RUN_DATE}'")
ORACLES["study_lines"] = R("SELECT study_id, 'Date ' || CAST(study_date AS VARCHAR) || ' | ID: ' || CAST(study_id AS VARCHAR) "
                           "|| ' | Papers: ' || CAST(papers_collected AS VARCHAR) || ' | Reports: ' || "
                           "CAST(reports_collected AS VARCHAR) AS line FROM summary")
ORACLES["study_papers"] = R(f"SELECT {PAPER_COLS} FROM all_papers WHERE study_id = 2")
ORACLES["pdf_links"] = R("SELECT study_id, rec_id, 'Paper Title: ' || coalesce(title, 'None') || ' | Link: ' || "
                         "CASE WHEN coalesce(pdf_source, '') <> '' THEN pdf_source ELSE coalesce(publisher_source, 'None') END AS line "
                         "FROM all_papers WHERE study_id = 1")
ORACLES["passed_papers"] = R("SELECT study_id, rec_id, title FROM all_papers p WHERE study_id = 1 AND EXISTS "
                             "(SELECT 1 FROM reports r WHERE r.study_id = 1 AND r.rec_id = p.rec_id AND r.passed_criteria)")
ORACLES["study_reports"] = R("SELECT study_id, rec_id, passed_criteria FROM reports WHERE study_id = 1")
_FIRST = "(SELECT min(rec_id) FROM assessments WHERE study_id = 1)"
ORACLES["paper_report"] = R(f"SELECT study_id, rec_id, passed_criteria FROM reports WHERE study_id = 1 AND rec_id = {_FIRST}")
ORACLES["report_assessments"] = R(f"SELECT * FROM assessments WHERE study_id = 1 AND rec_id = {_FIRST}")
ORACLES["criteria_assessments"] = R("SELECT * FROM assessments")
ORACLES["assessment_requests"] = R("SELECT study_id, rec_id, system_prompt, user_content FROM requests")
ORACLES["table_stats"] = R(
    "SELECT 'studies' AS table_name, count(*) AS entries, 'study_id,study_name,study_date,dblp_used,papers_collected,"
    "reports_collected,total_tokens_used_llm,total_runtime' AS attributes FROM summary "
    f"UNION ALL SELECT 'papers', count(*), '{PAPER_COLS.replace(' ', '')}' FROM all_papers "
    "UNION ALL SELECT 'reports', count(*), 'study_id,rec_id,passed_criteria' FROM reports "
    "UNION ALL SELECT 'contents', count(*), 'study_id,rec_id,tldr,abstract' FROM contents "
    "UNION ALL SELECT 'metrics', count(*), 'study_id,rec_id,citations,influential_citations,paper_length' FROM metrics "
    "UNION ALL SELECT 'criteria_assessments', count(*), 'study_id,rec_id,pos,criteria,rating,label' FROM assessments")

_PILOTS = f"pilots AS ({fixtures.duckdb_view_sql('pilots')})"
ORACLES["recall_found"] = f"WITH {review_ctes()}, {_PILOTS}\nSELECT * FROM pilots WHERE doi IN (SELECT doi FROM all_papers)"
ORACLES["recall_missing"] = (f"WITH {review_ctes()}, {_PILOTS}\nSELECT * FROM pilots "
                             "WHERE doi NOT IN (SELECT doi FROM all_papers WHERE doi IS NOT NULL)")
ORACLES["recall"] = (f"WITH {review_ctes()}, {_PILOTS}\nSELECT count(*) AS pilots, CAST(count_if(f) AS BIGINT) AS found, "
                     "round(avg(CAST(f AS DOUBLE)), 6) AS recall FROM (SELECT doi IN (SELECT doi FROM all_papers "
                     "WHERE doi IS NOT NULL) AS f FROM pilots)")
ORACLES["commit_runs"] = R(f"SELECT {PAPER_COLS} FROM all_papers WHERE study_id <> 2 UNION ALL "
                           f"SELECT * REPLACE (CAST(5 AS BIGINT) AS study_id) FROM (SELECT {PAPER_COLS} FROM all_papers WHERE study_id = 3)")


def _csv_field(c: str) -> str:
    x = f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


ORACLES["export_csv"] = R("SELECT DISTINCT study_id, '" + PAPER_COLS.replace(" ", "") + "' AS line FROM all_papers UNION ALL "
                          "SELECT study_id, " + " || ',' || ".join(_csv_field(c) for c in PAPER_COLS.split(", ")) + " FROM all_papers")
ORACLES["csv_roundtrip"] = R("SELECT coalesce(doi, '') AS doi FROM all_papers WHERE study_id = 1")

ORACLES["prisma_flow"] = R("""SELECT s.study_id,
  CAST(g.total AS BIGINT) AS total_papers_collected, CAST(g.dup AS BIGINT) AS duplicate_records_removed,
  CAST(coalesce(p.aux, 0) AS BIGINT) AS records_refused_by_aux_filters,
  CAST(g.total - g.dup - coalesce(p.aux, 0) - coalesce(p.screened, 0) AS BIGINT) AS records_refused_by_automated_filters,
  CAST(coalesce(p.screened, 0) AS BIGINT) AS records_screened, CAST(0 AS BIGINT) AS records_excluded_manually,
  CAST(coalesce(p.failed, 0) AS BIGINT) AS records_excluded_automatically,
  CAST(coalesce(p.screened, 0) AS BIGINT) AS report_construction_attempts,
  CAST(coalesce(p.no_text, 0) AS BIGINT) AS report_construction_failures,
  CAST(coalesce(p.resp, 0) AS BIGINT) AS report_assessment_attempts,
  CAST(coalesce(p.failed, 0) AS BIGINT) AS report_assessment_exclusions,
  CAST(coalesce(l.n, 0) AS BIGINT) AS report_assessment_exclusion_summaries
FROM studies s
CROSS JOIN (SELECT count(*) AS total, count_if(is_dup) AS dup FROM dups) g
LEFT JOIN (
  SELECT f.study_id, count_if(f.passed_gate) AS screened, count_if(NOT f.passed_gate) AS aux,
    count_if(f.passed_gate AND EXISTS (SELECT 1 FROM reports r WHERE r.study_id = f.study_id AND r.rec_id = f.rec_id AND r.passed_criteria = FALSE)) AS failed,
    count_if(f.passed_gate AND NOT EXISTS (SELECT 1 FROM contents c WHERE c.study_id = f.study_id AND c.rec_id = f.rec_id
                                             AND (coalesce(c.tldr, '') <> '' OR coalesce(c.abstract, '') <> ''))) AS no_text,
    count_if(f.passed_gate AND EXISTS (SELECT 1 FROM answers x WHERE x.study_id = f.study_id AND x.rec_id = f.rec_id)) AS resp
  FROM flagged f GROUP BY 1) p ON p.study_id = s.study_id
LEFT JOIN (SELECT a.study_id, count(DISTINCT a.criteria) AS n FROM assessments a
           JOIN flagged f ON f.study_id = a.study_id AND f.rec_id = a.rec_id AND f.passed_gate
           WHERE a.rating < 5 GROUP BY 1) l ON l.study_id = s.study_id""").replace(
    "\nSELECT s.study_id,", """,
recs AS (SELECT rec_id, ord, nullif(regexp_extract(ee, '""" + DOI + """', 0), '') AS doi FROM bib),
firsts AS (SELECT doi, min(ord) AS f FROM recs WHERE doi IS NOT NULL GROUP BY doi),
dups AS (SELECT r.rec_id, coalesce(r.doi IS NOT NULL AND r.ord > fi.f, FALSE) AS is_dup FROM recs r LEFT JOIN firsts fi ON fi.doi = r.doi),
flagged AS (SELECT g.study_id, g.rec_id, g.passed_gate FROM gated g JOIN dups d ON d.rec_id = g.rec_id WHERE NOT d.is_dup)
SELECT s.study_id,""", 1)

# --- single-study enrichment ------------------------------------------------------------
ORACLES["screen_many"] = R("SELECT study_id, rec_id, nullif(regexp_extract(ee, '" + DOI + "', 0), '') AS doi, "
                           "CAST(NULL AS VARCHAR) AS semantic_scholar_id, title, year, parts[1] AS venue_type, "
                           "parts[2] AS venue_code, parts[3] AS venue_key, venue_rank, ee AS publisher_source, "
                           "CAST(NULL AS VARCHAR) AS pdf_source FROM gated WHERE passed_gate")

ORACLES["screen_indexed"] = ORACLES["screen_many"]
ORACLES["screen_part_studies"] = f"""WITH {views('bib', 'rank_html', 'part_studies', 'part_allow')},
dim AS {dim_cte()},
queries AS (SELECT DISTINCT w1, w2, w3, {groups_query('[[w1, w2], [w3]]')} AS q FROM part_studies),
titles AS (SELECT DISTINCT title FROM bib),
hits AS (SELECT w1, w2, w3, title FROM queries, titles WHERE {cnf('title', 'q')}),
cands AS (SELECT s.*, b.rec_id, b.key, string_split(b.key, '/') AS parts FROM part_studies s
          JOIN hits h ON h.w1 = s.w1 AND h.w2 = s.w2 AND h.w3 = s.w3
          JOIN bib b ON b.title = h.title AND b.year BETWEEN s.year_min AND s.year_max AND starts_with(b.key, s.venue_type)),
ranked AS (SELECT c.*, coalesce(dim.venue_rank, 'MISSING') AS venue_rank
           FROM (SELECT * FROM cands WHERE len(parts) = 3) c LEFT JOIN dim
             ON dim.kind = CASE parts[1] WHEN 'conf' THEN 'conference' WHEN 'journals' THEN 'journal' END
            AND dim.lkey = lower(parts[2]))
SELECT study_id, rec_id, venue_rank FROM ranked r
WHERE list_position({lit(RANKS)}, venue_rank) <= CASE venue_rank_threshold WHEN 'A*' THEN 2 WHEN 'B' THEN 4 ELSE 5 END
   OR EXISTS (SELECT 1 FROM part_allow a WHERE a.study_id = r.study_id AND starts_with(r.key, a.prefix))"""


def _ix() -> str:
    return f"""ix AS (SELECT {norm_title('title')} AS t,
         arg_min({{'ss': semantic_scholar_id, 'doi': doi}}, (hit_rank, coalesce(semantic_scholar_id, ''), coalesce(doi, ''))) AS hit
       FROM title_index GROUP BY 1)"""


def _resolved(i: int) -> str:
    return f"""{ranked_candidates(i)},
{_ix()},
resolved AS (SELECT r.*, CASE WHEN r.doi0 IS NULL THEN ix.hit.doi ELSE r.doi0 END AS doi,
               CASE WHEN r.doi0 IS NULL THEN ix.hit.ss END AS semantic_scholar_id
             FROM (SELECT *, nullif(regexp_extract(ee, '{DOI}', 0), '') AS doi0 FROM ranked) r
             LEFT JOIN ix ON r.doi0 IS NULL AND ix.t = {norm_title('r.title')})"""


ORACLES["resolve_ids"] = f"""WITH {views('bib', 'rank_html', 'title_index')},
{_resolved(2)}
SELECT rec_id, doi, semantic_scholar_id FROM resolved"""


def _title_words(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w_: w_ <> '')))"


# every pair of word sets with a common word is scored; no filter
ORACLES["resolve_ids_ranked"] = f"""WITH {views('cited', 'title_index')},
q AS (SELECT DISTINCT {_title_words('title')} AS k FROM cited WHERE doi IS NULL),
x AS (SELECT k, arg_min({{'ss': semantic_scholar_id, 'doi': doi, 'r': hit_rank}}, {{'r': hit_rank, 'ss': semantic_scholar_id, 'doi': coalesce(doi, '')}}) AS hit
      FROM (SELECT {_title_words('title')} AS k, * FROM title_index) WHERE len(k) > 0 GROUP BY k),
n AS (SELECT count(*) AS n FROM x),
xw AS (SELECT k, unnest(k) AS word FROM x),
qw AS (SELECT k, unnest(k) AS word FROM q),
df AS (SELECT word, count(*) AS df FROM xw GROUP BY word),
wt AS (SELECT word, CAST(floor(1000.0 * ln(1.0 + n / coalesce(df, 1))) AS BIGINT) AS w
       FROM (SELECT DISTINCT word FROM (SELECT word FROM xw UNION ALL SELECT word FROM qw)) LEFT JOIN df USING (word), n),
xt AS (SELECT k, sum(w) AS total FROM xw JOIN wt USING (word) GROUP BY k),
qt AS (SELECT k, sum(w) AS total FROM qw JOIN wt USING (word) GROUP BY k),
common AS (SELECT a.k AS qk, b.k AS xk, sum(w) AS both_ FROM qw a JOIN xw b USING (word) JOIN wt USING (word) GROUP BY ALL),
scored AS (SELECT qk, xk, CAST(floor(both_ * 1000000 / (qt.total + xt.total - both_)) AS BIGINT) AS score
           FROM common JOIN qt ON qt.k = qk JOIN xt ON xt.k = xk WHERE both_ * 1000000 >= (qt.total + xt.total - both_) * 500000),
best AS (SELECT qk, arg_min({{'ss': hit.ss, 'doi': hit.doi, 'score': score}}, {{'s': -score, 'r': hit.r, 'ss': hit.ss, 'doi': coalesce(hit.doi, '')}}) AS b
         FROM scored JOIN x ON x.k = xk GROUP BY qk)
SELECT rec_id, CASE WHEN b IS NOT NULL THEN b.doi ELSE doi END AS doi, b.ss AS semantic_scholar_id, b.score AS title_score
FROM cited LEFT JOIN best ON doi IS NULL AND qk = {_title_words('title')}"""


def _screen1_enriched() -> str:
    return f"""{views('bib', 'rank_html', 'meta', 'landing')},
{ranked_candidates(1)},
p AS ({paper_select(1)} FROM ranked WHERE {gate_sql(1)}),
w AS (SELECT p.rec_id, p.doi, p.publisher_source, md.semantic_scholar_id AS meta_id, md.tldr AS m_tldr, md.abstract AS m_abstract,
        CASE WHEN md.is_open_access AND coalesce(md.pdf_url, '') <> '' THEN md.pdf_url END AS pdf_source,
        md.citations, md.influential_citations
      FROM p LEFT JOIN meta md ON md.doi = p.doi)"""


ORACLES["enrich_papers"] = f"""WITH {_screen1_enriched()}
SELECT rec_id, doi, pdf_source, nullif(m_tldr, '') AS tldr, nullif(m_abstract, '') AS abstract FROM w"""

ORACLES["paper_metrics"] = f"""WITH {_screen1_enriched()}
SELECT rec_id, citations, influential_citations FROM w WHERE meta_id IS NOT NULL"""

ORACLES["abstract_coalesce"] = f"""WITH {_screen1_enriched()}
SELECT w.rec_id, CASE WHEN coalesce(w.m_abstract, '') = '' THEN {extract('lp.final_url', 'lp.html')} ELSE w.m_abstract END AS abstract
FROM w LEFT JOIN landing lp ON coalesce(w.m_abstract, '') = '' AND lp.url = w.publisher_source
WHERE w.meta_id IS NOT NULL"""

ORACLES["match_known_papers"] = f"""WITH {views('bib', 'rank_html', 'title_index')},
{_resolved(2)},
{ranked_candidates(1).replace('cand AS', 'cand_s AS').replace('split AS', 'split_s AS').replace('dim AS', 'dim_s AS').replace('ranked AS', 'ranked_s AS').replace('FROM cand ', 'FROM cand_s ').replace('FROM split LEFT JOIN dim', 'FROM split_s AS split LEFT JOIN dim_s AS dim')},
stored AS ({paper_select(1)} FROM ranked_s WHERE {gate_sql(1)}),
sd AS (SELECT doi AS k, arg_min({{'rec_id': rec_id, 'doi': doi, 'title': title, 'venue_rank': venue_rank}}, rec_id) AS s
       FROM stored WHERE doi IS NOT NULL GROUP BY 1),
ss AS (SELECT semantic_scholar_id AS k, arg_min({{'rec_id': rec_id, 'doi': doi, 'title': title, 'venue_rank': venue_rank}}, rec_id) AS s
       FROM stored WHERE semantic_scholar_id IS NOT NULL GROUP BY 1)
SELECT r.rec_id AS incoming_id,
  CASE WHEN sd.s IS NOT NULL THEN sd.s.rec_id WHEN ss.s IS NOT NULL THEN ss.s.rec_id ELSE r.rec_id END AS rec_id,
  CASE WHEN sd.s IS NOT NULL THEN sd.s.doi WHEN ss.s IS NOT NULL THEN ss.s.doi ELSE r.doi END AS doi,
  CASE WHEN sd.s IS NOT NULL THEN sd.s.title WHEN ss.s IS NOT NULL THEN ss.s.title ELSE r.title END AS title,
  CASE WHEN sd.s IS NOT NULL THEN sd.s.venue_rank WHEN ss.s IS NOT NULL THEN ss.s.venue_rank ELSE r.venue_rank END AS venue_rank,
  (sd.s IS NOT NULL OR ss.s IS NOT NULL) AS known
FROM resolved r LEFT JOIN sd ON sd.k = r.doi LEFT JOIN ss ON r.doi IS NULL AND ss.k = r.semantic_scholar_id"""

ORACLES["ingest_records"] = f"""WITH {views('bib')}
SELECT key, title, year, ee FROM bib"""


# what is left and found, from the pieces the pages are made of
ORACLES["nested_markup"] = f"""WITH {views('nested')}
SELECT doc_id, a || 'inner' || b || 'tailh' || a || b || 'x' AS rest, trim(a || 'innerno' || b) AS abs,
       ';' || a || '|' || b || '|' || b || '|x;' || b AS cells FROM nested"""
ORACLES["ingest_varied"] = f"""WITH {views('bib')}
SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, key, title, year, ee FROM bib"""


def _typed(doc: str, f: str, kind: str) -> str:
    t = f"json_type({doc}, '$.{f}')"
    if kind == "str":
        return f"CASE WHEN {t} = 'VARCHAR' THEN json_extract_string({doc}, '$.{f}') END AS {f}"
    if kind == "int":
        return f"CASE WHEN {t} IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract({doc}, '$.{f}') AS BIGINT) END AS {f}"
    if kind == "list":
        return (f"CAST(to_json(CASE WHEN {t} = 'ARRAY' AND coalesce(list_bool_and(list_transform(json_type({doc}, '$.{f}[*]'), "
                f"lambda x_: x_ = 'VARCHAR')), TRUE) THEN json_extract_string({doc}, '$.{f}[*]') END) AS VARCHAR) AS {f}")
    return (f"CAST(to_json(CASE WHEN {t} = 'ARRAY' THEN list_transform(CAST(json_extract({doc}, '$.{f}') AS JSON[]), "
            f"lambda g_: json_extract_string(g_, '$[*]')) END) AS VARCHAR) AS {f}")


# S2: spec documents loaded with the spec schema; a field of the wrong JSON
# type reads as NULL, the others keep their values
ORACLES["load_study"] = f"""WITH {views('spec_docs')}
SELECT doc_id AS study_id, {_typed('doc', 'study_name', 'str')}, {_typed('doc', 'research_goal', 'str')},
  {_typed('doc', 'research_questions', 'list')}, {_typed('doc', 'inclusion_criteria', 'list')},
  {_typed('doc', 'year_min', 'int')}, {_typed('doc', 'year_max', 'int')},
  {_typed('doc', 'search_word_groups', 'groups')}, {_typed('doc', 'venue_rank_threshold', 'str')},
  {_typed('doc', 'accepted_venue_types', 'list')}, {_typed('doc', 'manually_accepted_venue_codes', 'list')}
FROM spec_docs"""
