"""The rule tables and retrieval steps as portable SQL text, for the checks in queries.py."""

from __future__ import annotations

import re

from plumbline.functions import rules
from plumbline.operators import evidence

_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
SPACE = "E' \\t\\r\\n\\f\\x0b'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bounded(pattern: str) -> str:
    """Word boundaries at the ends of alternatives as classes that hold for all letters."""
    return re.sub(r"\\b($|\|)", lambda m: _AFTER + m[1], re.sub(r"(^|\|)\\b", lambda m: m[1] + _BEFORE, pattern))


def any_pattern(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted('(?i)' + bounded(p))})" for p in patterns) + ")"


def any_phrase(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p.lower())})" for p in phrases) + ")"


def values(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def found(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, {group})"


def title(x: str) -> str:
    return f"array_to_string([upper(w_[1]) || lower(w_[2:]) FOR w_ IN string_split({x}, ' ')], ' ')"


#: First and last pages of a query's page ranges, as lists of equal length.
_LOW, _HIGH = (found("query", "(?i)" + rules.LOCATION[2], g) for g in (1, 2))
ROUTED = f"""routed AS (SELECT *, CASE WHEN len(pages) > 0 THEN 'location' WHEN pointer OR closed OR covers THEN 'coverage' ELSE 'semantic' END AS intent,
    CASE WHEN len(pages) > 0 THEN NULL WHEN pointer THEN 'pointer' WHEN closed THEN 'list' WHEN covers THEN CASE WHEN numeric_ THEN 'numeric_list' WHEN listed THEN 'list' WHEN attribute THEN 'attribute' ELSE 'list' END END AS coverage_type,
    CASE WHEN len(pages) = 0 AND NOT pointer AND closed THEN 'closed' END AS status_filter, notes_or_events AND NOT explicit_note AS filters_tables
    FROM (SELECT *, {any_pattern("query", rules.POINTER_TERMS)} AS pointer, {any_pattern("query", rules.CLOSED_TERMS)} AS closed, {any_pattern("query", rules.COVERAGE_TERMS + rules.ATTRIBUTE_TERMS)} AS covers,
        {any_pattern("query", [r"\bitems of note\b"])} AND {any_pattern("query", [r"\bnet income\b", r"\baggregate impact\b", r"\baggregate\b"])} AS numeric_, {any_pattern("query", rules.LIST_TERMS)} AS listed, {any_pattern("query", rules.ATTRIBUTE_TERMS)} AS attribute,
        CASE {" ".join(f"WHEN {any_pattern('query', [p])} THEN {quoted(label)}" for label, p, _ in rules.SECTION_TARGETS)} END AS target, {any_pattern("query", rules.LITIGATION_TERMS)} AS litigation,
        {any_pattern("query", rules.EXPLICIT_NOTE)} AS explicit_note, {any_pattern("query", [r"\bitems of note\b", r"\bsignificant events\b"])} AS notes_or_events,
        query || {quoted(" " + " ".join(rules.EXPANSION))} AS expanded,
        list_sort(list_distinct(list_filter(list_concat({", ".join(f"[TRY_CAST(x AS INTEGER) FOR x IN {found('query', '(?i)' + p, 1)}]" for p in rules.LOCATION[:2])},
            flatten(list_transform(list_zip({_LOW}, {_HIGH}), lambda z: generate_series(TRY_CAST(z[1] AS INTEGER), TRY_CAST(z[2] AS INTEGER))))), lambda p: p IS NOT NULL))) AS pages
        FROM queries))"""
IMPACTS = f"len({found('text_content', rules.IMPACT, 0)})"
FLAGS = f"""flagged AS (SELECT *, {any_phrase("l", rules.FRONT_MATTER)} AS front_matter, {any_phrase("l", rules.AGGREGATE)} AS aggregate_phrase, {any_phrase("l", rules.POSITIVE)} AS positive, {any_phrase("l", rules.NEGATIVE)} AS negative,
    {any_phrase("l", rules.REFERENCE_ONLY)} AND NOT (impacts >= 2 OR {any_phrase("l", rules.AGGREGATE)}) AS reference_only, {any_phrase("l", rules.ADJUSTED)} AND ({any_phrase("l", rules.RATIO_TERMS)} OR NOT signal) AS adjusted_definition,
    regexp_matches(l, '\\bnote\\s+\\d+\\b') AND NOT regexp_matches(l, 'items of note\\s+\\d+') AS other_note
    FROM (SELECT *, contains(l, 'items of note') OR contains(l, 'specified items') OR contains(l, 'reconciliation') AND contains(l, 'net income') OR contains(l, 'impact on reported net income') AS signal
        FROM (SELECT *, {IMPACTS}::INTEGER AS impacts, lower(concat_ws(' ', heading_path, section_id, text_content)) AS l FROM chunks)))"""


def reasons(numeric: str, free: str) -> str:
    """The list of reasons against a flagged chunk as an items-of-note anchor."""
    checks = [
        ("reject_chunk_type", "chunk_type NOT IN ('narrative', 'heading') OR text_content LIKE '[TABLE]%'"),
        ("missing_positive_phrase", "NOT positive"),
        ("front_matter_reference", f"{numeric} AND front_matter"),
        ("reject_adjusted_measures_definition", f"{numeric} AND adjusted_definition"),
        ("missing_reconciliation_signal", f"{numeric} AND NOT signal"),
        ("reject_reconciliation_reference_only", f"{numeric} AND reference_only"),
        ("missing_itemization_or_aggregate", f"{numeric} AND NOT (impacts >= 2 OR aggregate_phrase)"),
        ("negative_phrase", f"{free} AND negative"),
        ("negative_note_reference", f"{free} AND other_note"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quoted(name)} END" for name, c in checks) + "], lambda r: r IS NOT NULL)"


def terms(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda t: t <> '')"


def bm25(p: str, chunks: str, asked: str) -> str:
    """CTEs {p}scored (query_id, doc_id, chunk_id, score) of chunks and asked (query_id, doc_id, query)."""
    return f"""{p}postings AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, unnest({terms("text_content")}) AS term FROM {chunks}) GROUP BY ALL),
{p}sizes AS (SELECT doc_id, chunk_id, len({terms("text_content")}) AS n_terms FROM {chunks}),
{p}docs_ AS (SELECT doc_id, count(*) AS n, avg(n_terms) AS avg_len FROM {p}sizes GROUP BY doc_id),
{p}raw_idf AS (SELECT p.doc_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {p}postings p JOIN {p}docs_ USING (doc_id) GROUP BY p.doc_id, term),
{p}idf AS (SELECT doc_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY doc_id) ELSE raw END AS idf FROM {p}raw_idf),
{scored(p, p, asked)}"""


def scored(p: str, index: str, asked: str) -> str:
    return f"""{p}asked AS (SELECT query_id, doc_id, term, count(*) AS times FROM (SELECT query_id, doc_id, unnest({terms("query")}) AS term FROM {asked}) GROUP BY ALL),
{p}scored AS (SELECT query_id, a.doc_id, p.chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / avg_len))), 6) AS score
    FROM {p}asked a JOIN {index}postings p USING (doc_id, term) JOIN {index}idf USING (doc_id, term) JOIN {index}sizes s ON s.doc_id = a.doc_id AND s.chunk_id = p.chunk_id JOIN {index}docs_ d ON d.doc_id = a.doc_id GROUP BY ALL)"""


def lexical(p: str, index: str, asked: str, k: int) -> str:
    return f"""{p}lexical AS (SELECT * FROM (SELECT q.query_id, q.doc_id, s.chunk_id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(score, 0.0) DESC, s.chunk_id) AS rank
    FROM {asked} q JOIN {index}sizes s USING (doc_id) LEFT JOIN {p}scored x ON x.query_id = q.query_id AND x.chunk_id = s.chunk_id) WHERE rank <= {k})"""


def nearest(p: str, asked: str, k: int, where: str = "true") -> str:
    return f"{p}vtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vscored WHERE query_id IN (SELECT query_id FROM {asked}) AND {where}) WHERE rank <= {k})"


def fused(p: str, k: int) -> str:
    score = "round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 9)"
    return f"""{p}fused AS (SELECT * FROM (SELECT query_id, chunk_id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, v.rank NULLS LAST, l.rank NULLS LAST) AS rank
    FROM (SELECT query_id, chunk_id, rank FROM {p}vtop) v FULL JOIN (SELECT query_id, chunk_id, rank FROM {p}lexical) l USING (query_id, chunk_id)) WHERE rank <= {k})"""


JOINED = "trim(regexp_replace(regexp_replace(text_content, '([0-9A-Za-z_])-\\s*\\n\\s*([0-9A-Za-z_])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"


def items(rows: str) -> str:
    """CTEs up to `items` (query_id, item_no, chunk_id, raw, display) of rows (query_id, rank, chunk_id, text_content)."""
    text = "t"
    cases = f"SELECT query_id, rank, chunk_id, 1 AS extractor, unnest({found(text, rules.CASE_NAME, 0)}) AS raw, unnest([{title('z_[1]')} || ' v. ' || {title('z_[2]')} FOR z_ IN list_zip({found(text, rules.CASE_NAME, 1)}, {found(text, rules.CASE_NAME, 2)})]) AS display, generate_subscripts({found(text, rules.CASE_NAME, 0)}, 1) AS position FROM joined_"
    every = "flatten([" + ", ".join(found(text, f"(?i){t}", 0) for t in rules.HEADING_TERMS) + "])"
    terms_ = f"SELECT query_id, rank, chunk_id, 2, unnest({every}), unnest([{title('x_')} FOR x_ IN {every}]), generate_subscripts({every}, 1) FROM joined_"
    matters = f"SELECT query_id, rank, chunk_id, 3, unnest({found(text, rules.MATTER, 0)}), unnest([{title('x_')} FOR x_ IN {found(text, rules.MATTER, 1)}]), generate_subscripts({found(text, rules.MATTER, 0)}, 1) FROM joined_"
    return f"""joined_ AS (SELECT query_id, rank, chunk_id, {JOINED} AS t FROM {rows}),
seen AS ({cases} UNION ALL {terms_} UNION ALL {matters}),
items AS (SELECT query_id, chunk_id, raw, display, row_number() OVER (PARTITION BY query_id ORDER BY rank, extractor, position) AS item_no
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(display) ORDER BY rank, extractor, position) AS nth FROM seen) WHERE nth = 1)"""


def fact_values(text: str) -> dict[str, str]:
    def part(pattern: str, group: int) -> str:
        return f"regexp_extract({text}, {quoted(pattern)}, {group})"

    def where(pattern: str, value: str) -> str:
        return f"CASE WHEN regexp_matches({text}, {quoted(pattern)}) THEN {value} END"

    return {
        "default_currency": where(rules.CURRENCY, f"concat_ws(' ', trim({part(rules.CURRENCY, 1)}, {SPACE}), trim({part(rules.CURRENCY, 2)}, {SPACE}))"),
        "units": where(rules.UNITS, f"lower({part(rules.UNITS, 1)})"),
        "accounting_framework": where(rules.FRAMEWORK, f"upper({part(rules.FRAMEWORK, 1)})"),
        "consolidation_basis": f"CASE WHEN contains(lower({text}), 'consolidated') THEN 'consolidated' END",
        "reporting_period": where(rules.PERIOD, part(rules.PERIOD, 1)),
    }


def facts() -> str:
    by_name = fact_values("text_content")
    first = "page_number, macro_id, child_id, chunk_id"
    return f"""found AS (SELECT * FROM (SELECT doc_id, chunk_id, page_number, macro_id, child_id, unnest({values(list(by_name))}) AS fact_name, unnest([{", ".join(by_name.values())}]) AS value FROM chunks WHERE chunk_type IS DISTINCT FROM 'table') WHERE value IS NOT NULL),
resolved AS (SELECT d.doc_id, n.fact_name, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, CASE count(DISTINCT value) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status,
    CASE WHEN count(DISTINCT value) = 1 THEN first(chunk_id ORDER BY {first}) END AS source_chunk_id FROM (SELECT DISTINCT doc_id FROM chunks) d
    CROSS JOIN (SELECT unnest({values(list(by_name))}) AS fact_name) n LEFT JOIN found USING (doc_id, fact_name) GROUP BY ALL)"""


FACT_NAME = "CASE " + " ".join(f"WHEN {any_phrase('lower(query)', aliases)} THEN {quoted(name)}" for name, aliases in rules.FACT_ALIASES) + " END"


def millions(number: str, unit: str) -> str:
    return f"round(CAST(replace({number}, ',', '') AS DECIMAL(18,4)) * CASE WHEN lower({unit}) = 'billion' THEN 1000 ELSE 1 END, 3)::DECIMAL(18,3)"


def amounts(text: str = "text_content") -> str:
    """List of the labelled amounts of a text's lines, in millions, and the stated aggregate."""
    lines = f"list_filter(string_split({text}, chr(10)), lambda x: contains(x, '$'))"
    before, after = (f"[{millions('z_[1]', 'z_[2]')} FOR z_ IN list_zip({found('l_', p, g)}, {found('l_', p, g + 1)})]" for p, g in ((evidence.LABELLED, 2), (evidence.LABELLED_AFTER, 1)))
    said = f"list_filter({lines}, lambda x: regexp_matches(x, {quoted(evidence.AGGREGATE_AMOUNT)}))[1]"
    stated = f"CASE WHEN {said} IS NOT NULL THEN " + millions(*(f"regexp_extract({said}, {quoted(evidence.AGGREGATE_AMOUNT)}, {g})" for g in (1, 2))) + " END"
    return f"flatten([list_concat({before}, {after}) FOR l_ IN {lines}]) AS parts, {stated} AS stated"


KIND = f"""CASE WHEN t = '' THEN 'boilerplate'
    WHEN ((regexp_matches(t, '\\p{{Lu}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}]') OR t LIKE '%:' OR regexp_matches(t, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches(t, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}][\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches(t, '(^|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}])\\p{{Ll}}')) AND length(t) <= 80)
        OR regexp_matches(t, '^\\d+(\\.\\d+)*\\s+\\S') AND length(t) <= 100 OR regexp_matches(t, '(?i)^Note\\s+\\d+') THEN 'heading'
    WHEN ({" OR ".join(f"contains(upper(t), {quoted(p)})" for p in rules.BOILERPLATE)}) AND length(t) <= 120 THEN 'boilerplate' ELSE 'narrative' END"""

HEADED = "lower(concat_ws(' ', heading_path, text_content))"
LEGAL = quoted(" ".join(rules.LITIGATION_ANCHORS))
NEAR_ANCHOR = "SELECT a.query_id, c.chunk_id, c.page_number, c.macro_id, c.child_id, c.chunk_type, c.text_content"
PLANS = f""", located AS (SELECT query_id, chunk_id, rank, 'pages' AS method FROM (SELECT r.query_id, v.chunk_id, row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, chunk_id) AS rank FROM routed r JOIN vscored v USING (query_id) WHERE intent = 'location' AND list_has_any(v.page_numbers, r.pages::INTEGER[])) WHERE rank <= 100),
note AS (SELECT * FROM routed WHERE intent = 'coverage' AND target IS NOT DISTINCT FROM 'items_of_note'), rest AS (SELECT * FROM routed WHERE intent = 'coverage' AND target IS DISTINCT FROM 'items_of_note'),
candidates AS (SELECT *, {reasons("coverage_type = 'numeric_list'", "NOT explicit_note")} AS reasons FROM (SELECT q.query_id, q.explicit_note, q.coverage_type, c.*, row_number() OVER (PARTITION BY q.query_id ORDER BY page_number, macro_id, child_id, chunk_id) AS rank FROM note q JOIN flagged c USING (doc_id) WHERE {any_phrase(HEADED, rules.POSITIVE)}) WHERE rank <= 25),
accepted AS (SELECT query_id, min(rank) AS rank FROM candidates WHERE len(reasons) = 0 GROUP BY query_id),
audit AS (SELECT query_id, '[' || string_agg('{{"rank":' || c.rank || ',"chunk_id":"' || chunk_id || '","reasons":[' || array_to_string(['"' || r || '"' FOR r IN reasons], ',') || ']}}', ',' ORDER BY c.rank) || ']' AS decisions FROM candidates c LEFT JOIN accepted a USING (query_id) WHERE a.rank IS NULL OR c.rank <= a.rank GROUP BY query_id),
{scored("g_", "", f"(SELECT query_id, doc_id, {LEGAL} AS query FROM rest WHERE litigation)")},
best AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g_scored WHERE score > 0) WHERE rank = 1),
open_ AS (SELECT query_id, doc_id, expanded AS query FROM rest WHERE query_id NOT IN (SELECT query_id FROM best)),
{scored("o_", "", "open_")}, {lexical("o_", "", "open_", 3)}, {nearest("o_", "open_", 3)}, {fused("o_", 1)},
anchor_ids AS (SELECT query_id, chunk_id FROM candidates JOIN accepted USING (query_id, rank) UNION ALL SELECT * FROM best UNION ALL SELECT query_id, chunk_id FROM o_fused),
anchor AS (SELECT i.query_id, c.*, r.coverage_type = 'attribute' OR r.target IS NOT NULL AS page_window FROM anchor_ids i JOIN chunks c USING (chunk_id) JOIN routed r ON r.query_id = i.query_id),
reached AS (SELECT *, min(priority) OVER (PARTITION BY query_id) AS least FROM (
    SELECT DISTINCT *, 1 AS priority, 'section' AS method FROM ({NEAR_ANCHOR} FROM anchor a JOIN chunks c ON c.doc_id = a.doc_id AND (c.heading_path = a.heading_path OR c.section_id = a.section_id))
    UNION ALL SELECT *, 2, 'macro_id' FROM ({NEAR_ANCHOR} FROM anchor a JOIN chunks c ON c.doc_id = a.doc_id AND c.macro_id = a.macro_id)
    UNION ALL SELECT *, 3, 'page_window' FROM ({NEAR_ANCHOR} FROM anchor a JOIN chunks c ON c.doc_id = a.doc_id AND page_window AND c.page_number BETWEEN greatest(a.page_number - 2, 1) AND a.page_number + 2))),
expanded_ AS (SELECT query_id, chunk_id, rank, method FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_number, macro_id, child_id, chunk_id) AS rank FROM reached WHERE priority = least) JOIN routed r USING (query_id) WHERE NOT (r.filters_tables AND (chunk_type = 'table' OR text_content LIKE '[TABLE]%'))),
meaning AS (SELECT query_id, doc_id, query, filters_tables FROM routed WHERE intent = 'semantic'),
{scored("s_", "", "meaning")}, {lexical("s_", "", "meaning", 300)}, {nearest("s_", "meaning", 300)}, {fused("s_", 100)},
chosen AS (SELECT * FROM (SELECT f.query_id, f.chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS rank, 'search' AS method FROM s_fused f JOIN meaning m USING (query_id) JOIN chunks c ON c.chunk_id = f.chunk_id WHERE NOT (m.filters_tables AND (chunk_type = 'table' OR text_content LIKE '[TABLE]%'))) WHERE rank <= 3),
planned AS (SELECT query_id, rank, method, chunk_id FROM located UNION ALL SELECT query_id, rank, method, chunk_id FROM expanded_ UNION ALL SELECT query_id, rank, method, chunk_id FROM chosen)
"""

STATUS = """SELECT r.query_id, r.intent, r.coverage_type, i.chunk_id AS anchor_id, coalesce(n.n_chunks, 0) AS n_chunks, a.decisions,
    CASE WHEN r.intent = 'coverage' AND r.coverage_type = 'list' AND i.chunk_id IS NULL THEN 'CoverageListQuery has no anchor heading.' WHEN r.intent = 'coverage' AND r.coverage_type = 'numeric_list' AND i.chunk_id IS NULL THEN 'not_found'
    WHEN r.intent = 'coverage' AND r.coverage_type IN ('list', 'numeric_list') AND n.n_chunks IS NULL THEN 'CoverageListQuery expansion returned no chunks.' ELSE 'ok' END AS status
    FROM routed r LEFT JOIN anchor_ids i USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n_chunks FROM planned GROUP BY query_id) n ON n.query_id = r.query_id LEFT JOIN audit a ON a.query_id = r.query_id"""

NARRATIVE = "(SELECT * FROM chunks WHERE chunk_type = 'narrative')"
FALLBACK = f""", wanted AS (SELECT * FROM (SELECT *, {FACT_NAME} AS fact_name FROM queries) WHERE fact_name IS NOT NULL),
{nearest("w_", "wanted", 3, "page_numbers[1] BETWEEN 1 AND 10")},
phrases AS (SELECT unnest({values(rules.FACT_HEADINGS)}) AS phrase, generate_subscripts({values(rules.FACT_HEADINGS)}, 1) AS number),
heads AS (SELECT doc_id, chunk_id, number FROM (SELECT c.doc_id, c.chunk_id, p.number, row_number() OVER (PARTITION BY c.doc_id, p.number ORDER BY page_number, macro_id, child_id, chunk_id) AS nth FROM chunks c JOIN phrases p ON contains(lower(concat_ws(chr(10), heading_path, section_id)), lower(p.phrase)) WHERE chunk_type IS DISTINCT FROM 'table') WHERE nth = 1),
{bm25("n_", NARRATIVE, f"(SELECT query_id, doc_id, {quoted(' '.join(rules.FACT_KEYWORDS))} AS query FROM wanted)")},
offered AS (SELECT query_id, chunk_id, 1 AS source_order, rank AS place FROM w_vtop JOIN chunks USING (chunk_id) WHERE chunk_type = 'narrative'
    UNION ALL SELECT w.query_id, h.chunk_id, 2, h.number FROM wanted w JOIN heads h USING (doc_id)
    UNION ALL SELECT query_id, chunk_id, 3, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM n_scored WHERE score > 0) WHERE rank <= 3),
once AS (SELECT o.*, c.page_number, CASE WHEN c.chunk_type = 'table' THEN NULL WHEN contains(c.text_content, 'Canadian dollars') THEN 'Canadian dollars' WHEN contains(c.text_content, 'U.S. dollars') OR contains(c.text_content, 'US dollars') THEN 'U.S. dollars' END AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source_order, place) AS nth FROM offered) o JOIN chunks c USING (chunk_id) WHERE nth = 1),
told AS (SELECT w.query_id, w.fact_name, CASE WHEN w.fact_name = 'default_currency' THEN first(value ORDER BY source_order, place) FILTER (WHERE value IS NOT NULL) END AS value, list_sort(list_distinct(list(page_number) FILTER (WHERE page_number IS NOT NULL))) AS pages FROM wanted w LEFT JOIN once o USING (query_id) GROUP BY w.query_id, w.fact_name)
SELECT query_id, fact_name, CASE WHEN value IS NULL THEN 'not_found' ELSE 'found' END AS status, CASE WHEN value IS NULL THEN 'not found. Searched pages: [' || coalesce(array_to_string(pages, ', '), '') || ']' ELSE fact_name || ': ' || value || ' [C1]' END AS answer FROM told"""
