"""The same results in DuckDB SQL, written on their own terms: lines, windows and joins."""

from __future__ import annotations

from fitloom.catalog import inputs as I
from fitloom.functions import lexicons as X
from fitloom.operators import render as D


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _tokens(text: str) -> str:
    pattern = r"[a-z](?:[\p{L}\p{N}_.+#-]*[\p{L}\p{N}_])?|[\p{L}\p{N}_]+"
    return (
        f"list_filter(regexp_extract_all(lower({text}), '{pattern}'), "
        "lambda x: regexp_matches(x, '^[a-z]'))"
    )


def _words(text: str) -> str:
    pattern = r"[A-Za-z](?:[\p{L}\p{N}_.+#-]*[\p{L}\p{N}_])?|[\p{L}\p{N}_]+"
    return (
        f"list_filter(regexp_extract_all({text}, '{pattern}'), "
        "lambda x: regexp_matches(x, '^[A-Za-z]'))"
    )


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


def _replaced(c: str, pairs) -> str:
    for a, b in pairs:
        a, b = (_q(x).replace("\n", "' || chr(10) || '") for x in (a, b))
        c = f"replace({c}, {a}, {b})"
    return c


def _lines(table: str, key: str, text: str, extra: str = "") -> str:
    """(key, line, i) with i from 0."""
    return (
        f"SELECT {key}, {extra} unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i "
        f"FROM (SELECT *, string_split({text}, chr(10)) AS ls FROM {table})"
    )


ORACLE: dict[str, str] = {}

# Matching

_m = I.MATCH_TERMS
_MATCH = rf"""
WITH r AS (
  SELECT DISTINCT item_id, unnest({_tokens('text')}) AS tok FROM benchmark
), rt AS (SELECT * FROM r WHERE tok NOT IN {_list(_m.stop_words)}),
p AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS title, list_distinct({_tokens(
      "string_split(text, chr(10))[1] || ' ' || text || ' ' || source")}) AS toks FROM documents
), jt AS (
  SELECT doc_id, tok FROM (SELECT doc_id, unnest(toks) AS tok FROM p) WHERE tok NOT IN {_list(_m.stop_words)}
), tw AS (
  SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(title), '\s+')) AS w FROM p)
  WHERE w <> '' AND w NOT IN {_list(_m.stop_words + _m.title_noise)}
), f AS (
  SELECT p.doc_id, len(toks) AS n_tokens, coalesce(n, 0) AS n_job,
    {' + '.join(f"CASE WHEN {_any('lower(title)', g)} THEN 2 ELSE 0 END" for g in _m.title_signals)} AS bonus
  FROM p LEFT JOIN (SELECT doc_id, count(*) AS n FROM jt GROUP BY ALL) USING (doc_id)
), c AS (
  SELECT jt.doc_id, item_id, count(*) AS nc, count(*) FILTER (jt.tok IN {_list(_m.tech_terms)}) AS nt,
    count(tw.w) AS nw
  FROM jt JOIN rt ON jt.tok = rt.tok LEFT JOIN tw ON tw.doc_id = jt.doc_id AND tw.w = jt.tok GROUP BY ALL
), s AS (
  SELECT item_id AS resume_id, doc_id AS posting_id, coalesce(nc, 0) AS n_common, n_job, coalesce(nt, 0) AS n_tech,
    bonus, least(coalesce(nw, 0), 3) AS relevance, n_tokens,
    coalesce(nc, 0)::DOUBLE / greatest(n_job, 1) * 3 + coalesce(nt, 0) * 0.5::DOUBLE + bonus
      + least(coalesce(nw, 0), 3) AS raw
  FROM f CROSS JOIN (SELECT item_id FROM benchmark) LEFT JOIN c USING (doc_id, item_id)
), scored AS (
  SELECT *, CASE WHEN n_tokens = 0 THEN 3 ELSE greatest(1, least(10, round_even(raw, 0)))::INT END AS match_score
  FROM s
)
"""
ORACLE["match_scores"] = _MATCH + """
SELECT resume_id, posting_id, n_common, n_job, n_tech, bonus, relevance, match_score, round(raw, 6) AS raw
FROM scored WHERE match_score >= 5"""
ORACLE["match_topk"] = _MATCH + """
SELECT resume_id, posting_id, rank, match_score FROM (
  SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, posting_id) AS rank
  FROM scored WHERE match_score >= 5) WHERE rank <= 5"""
ORACLE["match_bonus_only"] = _MATCH + """
SELECT doc_id AS posting_id, bonus, CASE WHEN n_tokens = 0 THEN 3 ELSE greatest(1, bonus) END AS default_score
FROM f WHERE default_score >= 5"""

# Text features

ORACLE["token_sets"] = f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS token_hash
FROM (SELECT doc_id, list_distinct({_tokens('text')}) AS t FROM documents)"""
_COUNTS = f"""
WITH w AS (
  SELECT doc_id, lower(unnest(ws)) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, {_words('text')} AS ws FROM documents)
), c AS (
  SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM w
  WHERE length(word) > 2 AND word NOT IN {_list(X.KEYWORD_STOP_WORDS)} GROUP BY ALL
)"""
ORACLE["keyword_top30"] = _COUNTS + """
SELECT doc_id, rank, word, n FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM c)
WHERE rank <= 30 AND n >= 2"""
ORACLE["word_frequency"] = _COUNTS + "SELECT word, sum(n) AS n, count(*) AS n_docs FROM c GROUP BY word"
_LEX = f"(SELECT * FROM (VALUES {_values((w,) for w in I.LEXICON)}) v(kw))"
ORACLE["lexicon_hits"] = f"""
SELECT doc_id, kw, row_number() OVER (PARTITION BY doc_id ORDER BY length(kw) DESC, kw) - 1 AS ord
FROM documents, {_LEX} WHERE contains(lower(text), kw)"""
ORACLE["lexicon_tokens"] = f"""
SELECT doc_id, kw, row_number() OVER (PARTITION BY doc_id ORDER BY length(kw) DESC, kw) - 1 AS ord
FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents), {_LEX} WHERE list_contains(t, kw)"""
_DOM = _values((d, i, k) for i, (d, ks) in enumerate(I.DOMAINS.items()) for k in ks)
ORACLE["domain_hits"] = f"""
SELECT doc_id, domain, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS ord FROM (
  SELECT DISTINCT doc_id, domain, o FROM documents, (VALUES {_DOM}) v(domain, o, kw) WHERE contains(lower(text), kw))"""
_EMAIL = r"nullif(regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0), '')"
_PHONE = r"nullif(regexp_extract(text, '[\(]?\d{3}[\)]?[-.\s]?\d{3}[-.\s]?\d{4}', 0), '')"
ORACLE["email_phone"] = f"SELECT doc_id, md5({_EMAIL}) AS email_hash, md5({_PHONE}) AS phone_hash FROM documents"
_NAME = rf"""coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_strip('l')}),
  lambda l: l <> '' AND length(l) < 50 AND NOT contains(l, 'http') AND regexp_matches(l, '^[A-Za-z\s.\-'']+$'))[1],
  'Unknown')"""
ORACLE["name_line"] = f"SELECT doc_id, {_NAME} AS name FROM documents"


def _level(n: str) -> str:
    tests = " ".join(f"WHEN {_any('lower(text)', ws)} THEN '{name}'" for name, ws in I.LEVELS)
    return f"CASE {tests} WHEN {n} >= 3 THEN 'mid-level' WHEN {n} >= 1 THEN 'entry-level' ELSE 'student' END"


ORACLE["experience_level"] = f"""
SELECT doc_id, {_level('n')} AS level FROM (
  SELECT *, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, ' of '))) AS n FROM documents)"""
ORACLE["path_key"] = r"""
SELECT p_partkey, trim(regexp_replace(lower('(' || p_name || '/' || p_brand || '/' || p_type || ')'),
  '[^\w\-]', '_', 'g'), '_') AS path_key FROM part"""
ORACLE["display_labels"] = """
SELECT o_orderkey,
  array_to_string(list_transform(string_split(replace(replace(lower(o_orderpriority), ' ', '-'), '-', ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS label,
  strftime(o_orderdate, '%B %d, %Y') AS long_date, strftime(o_orderdate, '%Y-%m-%d') AS short_date,
  array_to_string(list_transform(string_split(lower(o_orderpriority), '-'),
    lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || w[2:]), ' ')), '-') AS level
FROM orders"""

# Roles

_RULES = _values(
    (i, r.role, r.min_matches, t) for i, r in enumerate(I.ROLE_RULES) for t in r.triggers
)


def _rules(table: str, key: str) -> str:
    return f"""
SELECT {key}, rule_ord, role, count(*) AS matches FROM {table}, (VALUES {_RULES}) v(rule_ord, role, need, trig)
WHERE contains(lower(text), trig) GROUP BY {key}, rule_ord, role, need HAVING count(*) >= need"""


ORACLE["role_rules"] = f"SELECT doc_id, role, matches FROM ({_rules('documents', 'doc_id')})"

ORACLE["role_rules_table"] = ORACLE["role_rules"]
ORACLE["lexicon_table_hits"] = """
SELECT item_id, word FROM benchmark, (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)
WHERE word <> '' AND contains(lower(text), lower(word))"""


def _ranked_roles(table: str, key: str) -> str:
    fallback = X.FALLBACK_ROLE
    return f"""
SELECT resume_id, rank, role, matches FROM (
  SELECT {key} AS resume_id, role, matches,
    row_number() OVER (PARTITION BY {key} ORDER BY spare, matches DESC, rule_ord) AS rank
  FROM (
    SELECT {key}, rule_ord, role, matches, 0 AS spare FROM ({_rules(table, key)})
    UNION ALL
    SELECT {key}, 999, '{fallback}', 0, 1 FROM {table} WHERE {_any('lower(text)', I.LEXICON)}
  )) WHERE rank <= 8"""


ORACLE["role_rank8"] = _ranked_roles("documents", "doc_id")
ORACLE["role_rank_table"] = ORACLE["role_rank8"]
ORACLE["role_search4"] = f"""
SELECT role, count(*) AS n, sum(rank) AS rank_sum FROM ({ORACLE['role_rank8']}) WHERE rank <= 4 GROUP BY role"""

# Profile and line machines

_HEADER_TEXTS = [(h, s) for s, hs in I.HEADERS.items() for h in hs]
_EXACT = " ".join(f"WHEN key = {_q(h)} THEN '{s}'" for h, s in _HEADER_TEXTS)
_PREFIX = " ".join(
    f"WHEN length(key) < 60 AND starts_with(key, {_q(h)}) THEN '{s}'" for h, s in _HEADER_TEXTS
)
_SECTIONS = f"""
SELECT doc_id, section, coalesce(body, '') AS body FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY run DESC) AS back FROM (
    SELECT doc_id, run, max(section) AS section, string_agg(line, chr(10) ORDER BY i) FILTER (section IS NULL) AS body
    FROM (
      SELECT *, count(section) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
        SELECT *, CASE {_EXACT} {_PREFIX} END AS section FROM (
          SELECT *, rtrim(lower({_strip('line')}), ': ') AS key FROM ({_lines('documents', 'doc_id', 'text')})
        )
      )
      UNION ALL SELECT doc_id, NULL, -1, NULL, 'header', 0 FROM documents
    ) GROUP BY doc_id, run
  )
) WHERE back = 1"""
ORACLE["section_runs"] = f"SELECT doc_id, section, md5(body) AS body_hash FROM ({_SECTIONS})"
_CERTS = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, i) - 1 AS ord, line FROM (
  SELECT doc_id, CASE section WHEN 'education' THEN 0 ELSE 1 END AS part, i, {_strip('line')} AS line FROM (
    {_lines(f"({_SECTIONS})", 'doc_id', _strip('body'), 'section,')}
  ) WHERE section IN ('education', 'certifications')
) WHERE line <> '' AND regexp_matches(line, '(?i){'|'.join(I.CERT_WORDS)}')"""
ORACLE["cert_lines"] = _CERTS
_SKILLS = _values((w,) for w in {*I.LEXICON, *I.TECH_LEXICON})
ORACLE["profile_parse"] = f"""
SELECT d.doc_id AS resume_id, {_NAME} AS name, md5({_EMAIL}) AS email_hash, md5({_PHONE}) AS phone_hash,
  coalesce((SELECT string_agg(kw, ',' ORDER BY length(kw) DESC, kw) FROM (VALUES {_SKILLS}) v(kw)
    WHERE contains(lower(d.text), kw)), '') AS skills,
  coalesce(doms, '') AS domains, coalesce(kws, '') AS keywords, coalesce(n_certs, 0) AS n_certs,
  {_level('coalesce(n_jobs, 0)')} AS experience_level
FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(domain, ',' ORDER BY ord) AS doms FROM ({ORACLE['domain_hits']}) GROUP BY doc_id)
  USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(word, ',' ORDER BY rank) AS kws FROM ({ORACLE['keyword_top30']}) GROUP BY doc_id)
  USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_certs FROM ({_CERTS}) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_jobs FROM (%JOBS%) GROUP BY doc_id) USING (doc_id)"""

def _projects(table: str, text: str) -> str:
    return rf"""
WITH l AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, i, {_strip('line')} AS s FROM ({_lines(table, 'doc_id', _strip(text))})) WHERE s <> ''
), f AS (
  SELECT *, starts_with(s, '-') OR starts_with(s, '•') OR starts_with(s, '●') AS bullet,
    NOT regexp_matches(s, '[\(\)].*\d{{4}}') AND length(s) < 80 AND regexp_matches(s, '^\p{{Ll}}') AS low
  FROM l
), h AS (
  SELECT *, NOT bullet AND (NOT low OR i = min(i) FILTER (NOT bullet) OVER (PARTITION BY doc_id)) AS head FROM f
), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM h),
e AS (
  SELECT doc_id, grp - 1 AS ord, max(s) FILTER (head) AS t,
    coalesce(ltrim(string_agg(CASE WHEN bullet THEN {_strip("ltrim(s, '-•● ')")} ELSE s END, ' ' ORDER BY i)
      FILTER (NOT head), ' '), '') AS description
  FROM g WHERE grp > 0 GROUP BY doc_id, grp
), y AS (
  SELECT *, regexp_extract(t, '\(([^)]*(?:20\d{{2}})[^)]*)\)', 0) AS yp,
    regexp_extract(t, '\(([^)]*(?:20\d{{2}})[^)]*)\)', 1) AS year FROM e
), c AS (SELECT *, CASE WHEN yp <> '' THEN {_strip("replace(t, yp, '')")} ELSE t END AS clean FROM y)
SELECT doc_id, ord, rtrim({_strip(r"regexp_replace(clean, '\([^)]+\)', '', 'g')")}, '—–- ') AS name,
  md5(description) AS description_hash,
  CASE WHEN regexp_matches(clean, '\([^)]+\)') THEN array_to_string(list_transform(
    string_split(regexp_extract(clean, '\(([^)]+)\)', 1), ','), lambda x: {_strip('x')}), '~') ELSE '' END AS technologies,
  year FROM c"""


_PROJECT_LINES = _replaced(
    "text", ((". ", "\n- "), (" the ", "\nthe "), (" of ", " (of, 2023) "), (" in ", " (in, it) "))
)
ORACLE["project_groups"] = _projects("documents", _PROJECT_LINES)


def _experience(table: str, text: str, title_words, extra: str = "") -> str:
    months = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    return rf"""
WITH l AS (
  SELECT doc_id, line, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, i, line, {_strip('line')} AS s FROM ({_lines(table, 'doc_id', _strip(text))})) WHERE s <> ''
), f AS (
  SELECT *, NOT starts_with(line, ' ') AND NOT starts_with(line, '-') AND NOT starts_with(line, '•')
      AND length(s) < 120 AS cand,
    regexp_matches(s, '(?i)\|\s*({months})') AS dated, regexp_matches(s, '\d{{4}}') AS yr,
    CASE WHEN contains(s, ' — ') THEN ' — ' WHEN contains(s, ' - ') THEN ' - ' END AS sep FROM l
), h AS (
  SELECT *, cand AND (i = min(i) FILTER (cand) OVER (PARTITION BY doc_id) OR (NOT dated AND sep IS NOT NULL)) AS head
  FROM f
), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM h),
e AS (
  SELECT doc_id, grp - 1 AS ord, max(s) FILTER (head) AS t, max(sep) FILTER (head) AS sp,
    coalesce(arg_max(s, i) FILTER (cand AND NOT head AND (dated OR yr)), '') AS duration,
    coalesce(ltrim(string_agg(ltrim(s, '-•● '), ' ' ORDER BY i) FILTER (NOT cand), ' '), '') AS description
  FROM g WHERE grp > 0 GROUP BY doc_id, grp
), c AS (
  SELECT *, CASE WHEN sp IS NULL THEN t ELSE {_strip('substr(t, 1, strpos(t, sp) - 1)')} END AS a,
    CASE WHEN sp IS NULL THEN '' ELSE {_strip('substr(t, strpos(t, sp) + 3)')} END AS b FROM e
)
SELECT doc_id, ord, CASE WHEN k THEN b ELSE a END AS company, CASE WHEN k THEN a ELSE b END AS title, duration,
  md5(description) AS description_hash
FROM (SELECT *, sp IS NOT NULL AND {_any('lower(a)', title_words)} AS k FROM c)"""


_EXPERIENCE_LINES = _replaced(
    "text", ((". ", "\n"), (", ", " - "), (" and ", "\n- "), (" the ", " | May 2021 "),
             (" la ", "\n  la 1999 "), (" is ", " — lead ")),
)
ORACLE["experience_groups"] = _experience(
    "documents", _EXPERIENCE_LINES, ("lead", "vice", "ther", "manager")
)
_EDU_LINES = _replaced(
    "text", ((". ", "\n"), (" and ", "\nBachelor of "), (" the ", " GPA 3.5, "), (" de ", " May 2024 "))
)
_DEGREE = r"(?i)^(Bachelor|Master|Ph\.?D|Associate|B\.?S\.?|M\.?S\.?|B\.?A\.?|M\.?A\.?)[^,\n]*"
_FIELD = r"(?i)in\s+([A-Za-z\s]+?)(?:\s*,|\s*$|\s*GPA)"
_GRAD = r"(?i)(Expected\s+)?(May|June|December|Spring|Fall|Summer|January)?\s*\d{4}"
_GPA = r"(?i)GPA[:\s]*(\d+\.\d+)"
def _education(table: str, text: str) -> str:
    return rf"""
SELECT doc_id,
  arg_min(s, i) FILTER (length(s) > 5 AND NOT starts_with(s, '-') AND NOT starts_with(lower(s), 'relevant')
    AND NOT starts_with(lower(s), 'google') AND NOT starts_with(lower(s), 'coursera')) AS institution,
  coalesce({_strip(f"arg_max(regexp_extract(s, '{_DEGREE}', 0), i) FILTER (regexp_matches(s, '{_DEGREE}') AND NOT starts_with(lower(s), 'relevant coursework'))")}, '') AS degree,
  coalesce({_strip(f"arg_max(regexp_extract(s, '{_FIELD}', 1), i) FILTER (regexp_matches(s, '{_FIELD}'))")}, '') AS field,
  arg_max(regexp_extract(s, '{_GPA}', 1), i) FILTER (regexp_matches(s, '{_GPA}')) AS gpa,
  coalesce({_strip(f"arg_max(regexp_extract(s, '{_GRAD}', 0), i) FILTER (regexp_matches(s, '{_GRAD}'))")}, '') AS graduation
FROM (SELECT doc_id, i, {_strip('line')} AS s FROM ({_lines(table, 'doc_id', _strip(text))}))
WHERE s <> '' GROUP BY doc_id HAVING institution IS NOT NULL"""


ORACLE["education_first_last"] = _education("documents", _EDU_LINES)


def _section(name: str) -> str:
    return f"(SELECT doc_id, body FROM ({_SECTIONS}) WHERE section = '{name}')"


def _entries(sql: str, order: str, *fields: str) -> str:
    """One hash of a document's nested entries."""
    return f"(SELECT doc_id, md5(string_agg(concat_ws(chr(31), {', '.join(fields)}), chr(30) ORDER BY {order})) AS h FROM ({sql}) GROUP BY doc_id)"


_JOBS_OF = _experience(_section("experience"), "body", X.TITLE_WORDS)
ORACLE["profile_parse"] = ORACLE["profile_parse"].replace("%JOBS%", _JOBS_OF)
_found = lambda words: f"coalesce((SELECT string_agg(kw, ',' ORDER BY length(kw) DESC, kw) FROM (VALUES {_values((w,) for w in {*words})}) v(kw) WHERE contains(lower(d.text), kw)), '')"
ORACLE["profile_parse"] = f"""
SELECT p.*, coalesce(pr.h, md5('')) AS projects_hash, coalesce(ed.h, md5('')) AS education_hash, coalesce(ex.h, md5('')) AS experience_hash,
  coalesce(ce.h, md5('')) AS certifications_hash, {_found(I.LEXICON)} AS programming_languages, {_found(I.TECH_LEXICON)} AS technologies,
  md5(d.text) AS text_hash, NULL::VARCHAR AS source_file
FROM ({ORACLE["profile_parse"]}) p JOIN documents d ON d.doc_id = p.resume_id
LEFT JOIN {_entries(_projects(_section("projects"), "body"), "ord", "name", "description_hash", "technologies", "year")} pr ON pr.doc_id = d.doc_id
LEFT JOIN {_entries(_education(_section("education"), "body"), "institution", "institution", "degree", "field", "gpa", "graduation")} ed ON ed.doc_id = d.doc_id
LEFT JOIN {_entries(_JOBS_OF, "ord", "company", "title", "duration", "description_hash")} ex ON ex.doc_id = d.doc_id
LEFT JOIN {_entries(_CERTS, "ord", "line")} ce ON ce.doc_id = d.doc_id"""

# Sources

_ROLES = f"(VALUES {_values((r, i) for i, r in enumerate(I.ROLES))}) r(role, role_ord)"
_L = f"({_lines('documents', 'doc_id', 'text', 'lang, source AS src, text,')})"
_URL = "'https://x.example/' || doc_id || '/' || i"


def _role_word(text: str) -> str:
    return f"len(list_filter(string_split(lower(role), ' '), lambda w: contains({text}, w))) > 0"


def _rows(title, company, location, description, link, day, label, role, role_ord, rank, seq, body) -> str:
    return f"""
SELECT {title} AS title, {company} AS company, {location} AS location, 'Internship' AS type,
  NULL::VARCHAR AS salary, {description} AS description, {link} AS link, {day} AS date_posted,
  {_q(label)} AS source, {role} AS role, {role_ord} AS role_ord, {rank} AS source_rank, {seq} AS seq
FROM {body}"""


_DAY = f"'{I.AS_OF}'"
_CARDS = _rows(
    _strip("line"), "CASE WHEN contains(line, 'e') THEN src ELSE 'Unknown' END", "'Remote/Unknown'", "''",
    f"CASE WHEN contains(line, 'th') THEN {_URL} ELSE '' END",
    f"CASE WHEN contains(line, 'in') THEN '2026-02-03' ELSE {_DAY} END",
    "LinkedIn", _q(I.ROLES[0]), "0", "0", "i",
    f"{_L} WHERE i < 30 AND {_strip('line')} <> ''",
)
_THREAD_BODY = f"""(
  SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY i) AS nth FROM (
    SELECT *, '<p>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'
      || CASE WHEN contains(line, 'ea') THEN '<a href="' || {_URL} || '">more</a>' ELSE '' END AS html,
      {_strip('line')} AS head
    FROM {_L}, {_ROLES} WHERE i < 200
  ) WHERE {_role_word('lower(html)')} AND {_any('lower(html)', I.LEVEL_WORDS)}
) WHERE nth <= 30"""
_PARTS = r"string_split_regex(CASE WHEN head = '' THEN CASE WHEN contains(line, 'ea') THEN 'more' ELSE '' END ELSE head END, '\s*\|\s*')"
_PLAIN = "CASE WHEN contains(line, 'ea') THEN CASE WHEN head = '' THEN 'more' ELSE head || chr(10) || 'more' END ELSE head END"
_THREAD = _rows(
    f"coalesce({_strip(_PARTS + '[2]')}, role)", _strip(_PARTS + "[1]"),
    f"coalesce({_strip(_PARTS + '[3]')}, 'Unknown')", f"substr({_PLAIN}, 1, 500)",
    f"CASE WHEN contains(line, 'ea') THEN {_URL} ELSE 'https://news.ycombinator.com/item?id=' || (doc_id * 1000 + i) END",
    _DAY, "HN Who's Hiring", "role", "role_ord", "1", "i", _THREAD_BODY,
)


def _boundary(group: str, rows: str) -> str:
    """Whole boards until the cap is reached, counted per group."""
    return f"""(
  SELECT * FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY {group} ORDER BY board ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS before FROM (SELECT {group}, board, count(*) AS n FROM ({rows}) GROUP BY ALL)
  ) JOIN ({rows}) USING ({group}, board) WHERE before < {I.BOARD_CAP})"""


_BOARD_LINES = f"SELECT *, substr(src, 4)::INT AS board, 1 AS one FROM {_L}"
_BOARD_SEQ = "board::BIGINT * 4294967296 + i"
_TITLED = "upper(src[1]) || src[2:]"
_BOARD_A = _rows(
    "line", _TITLED,
    "CASE WHEN lang IN ('en', 'fr') THEN src ELSE 'Unknown' END", "''", _URL,
    f"CASE WHEN contains(line, 'th') THEN '2026-02-01' ELSE {_DAY} END",
    "Greenhouse", "role", "role_ord", "2", _BOARD_SEQ,
    _boundary("role", f"""SELECT * FROM ({_BOARD_LINES}), {_ROLES} WHERE contains(lower(line), '{I.MUST}')
      AND ({_role_word('lower(line)')} OR {_any('lower(line)', I.FALLBACK)})"""),
)
_BOARD_B = _rows(
    "line", _TITLED, "CASE WHEN lang <> 'de' THEN lang ELSE 'Unknown' END",
    "CASE WHEN contains(line, 'e') THEN substr(text, 1, 500) ELSE '' END", _URL, _DAY,
    "Lever", "role", "role_ord", "3", _BOARD_SEQ,
    _boundary("one", f"SELECT * FROM ({_BOARD_LINES}) WHERE contains(lower(line), '{I.MUST}')") + f", {_ROLES}",
)
_CURATED = _rows(
    "line", "CASE WHEN lang <> 'es' THEN src ELSE 'Unknown' END",
    "CASE WHEN i % 5 = 0 THEN 'Various' ELSE array_to_string(string_split(line, ' ')[1:least(3, i % 5)], ', ') END",
    "''", _URL, f"CASE WHEN contains(line, 'in') THEN '2026-01-15' ELSE {_DAY} END",
    "SimplifyJobs", "NULL::VARCHAR", "1048576", "4", "i",
    f"{_L} WHERE i < 60 AND line <> '' AND NOT (contains(line, 'the') AND contains(line, 'that'))",
)
_POSTING = ("title, company, location, type, salary, md5(description) AS description, link, date_posted, source, "
            "role, role_ord, source_rank")
for _name, _sql in (("card_posts", _CARDS), ("thread_posts", _THREAD), ("board_object_posts", _BOARD_A),
                    ("board_array_posts", _BOARD_B), ("curated_json_posts", _CURATED)):
    ORACLE[_name] = f"SELECT {_POSTING} FROM ({_sql})"
_ALL = " UNION ALL ".join((_CARDS, _THREAD, _BOARD_A, _BOARD_B, _CURATED))
_FIRST = """SELECT *, row_number() OVER (PARTITION BY {group} link
  ORDER BY role_ord, source_rank, seq, title, company, location) AS nth FROM ({rows})"""
ORACLE["collect_postings"] = f"""
SELECT link, source, role, title, company, location, md5(description) AS description, date_posted
FROM ({_FIRST.format(group='', rows=_ALL)}) WHERE nth = 1 OR link = ''"""
_KINDS = "(VALUES ('cards'), ('thread'), ('board_a'), ('board_b'), ('curated')) k(kind)"
_DAMAGED = f"""
SELECT doc_id, kind AS source, i AS place,
  CASE WHEN lang = 'de' THEN 'not fetched' WHEN kind <> 'cards' AND lang = 'fr' THEN 'not JSON' WHEN kind <> 'cards' AND lang = 'es' THEN 'no list' END AS whole,
  CASE WHEN kind = 'cards' THEN CASE WHEN {_strip('line')} = '' THEN 'no title' END
    WHEN (src = 'src3' AND lang = 'en') OR (line = '' AND kind <> 'thread') THEN CASE WHEN kind IN ('thread', 'board_b') THEN 'no text' ELSE 'no title' END END AS reason
FROM {_L}, {_KINDS}"""
ORACLE["payload_rejects"] = f"""
SELECT DISTINCT doc_id, source, NULL::INT AS place, whole AS reason FROM ({_DAMAGED}) WHERE whole IS NOT NULL
UNION ALL SELECT doc_id, source, place::INT, reason FROM ({_DAMAGED}) WHERE whole IS NULL AND reason IS NOT NULL"""
ORACLE["payload_accounts"] = f"""
SELECT source, whole AS reason, count(DISTINCT doc_id) AS n_payloads, count(*) FILTER (whole IS NULL) AS n_items,
  count(*) FILTER (whole IS NULL AND reason IS NOT NULL) AS n_rejected
FROM ({_DAMAGED}) GROUP BY ALL"""
ORACLE["markdown_table_state"] = rf"""
WITH l AS (
  SELECT doc_id, i + 2 AS i, CASE WHEN contains(line, ' the ') THEN '| Company | Role | Location | Date |'
    WHEN contains(line, 'que') THEN line WHEN contains(line, 'ung') THEN '|---|---|---|---|'
    ELSE '| ' || string_split(line, ' ')[1] || ' | [' || line || '](' || {_URL} || ') | ' || lang
      || CASE WHEN contains(line, 'er') THEN ' | now |' ELSE ' |' END END AS x FROM {_L}
  UNION ALL SELECT doc_id, 0, '| Company | Role | Location | Date |' FROM documents
  UNION ALL SELECT doc_id, 1, '|---|---|---|---|' FROM documents
), s AS (
  SELECT *, contains(x, '| Company') AND contains(x, 'Role') AS is_head, starts_with(x, '|') AS piped FROM l
), g AS (
  SELECT *, sum((NOT is_head AND NOT piped)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS off FROM s
), o AS (
  SELECT *, coalesce(max(is_head::INT) OVER (PARTITION BY doc_id, off ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) = 1 AS in_table FROM g
), c AS (
  SELECT doc_id, i, list_transform(string_split(x, '|')[2:-2], lambda v: {_strip('v')}) AS cols FROM o
  WHERE in_table AND piped AND NOT is_head AND NOT starts_with(x, '|---')
), v AS (
  SELECT doc_id, i, {_strip(r"regexp_replace(cols[1], '\[([^\]]+)\]\([^)]+\)', '\1', 'g')")} AS company,
    {_strip(r"regexp_replace(cols[2], '\[([^\]]+)\]\([^)]+\)', '\1', 'g')")} AS title,
    {_strip(r"regexp_replace(cols[3], '\[([^\]]+)\]\([^)]+\)', '\1', 'g')")} AS location,
    regexp_extract(cols[2], '\[.*?\]\((https?://[^)]+)\)', 1) AS link
  FROM c WHERE len(cols) >= 4
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, company, title, location, link
FROM v WHERE NOT contains(company, '↳') AND title <> '' QUALIFY ord < 60"""
ORACLE["pipe_line_fields"] = rf"""
SELECT doc_id, {_strip('p[1]')} AS company, coalesce({_strip('p[2]')}, lang) AS title,
  coalesce({_strip('p[3]')}, 'Unknown') AS location
FROM (SELECT *, string_split_regex(string_split(text, chr(10))[1], '\s*\|\s*') AS p FROM documents)"""
ORACLE["json_props"] = """
SELECT event_id, json_extract(props, '$.k')::INT AS k,
  CASE WHEN event_type IN ('view', 'error') THEN event_type ELSE 'Unknown' END AS place FROM events"""
_UNESCAPE = "replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
ORACLE["html_heading"] = rf"""
SELECT page_id, {_strip(_UNESCAPE.format(c="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading FROM pages"""
ORACLE["html_cards"] = rf"""
SELECT page_id, ord, {_strip(_UNESCAPE.format(c="regexp_extract(li, '<a[^>]*>([^<]*)</a>', 1)"))} AS title,
  {_UNESCAPE.format(c="regexp_extract(li, 'href=\"([^\"]*)\"', 1)")} AS href
FROM (SELECT page_id, unnest(ls) AS li, generate_subscripts(ls, 1) - 1 AS ord FROM (
  SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS ls FROM pages))"""
ORACLE["thread_children_filter"] = f"""
SELECT conv_id, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
WHERE nth <= 200 AND text <> '' AND {_any('lower(text)', I.ROLES[0].lower().split())} AND {_any('lower(text)', I.LEVEL_WORDS)}"""
ORACLE["union_sources"] = " UNION ALL ".join(
    f"SELECT '{t}' AS source, {k}::BIGINT AS item, length({c}) AS n_chars, md5({c}) AS text_hash FROM {t}"
    for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"),
                    ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text"))
)
ORACLE["location_filter"] = "SELECT doc_id, lang AS location FROM documents WHERE contains(lower(lang), 'e')"

# Caps and rankings

ORACLE["cap_input"] = """
SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 30
  AND p_size > 25"""
ORACLE["cap_output"] = """
SELECT p_brand, p_partkey FROM part WHERE p_size > 25
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 30"""
ORACLE["cap_group_boundary"] = """
SELECT o_orderpriority, o_custkey, o_orderkey FROM orders JOIN (
  SELECT o_orderpriority, o_custkey, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) - n AS before
  FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
) USING (o_orderpriority, o_custkey) WHERE before < 30"""
_JOBS = """SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date_found,
  CASE o_orderstatus WHEN 'O' THEN 'Not Applied' WHEN 'F' THEN 'Applied' WHEN 'P' THEN 'Interview' END AS application_status,
  least(10, floor(o_totalprice / 45000))::INT AS match_score FROM orders"""
ORACLE["ordered_jobs"] = f"""
SELECT o_orderkey, match_score, date_found,
  row_number() OVER (ORDER BY match_score DESC, date_found DESC, o_orderkey) AS position FROM ({_JOBS})"""
ORACLE["sorted_jobs"] = f"SELECT o_orderkey, match_score, date_found, application_status FROM ({_JOBS})"
ORACLE["score_breaks"] = f"""
SELECT *, CASE WHEN is_break THEN repeat('★', match_score) || repeat('☆', 10 - match_score) END AS header FROM (
  SELECT o_custkey, o_orderkey, match_score, row_number() OVER w AS position,
    coalesce(lag(match_score) OVER w, -1) <> match_score AS is_break
  FROM ({_JOBS}) WINDOW w AS (PARTITION BY o_custkey ORDER BY match_score DESC, o_orderkey))"""

# Keyed tables

_KEYED = """SELECT doc_id, string_split(text, chr(10))[1] AS title, source AS company, lang AS location,
  (n_chars % 11)::INT AS match_score, coalesce(string_split(text, chr(10))[2], '') AS link, source FROM documents"""
_STORED = f"SELECT link FROM ({_KEYED}) WHERE doc_id IN (SELECT doc_id FROM labels)"
ORACLE["dedup_first_blank_kept"] = f"""
SELECT doc_id, md5(link) AS link_hash FROM ({_KEYED})
QUALIFY link = '' OR row_number() OVER (PARTITION BY link ORDER BY doc_id) = 1"""
ORACLE["dedup_one_blank"] = f"SELECT min(doc_id) AS doc_id, md5(link) AS link_hash FROM ({_KEYED}) GROUP BY link"
ORACLE["load_new_anti"] = f"""
SELECT {_DAY} AS date_found, company, title, location, 'Internship' AS job_type, match_score,
  'Not Applied' AS application_status, md5(link) AS link_hash, source, '' AS description
FROM ({_KEYED}) WHERE link NOT IN ({_STORED}) QUALIFY row_number() OVER (PARTITION BY link ORDER BY doc_id) = 1"""
ORACLE["load_per_resume"] = """
SELECT o_custkey::VARCHAR AS resume_id, o_orderpriority AS link, 'House of ' || o_orderstatus AS company,
  (o_orderkey % 10)::INT AS match_score, strftime(o_orderdate, '%Y-%m-%d') AS date_found, 'Internship' AS job_type
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1"""
ORACLE["load_bucketed"] = ORACLE["load_per_resume"]
ORACLE["load_counts"] = """
WITH k AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'),
n AS (
  SELECT 0 AS load, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS incoming, (SELECT count(*) FROM k) AS inserted, 0 AS quarantined
  UNION ALL SELECT 1, (SELECT count(*) FROM orders), (SELECT count(*) FROM a) - (SELECT count(*) FROM k),
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'))
SELECT load::INT AS load, incoming, inserted, incoming - inserted - quarantined AS skipped, quarantined::BIGINT AS quarantined FROM n"""
ORACLE["exists_semi"] = f"SELECT doc_id FROM ({_KEYED}) WHERE link <> '' AND link IN ({_STORED})"
ORACLE["sheet_append_rows"] = f"""
SELECT {_DAY} AS "Date Found", company AS "Company", title AS "Title", location AS "Location", 'Internship' AS "Type",
  match_score AS "Match Score", link AS "Job Link", source AS "Source", '' AS "Status"
FROM ({_KEYED}) WHERE link = '' OR link NOT IN ({_STORED})"""
ORACLE["sheet_links"] = f"SELECT DISTINCT md5(link) AS link_hash FROM ({_KEYED}) WHERE link <> ''"
ORACLE["quarantined_rows"] = """
SELECT doc_id, CASE WHEN n < 2 THEN 'company is null' ELSE 'title is null' END AS reason
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) WHERE n < 3"""
ORACLE["status_counts"] = f"SELECT application_status, count(*) AS n FROM ({_JOBS}) GROUP BY application_status"
ORACLE["stats_bundle"] = f"""
SELECT (SELECT count(*) FROM orders) AS total,
  (SELECT string_agg(application_status || '=' || n, ', ' ORDER BY application_status)
   FROM ({ORACLE['status_counts']})) AS by_status,
  (SELECT round_even(avg(match_score), 1) FROM ({_JOBS}) WHERE match_score > 0) AS avg_score"""
ORACLE["status_latest"] = """
SELECT c_custkey AS link, coalesce(status, 'Not Applied') AS application_status FROM customer LEFT JOIN (
  SELECT user_id, event_type AS status FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1) ON user_id = c_custkey"""
ORACLE["status_snapshot"] = ORACLE["status_latest"]
ORACLE["status_domain"] = """
SELECT event_type IN ('view', 'click', 'signup') AS is_valid, count(*) AS n FROM events GROUP BY 1"""
ORACLE["source_funnel"] = f"""
SELECT source, count(*) AS found, count(*) FILTER (match_score >= 5) AS matched,
  count(*) FILTER (match_score >= 5 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS added
FROM ({_KEYED}) GROUP BY source"""

# Documents

_TOP = f"""
SELECT * FROM (
  SELECT o_custkey AS resume_id, o_orderkey AS posting_id, application_status AS description, match_score,
    'House of ' || o_orderstatus AS company, o_orderpriority || ' Intern' AS title,
    row_number() OVER (PARTITION BY o_custkey ORDER BY match_score DESC, o_orderkey) AS rank
  FROM ({_JOBS}) JOIN (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) USING (o_orderkey)
) WHERE rank <= 3"""


def _fill(template: str, **values: str) -> str:
    """The template as a SQL concatenation."""
    parts, rest = [], template
    while rest:
        text, brace, rest = rest.partition("{")
        if text:
            parts.append(_q(text).replace("\n", "' || chr(10) || '"))
        if brace:
            name, _, rest = rest.partition("}")
            parts.append(f"({values[name]})")
    return " || ".join(parts)


def _documents(repeats: bool) -> str:
    # skills are segment, low, high; low is also a language, high also a technology
    listed = "[seg, 'low', 'high', 'low', 'high']" if repeats else "[seg, 'low', 'high']"
    named = f"list_filter({listed}, lambda s: contains(lower(description || ' ' || title), s))"
    return f"""(
SELECT *, CASE WHEN len(m) > 0 THEN array_to_string(m[1:5], ', ') ELSE array_to_string(al[1:5], ', ') END AS skills,
  trim(regexp_replace(lower(company), '[^\\w\\-]', '_', 'g'), '_') AS folder,
  trim(regexp_replace(lower(title), '[^\\w\\-]', '_', 'g'), '_') AS file
FROM (
  SELECT t.*, c_name AS name, c_mktsegment AS segment, c_acctbal, c_nationkey, [seg, 'low', 'high'] AS al, {named} AS m,
    CASE WHEN c_nationkey > 5 THEN c_name || '@x.example' ELSE 'None' END AS email
  FROM ({_TOP}) t JOIN (SELECT *, lower(c_mktsegment) AS seg FROM customer) ON c_custkey = resume_id
))"""


_LETTER = _fill(
    D.OPENING, date="'March 12, 2026'", title="title", company="company", skills="skills",
    all_skills="array_to_string(al, ', ')", name="name", email="email",
    project="CASE WHEN c_acctbal > 2000 THEN " + _fill(
        D.PROJECT_PARAGRAPH, name="'Plan ' || segment", description="lower(name)", title="title") + " ELSE '' END",
    experience="CASE WHEN c_acctbal > 5000 THEN " + _fill(
        D.EXPERIENCE_PARAGRAPH, title="segment", company="lower(name)", description="'sold things'") + " ELSE '' END",
)
_ONE_PROJECT = "'  - Plan ' || segment || ': ' || lower(name) || chr(10)"
_NOTES = _fill(
    D.NOTES, title="title", company="company", skills="skills",
    matching=f"CASE WHEN len(m) > 0 THEN array_to_string(list_transform(m, lambda s: '  ✓ ' || s), chr(10)) "
             f"ELSE {_q(D.NO_MATCHING)} END",
    level="CASE WHEN c_nationkey > 8 THEN 'Mid-Level' ELSE 'Student' END",
    domains="CASE WHEN c_nationkey > 12 THEN segment ELSE 'technology' END",
    first_skills="CASE WHEN len(m) > 0 THEN array_to_string(m[1:6], ', ') ELSE array_to_string(al, ', ') END",
    projects=f"CASE WHEN c_acctbal > 2000 THEN repeat({_ONE_PROJECT}, 2) ELSE '' END",
    keywords=f"array_to_string(list_append(m, {_strip(chr(114) + 'eplace(lower(title), ' + _q('intern') + ', ' + _q('') + ')')}), ', ')",
)
ORACLE["render_letter"] = f"SELECT resume_id, posting_id, {_LETTER} AS body FROM {_documents(False)}"
ORACLE["render_notes"] = f"SELECT resume_id, posting_id, {_NOTES} AS body FROM {_documents(True)}"
ORACLE["topn_documents"] = " UNION ALL ".join(
    f"SELECT resume_id, posting_id, '{kind}' AS kind, folder || '/{kind}_' || file || '_' || posting_id AS path_key, "
    f"length({body}) AS n_chars FROM {_documents(False)}"
    for kind, body in (("cover_letter", _LETTER), ("tailored_resume", _NOTES))
)
ORACLE["documents_replaced"] = " UNION ALL ".join(
    f"SELECT resume_id, posting_id, '{kind}' AS kind, folder || '/{kind}_' || file || '_' || posting_id AS path_key, "
    f"md5({body}) AS body_hash FROM {_documents(repeats)}"
    for kind, body, repeats in (("cover_letter", _LETTER, False), ("tailored_resume", _NOTES, False))
)
ORACLE["shared_paths"] = f"""
SELECT resume_id, folder, file, count(*) AS n FROM {_documents(False)} GROUP BY ALL HAVING count(*) > 1"""

# Composite runs

_CONTENT_KEY = "md5(title || chr(1) || description || chr(1) || company)"
ORACLE["discovery_matches"] = rf"""
WITH own AS (
  SELECT resume_id, role, rank - 1 AS own_ord FROM ({_ranked_roles('benchmark', 'item_id')}) WHERE rank <= 4
), posts AS (SELECT *, {_CONTENT_KEY} AS cid FROM ({_ALL})),
offered AS (
  SELECT resume_id, own_ord AS place, p.* FROM posts p JOIN own ON own.role = p.role
  UNION ALL SELECT item_id, p.role_ord, p.* FROM posts p, benchmark WHERE p.role IS NULL
), firsts AS (
  SELECT * FROM offered QUALIFY link = ''
    OR row_number() OVER (PARTITION BY resume_id, link ORDER BY place, source_rank, seq, title, company) = 1
), p AS (
  SELECT cid, title, list_distinct({_tokens("title || ' ' || description || ' ' || company")}) AS toks
  FROM (SELECT DISTINCT cid, title, description, company FROM posts)
), r AS (SELECT DISTINCT item_id, unnest({_tokens('text')}) AS tok FROM benchmark),
jt AS (
  SELECT cid, tok FROM (SELECT cid, unnest(toks) AS tok FROM p) WHERE tok NOT IN {_list(_m.stop_words)}
), tw AS (
  SELECT DISTINCT cid, w FROM (SELECT cid, unnest(string_split_regex(lower(title), '\s+')) AS w FROM p)
  WHERE w <> '' AND w NOT IN {_list(_m.stop_words + _m.title_noise)}
), f AS (
  SELECT p.cid, len(toks) AS n_tokens, coalesce(n, 0) AS n_job,
    {' + '.join(f"CASE WHEN {_any('lower(title)', g)} THEN 2 ELSE 0 END" for g in _m.title_signals)} AS bonus
  FROM p LEFT JOIN (SELECT cid, count(*) AS n FROM jt GROUP BY ALL) USING (cid)
), c AS (
  SELECT jt.cid, item_id, count(*) AS nc, count(*) FILTER (jt.tok IN {_list(_m.tech_terms)}) AS nt, count(tw.w) AS nw
  FROM jt JOIN r ON jt.tok = r.tok LEFT JOIN tw ON tw.cid = jt.cid AND tw.w = jt.tok GROUP BY ALL
)
SELECT * FROM (
  SELECT resume_id, link, role, source, company, CASE WHEN n_tokens = 0 THEN 3 ELSE greatest(1, least(10, round_even(
      coalesce(nc, 0)::DOUBLE / greatest(n_job, 1) * 3 + coalesce(nt, 0) * 0.5::DOUBLE + bonus
      + least(coalesce(nw, 0), 3), 0)))::INT END AS match_score, md5(title) AS title_hash
  FROM firsts JOIN f USING (cid) LEFT JOIN c ON c.cid = firsts.cid AND c.item_id = resume_id
) WHERE match_score >= 5"""
ORACLE["stream_ingest"] = f"""
SELECT '' AS resume_id, {_DAY} AS date_found, source AS company, lang AS title, '' AS location, 'Internship' AS job_type,
  (n_chars % 10)::INT AS match_score, 'Not Applied' AS application_status, md5(text) AS link, source, NULL::VARCHAR AS salary,
  sha256(text) AS description
FROM documents LEFT JOIN (SELECT DISTINCT doc_id, TRUE AS known FROM labels) USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY text ORDER BY coalesce(known, FALSE) DESC, doc_id) = 1"""
ORACLE["resume_files_stream"] = f"""
WITH f AS (
  SELECT doc_id // 32 AS file, {_strip('string_agg(text, chr(10) ORDER BY doc_id)')} AS text FROM documents GROUP BY 1
)
SELECT file, file % 2 AS run, CASE WHEN file % 8 <> 7 THEN md5(text) END AS text_hash,
  CASE WHEN file % 8 <> 7 THEN {_found(I.LEXICON)} END AS languages, CASE WHEN file % 8 = 7 THEN 'unsupported format: .json' END AS reason
FROM f d"""
_LISTED = """
SELECT o_custkey::VARCHAR AS resume_id, o_orderkey::VARCHAR AS link, (o_orderkey % 10)::INT AS match_score,
  strftime(o_orderdate, '%Y-%m-%d') AS date_found, 'House of ' || o_orderstatus AS company FROM orders"""
ORACLE["clustered_threshold"] = f"SELECT * FROM ({_LISTED}) WHERE match_score >= 9"
ORACLE["clustered_page"] = f"""
SELECT resume_id, link, match_score, date_found FROM ({_LISTED}) ORDER BY match_score DESC, date_found DESC, resume_id, link LIMIT 100 OFFSET 1000"""
ORACLE["stream_within_watermark"] = """
SELECT event_id, 'user ' || user_id AS company, event_type AS title, strftime(ts, '%Y-%m-%d') AS date_found FROM events
WHERE user_id % 2 = 0 OR ts >
  (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE user_id % 2 = 0) - INTERVAL 3 DAY"""
