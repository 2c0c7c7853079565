"""DuckDB SQL that states, over the raw tables, what each query must return.

Written from the definitions and row by row: no pre-aggregation, closed forms or
other short cuts of the operators are used here.
"""

from __future__ import annotations

from broadsheet.dims import (
    BINARY_VARIABLES, BODY_DIV_CLASSES, CRAWL_COLLECTIONS, HOST_PREFIXES, IDEOLOGY_BINS, MODELS,
    RATERS, REGION_STATES, ROLES, STATE_POPULATION, SURVEY_QUESTIONS,
    TIER1_TERMS, TIER2_TERMS, VALID_STATES, VARIABLES, rating_column,
)
from workload.views import ctes

ORACLES: dict[str, str] = {}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _values(rows) -> str:
    def cell(v) -> str:
        return _quoted([v]) if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


def _strip(x: str) -> str:
    space = r"[\t-\r\x1c- \x{85}\p{Z}]"
    return f"regexp_replace({x}, '^{space}+|{space}+$', '', 'g')"


def _low(x: str) -> str:
    return f"lower({_strip(x)})"


def _label(x: str) -> str:
    return f"CASE WHEN {_low(x)} IN ('', 'nan', 'none') THEN NULL ELSE {_low(x)} END"


def _yes_no(x: str) -> str:
    return (
        f"CASE WHEN {_low(x)} IN ('yes', 'true', '1') THEN 'yes' "
        f"WHEN {_low(x)} IN ('no', 'false', '0') THEN 'no' END"
    )


def _race_irr(x: str) -> str:
    return (
        f"CASE WHEN {_low(x)} IN ('hispanic', 'asian', 'middle eastern', 'pacific islander', "
        f"'native american', 'native') THEN 'other' WHEN {_low(x)} IN ('', 'nan', 'none', "
        "'no name provided', 'multiple', 'unknown', 'not_provided', 'not provided') THEN NULL "
        f"ELSE {_low(x)} END"
    )


def _gender_irr(x: str) -> str:
    return (
        f"CASE WHEN {_low(x)} IN ('', 'nan', 'none', 'no name provided', 'multiple', "
        f"'not_provided', 'not provided', 'nonbinary/other') THEN NULL ELSE {_low(x)} END"
    )


def _race_3(x: str, missing: list[str]) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {_low(x)} IN ({_quoted(missing)}) THEN NULL "
        f"WHEN {_low(x)} IN ('white', 'black') THEN {_low(x)} ELSE 'other' END"
    )


def _race_oe(x: str) -> str:
    return _race_3(x, ["", "not_provided", "unknown"])


def _race_counts(x: str) -> str:
    return _race_3(x, ["", "not_provided", "unknown", "not provided", "multiple"])


def _normal(variable: str, x: str) -> str:
    if variable in BINARY_VARIABLES:
        return _yes_no(x)
    if variable.endswith("_race"):
        return _race_irr(x)
    if variable.endswith("_gender"):
        return _gender_irr(x)
    return _label(x)


def _netloc(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def _url_netloc(x: str) -> str:
    trimmed = f"ltrim({x}, ' ')"
    return f"coalesce(nullif({_netloc(trimmed)}, ''), {x})"


def _nowww(x: str) -> str:
    netloc = _netloc(_low(f"coalesce({x}, 'nan')"))
    return (
        f"CASE WHEN contains({netloc}, '[') <> contains({netloc}, ']') THEN NULL "
        f"ELSE regexp_replace({netloc}, '^www[.]', '') END"
    )


def _url_domain(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({x}), '^https?://', ''), '^www[.]', '')"
    return f"string_split({bare}, '/')[1]"


def _hits(x: str, terms) -> str:
    return (
        f"list_sort(list_filter(list_distinct([{_quoted(terms)}]), "
        f"lambda k: contains(lower({x}), k)))"
    )


def _hit_text(x: str, terms) -> str:
    return f"array_to_string({_hits(x, terms)}, ';')"


def _dated(x: str) -> str:
    """Dates told token by token; tokens are what stands between single blanks.

    `2020-1-31` or with slashes inside a token; `word 3, 2020` and `3 word 2020` over
    three tokens. What touches a date from outside must not be a letter, digit or `_`.
    """
    word, digit = r"[\p{L}\p{N}_]", r"\p{Nd}"
    other = r"[^\p{L}\p{N}_]"
    year_opens = f"regexp_matches(list_extract(tokens, i + 2), '^{digit}{{4}}($|{other})')"
    return f"""(SELECT count(*) > 0 FROM (SELECT tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (SELECT string_split({x}, ' ') AS tokens)) t
      WHERE regexp_matches(list_extract(tokens, i), '(^|{other}){digit}{{4}}[-/]{digit}{{1,2}}[-/]{digit}{{1,2}}($|{other})')
      OR (regexp_matches(list_extract(tokens, i), '{word}$') AND regexp_full_match(list_extract(tokens, i + 1), '{digit}{{1,2}},?') AND {year_opens})
      OR (regexp_matches(list_extract(tokens, i), '(^|{other}){digit}{{1,2}}$') AND regexp_full_match(list_extract(tokens, i + 1), '{word}+') AND {year_opens}))"""


def _oracle(name: str, views: str, body: str) -> None:
    prefix = ctes(*views.split()) + "\n" if views else ""
    if prefix and body.split()[0] == "WITH":
        body = "," + body.lstrip().removeprefix("WITH")
    ORACLES[name] = prefix + body


ALL_TERMS = TIER1_TERMS + TIER2_TERMS
NL = "chr(10)"

# --- sources and sinks --------------------------------------------------------

_oracle("src_keywords", "", f"""
SELECT lower(rtrim(line, chr(13) || {NL})) AS term, count(*) AS n
FROM (SELECT unnest(string_split(text, {NL})) AS line FROM documents)
WHERE {_strip("line")} <> '' GROUP BY 1""")

_oracle("src_sources", "inventory", """
SELECT name, state, city, URL AS source_url FROM inventory
WHERE name IS NOT NULL AND state IS NOT NULL AND city <> 'n/a' AND URL <> 'NA'""")

_oracle("src_crawl_index", "crawl_index", """
SELECT url, filename, rec_offset AS "offset", length, collection FROM crawl_index
WHERE index_pos % 10 <> 7""")

_oracle("crawl_table_of_years", "crawl_index", """
SELECT url, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1) AS host, filename, rec_offset AS "offset", length, collection
FROM crawl_index WHERE collection IN ('CC-MAIN-2018-43', 'CC-MAIN-2019-09')""")

_oracle("src_article_blocks", "articles", f"""
SELECT url, year, source, coalesce(state, '') AS state,
  {_strip(f"replace(replace(text, chr(13) || {NL}, {NL}), chr(13), {NL})")} AS text FROM articles""")

_MODEL_COLUMNS = [rating_column(m, v) for m in MODELS for v in VARIABLES]
_oracle("src_people", "people", f"""
SELECT art_num, url, l_linenumber, {", ".join(f"nullif({c}, '') AS {c}" for c in _MODEL_COLUMNS)},
  CASE WHEN l_partkey % 10 = 0 THEN 'say "' || l_suppkey || '",' || {NL} || 'then' ELSE url END AS note FROM people""")

_oracle("src_survey", "exports", "WITH asked AS (" + " UNION ALL ".join(
    f"SELECT export, 'ART' || lpad(art::VARCHAR, 4, '0') || '_{q}' AS col, coder, nullif({q}, '') AS value FROM exports"
    for q in SURVEY_QUESTIONS.values()) + """),
coders AS (
  SELECT export, coder, list_extract(['Eleanor', 'Sarah'], (row_number() OVER (PARTITION BY export ORDER BY coder))::INT) AS rater
  FROM asked WHERE col = 'ART0001_Q1_CRIME_COMMITTED' AND value IS NOT NULL),
names AS (SELECT DISTINCT export, col FROM asked)
SELECT n.export, c.rater, n.col, a.value
FROM names n JOIN coders c USING (export) LEFT JOIN asked a ON a.export = n.export AND a.col = n.col AND a.coder = c.coder""")

_CURATED = f"""
curated AS (
  SELECT *, {_hit_text("text", TIER1_TERMS)} AS tier1_keywords, {_hit_text("text", TIER2_TERMS)} AS tier2_keywords
  FROM articles WHERE {_dated("text")} AND len({_hits("text", TIER1_TERMS)}) > 0)"""

_oracle("sink_article_blocks", "articles", f"""WITH {_CURATED}
SELECT block, count(*) AS n FROM (SELECT
    url || {NL} || 'year: ' || year || {NL} || 'source: ' || source || {NL}
    || 'state: ' || coalesce(state, '') || {NL} || 'tier1_keywords: ' || tier1_keywords || {NL}
    || 'tier2_keywords: ' || tier2_keywords || {NL} || 'text:' || {NL} || text || {NL} || {NL} AS block
  FROM curated) GROUP BY 1""")

_oracle("sink_keyword_matches", "articles", f"""
SELECT source, state, url, year, {_hit_text("url", ALL_TERMS)} AS matched_keywords FROM articles
WHERE len({_hits("url", ALL_TERMS)}) > 0""")

_oracle("sink_curated_metadata", "articles", f"""WITH {_CURATED}
SELECT url, year, source, state, tier1_keywords, nullif(tier2_keywords, '') AS tier2_keywords FROM curated""")

# --- expressions --------------------------------------------------------------

for _name, _sql in {
    "url_netloc": _url_netloc("url"),
    "url_domain": _url_domain("url"),
    "url_netloc_nowww": _nowww("url"),
    "source_url_norm": _low("url"),
}.items():
    _oracle(_name, "urls", f"SELECT doc_id, url, {_sql} AS result FROM urls")

_VARIANTS = f"""
variants AS (
  SELECT u.*, v.variant_pos - CASE WHEN starts_with(base, 'www.') AND v.variant_pos > 0 THEN 1 ELSE 0 END AS variant_pos,
    v.prefix || base AS host
  FROM (SELECT *, {_low("domain")} AS base FROM targets) u
  JOIN ({_values([(0, ""), (1, "www.")] + [(i + 2, p + ".") for i, p in enumerate(HOST_PREFIXES)])}) v(variant_pos, prefix)
    ON NOT (starts_with(base, 'www.') AND prefix = 'www.'))"""

_oracle("domain_variants", "urls", f"""
WITH targets AS (SELECT doc_id, {_url_netloc("url")} AS domain FROM urls WHERE url IS NOT NULL), {_VARIANTS}
SELECT doc_id, CAST(variant_pos AS INT) AS variant_pos, host FROM variants""")

_oracle("year_range", "", """
SELECT doc_id, CAST(unnest([2019, 2020, 2021]) AS INT) AS year FROM documents""")

_oracle("keyword_hits", "articles",
        f"SELECT doc_id, {_hit_text('text', ALL_TERMS)} AS hits FROM articles")
_oracle("url_keyword_filter", "articles",
        f"SELECT doc_id, url FROM articles WHERE len({_hits('url', ALL_TERMS)}) > 0")
_oracle("body_keyword_filter", "articles",
        f"SELECT doc_id, year FROM articles WHERE len({_hits('text', TIER1_TERMS)}) > 0")
_oracle("dictionary_hits", "articles", f"""WITH terms AS (
  SELECT list(DISTINCT lower(term)) AS terms FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark UNION ALL SELECT source FROM documents)
  WHERE term <> '')
SELECT doc_id, array_to_string(list_sort(list_filter(terms, lambda t: contains(lower(text), t))), ';') AS hits FROM articles, terms""")
_oracle("has_date", "articles", f"SELECT doc_id, {_dated('text')} AS dated FROM articles")


def _pieces(x: str) -> str:
    """Stripped, non-empty text pieces of texts between tags, as a list."""
    for char, entity in (("©", "&copy;?"), ("·", "&middot;?"), ('"', "&quot;?"), ("é", "&eacute;?"), ("–", "&#8211;?"),
                         ("…", "&hellip;?"), ("<", "&lt;?"), (">", "&gt;?"), ("&", "&amp;?")):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    stripped = f"list_transform(string_split({x}, chr(1)), lambda p: {_strip('p')})"
    return f"list_filter({stripped}, lambda q: q <> '')"


# The pages tag by tag, each with the names of the open elements and their numbers;
# a container holds the texts after tags during which it is open.
_TAG = r"""</?[a-zA-Z](?:[^>"]|"[^"]*")*>"""
_KINDS = ["name = 'article'", *(f"name = 'div' AND list_contains(classes, '{c}')" for c in BODY_DIV_CLASSES), "name = 'body'"]
_OPENS_NOTHING = "name IN ('br', 'img', 'meta', 'hr', 'link', 'input') OR ends_with(tag, '/>')"
_CUT_AT = "len(names) - list_position(list_reverse(names), name)"
_TEXTS = rf"""
cuts AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>|<![^>]*>', chr(1), 'g'),
    '({_TAG})', chr(2) || '\1' || chr(3), 'g'), chr(2)) AS parts FROM crawl_pages),
parts AS (SELECT page_id, unnest(range(1, len(parts))) AS k, unnest(parts[2:]) AS part FROM cuts),
tags AS (
  SELECT page_id, k, split_part(part, chr(3), 1) AS tag, split_part(part, chr(3), 2) AS after,
    lower(regexp_extract(part, '^</?([^\s/>]+)', 1)) AS name, string_split(regexp_extract(part, '^<[^>]* class="?([^">]*)', 1), ' ') AS classes
  FROM parts),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS ks FROM cuts
  UNION ALL
  SELECT t.page_id, t.k,
    CASE WHEN starts_with(tag, '</') THEN CASE WHEN list_contains(names, name) THEN names[1:{_CUT_AT}] ELSE names END
      WHEN {_OPENS_NOTHING} THEN names ELSE list_append(names, name) END,
    CASE WHEN starts_with(tag, '</') THEN CASE WHEN list_contains(names, name) THEN ks[1:{_CUT_AT}] ELSE ks END
      WHEN {_OPENS_NOTHING} THEN ks ELSE list_append(ks, t.k) END
  FROM walk w JOIN tags t ON t.page_id = w.page_id AND t.k = w.k + 1),
firsts AS (
  SELECT page_id, {", ".join(f"min(k) FILTER (WHERE NOT starts_with(tag, '</') AND {kind}) AS f{i}" for i, kind in enumerate(_KINDS))}
  FROM tags GROUP BY page_id),
within AS (
  SELECT page_id, {", ".join(f"string_agg(after, chr(1) ORDER BY k) FILTER (WHERE list_contains(ks, f{i})) AS w{i}" for i in range(len(_KINDS)))}
  FROM walk JOIN tags USING (page_id, k) JOIN firsts USING (page_id) GROUP BY page_id),
pieces AS (SELECT page_id, {", ".join(f"{_pieces(f'w{i}')} AS c{i}" for i in range(len(_KINDS)))} FROM within),
texts AS (
  SELECT page_id, CASE {" ".join(f"WHEN length(array_to_string(c{i}, '')) > 1000 THEN array_to_string(c{i}, {NL})" for i in range(len(_KINDS)))}
    ELSE '' END AS text FROM cuts LEFT JOIN pieces USING (page_id))"""

_oracle("html_text", "crawl_pages", f"WITH {_TEXTS} SELECT page_id, text FROM texts")
_oracle("min_chars", "",
        f"SELECT doc_id, n_chars FROM documents WHERE length({_strip('text')}) > 1000")

_RACE_COLUMNS = [rating_column(r, f"{role}_race") for role in ROLES for r in RATERS]
for _name, _normalise, _columns in (
    ("norm_label", _label, [rating_column(r, "crime_label") for r in RATERS]),
    ("norm_yes_no", _yes_no, [rating_column(r, v) for v in BINARY_VARIABLES for r in RATERS]),
    ("norm_race_irr", _race_irr, _RACE_COLUMNS),
    ("norm_gender_irr", _gender_irr, [rating_column(r, f"{role}_gender") for role in ROLES for r in RATERS]),
    ("norm_race_oe", _race_oe, _RACE_COLUMNS),
    ("norm_race_counts", _race_counts, _RACE_COLUMNS),
):
    _oracle(_name, "ratings", "SELECT art_num, "
            + ", ".join(f"{_normalise(c)} AS {c}" for c in _columns) + " FROM ratings")

_NORMAL = "normal AS (SELECT art_num, " + ", ".join(
    f"{_normal(v, rating_column(r, v))} AS {rating_column(r, v)}" for v in VARIABLES for r in RATERS
) + " FROM ratings)"
_oracle("normalise_ratings", "ratings", f"WITH {_NORMAL} SELECT * FROM normal")

_LEANING = f"""
leaning AS (
  SELECT p.*, s.ideology, s.state, {_nowww("p.url")} AS url_norm,
    CASE WHEN s.ideology < 0 THEN 'negative' ELSE 'positive' END AS ideology_label
  FROM people p JOIN sources s ON {_nowww("p.url")} = {_low("s.URL")}
  WHERE s.ideology <> 0)"""

_RAW_RACES = " UNION ALL ".join(
    f"SELECT '{role}' AS role, '{m}' AS model, {rating_column(m, f'{role}_race')} AS answer, ideology_label AS ideology FROM leaning"
    for role in ROLES for m in MODELS)
_oracle("clean_race_series", "people sources", f"""WITH {_LEANING},
answers AS ({_RAW_RACES}),
counts AS (SELECT role, model, {_low("coalesce(answer, 'nan')")} AS race, ideology, count(*) AS count FROM answers GROUP BY role, model, answer, ideology)
SELECT role, model, race, ideology, count FROM counts WHERE race NOT IN ('not provided', 'not_provided', 'none', '')""")

_SCORED = f"""
scored AS (SELECT a.*, {_url_domain("a.url")} AS domain, s.ideology
  FROM articles a JOIN sources s ON {_url_domain("a.url")} IS NOT DISTINCT FROM {_url_domain("s.URL")}
  WHERE s.ideology IS NOT NULL)"""
_BIN = "CASE " + " ".join(
    f"WHEN ideology > CAST({lo} AS DOUBLE) AND ideology <= CAST({hi} AS DOUBLE) THEN '{name}'"
    for (lo, hi), name in zip(((-1, -0.1), (-0.1, 0.1), (0.1, 1)), IDEOLOGY_BINS)
) + " END"
_HIST = """CASE WHEN ideology = 1 THEN 19 WHEN ideology BETWEEN -1 AND 1
  THEN (SELECT max(i) + 1 FROM range(19) e(i) WHERE CAST(i AS DOUBLE) * (CAST(2 AS DOUBLE) / 19) - 1 <= ideology) END"""

_oracle("ideology_sign", "articles sources", f"""WITH {_SCORED}
SELECT doc_id, ideology, CASE WHEN ideology < 0 THEN 'negative' WHEN ideology > 0 THEN 'positive' END AS sign FROM scored""")
_oracle("ideology_bin", "articles sources",
        f"WITH {_SCORED} SELECT doc_id, ideology, {_BIN} AS category FROM scored")
_oracle("hist_bin_19", "articles sources",
        f"WITH {_SCORED} SELECT doc_id, ideology, CAST({_HIST} AS INT) AS bin FROM scored")

_POPULATION = "population(state, white_prop, black_prop, other_prop) AS (SELECT a, CAST(b AS DOUBLE), CAST(c AS DOUBLE), " \
    "1 - (CAST(b AS DOUBLE) + CAST(c AS DOUBLE)) FROM (" + _values(
        (s, w, b) for s, (w, b) in STATE_POPULATION.items()) + ") v(a, b, c))"
_REGIONS = "regions(state, region) AS (" + _values(
    (s, r) for r, states in REGION_STATES.items() for s in states) + ")"

_oracle("pop_other_share", "articles", f"""WITH {_POPULATION}
SELECT state, count(*) AS n, round(any_value(other_prop), 6) AS other_prop
FROM articles JOIN population USING (state) GROUP BY state""")
_oracle("valid_state", "articles",
        f"SELECT doc_id, state FROM articles WHERE state IN ({_quoted(VALID_STATES)})")
_oracle("header_normalise", "", "SELECT doc_id, lang, source FROM documents")

_SURVEY_COLUMNS = [f"ART{a:04d}_{q}" for a in (1, 2, 13) for q in SURVEY_QUESTIONS.values()]
_ANSWERS = "answers AS (" + " UNION ALL ".join(
    f"SELECT rater, '{c}' AS col, {c} AS value FROM survey" for c in _SURVEY_COLUMNS) + ")"
_oracle("survey_unpivot", "survey", f"WITH {_ANSWERS} SELECT rater, col, value FROM answers")
_oracle("survey_key_parse", "survey", f"""WITH {_ANSWERS}
SELECT rater, col, value, CAST(substr(col, 4, 4) AS INT) AS art_num, substr(col, 9) AS question FROM answers""")
_oracle("survey_pivot", "survey", "WITH " + _ANSWERS + """
SELECT rater, CAST(substr(col, 4, 4) AS INT) AS art_num, """ + ", ".join(
    f"max(value) FILTER (substr(col, 9) = '{q}') AS {q}" for q in SURVEY_QUESTIONS.values()
) + " FROM answers WHERE value IS NOT NULL GROUP BY 1, 2")

_MAPPED = "mapped AS (SELECT rater, art_num, " + ", ".join(
    f"{_normal(v, q)} AS {v}" for v, q in SURVEY_QUESTIONS.items()) + " FROM sheets)"
_oracle("survey_question_map", "sheets", f"WITH {_MAPPED} SELECT * FROM mapped")


def _unpivot_votes(table: str, columns: dict[str, list[str]], value) -> str:
    """Long form ``(art_num, variable, vote)`` of the columns to vote on."""
    return " UNION ALL ".join(
        f"SELECT art_num, '{v}' AS variable, {value(c)} AS vote FROM {table}"
        for v, listed in columns.items()
        for c in listed
    )


def _elected(long: str, unique: bool) -> str:
    """Winner per article and variable by counting votes in groups."""
    rule = "at_top = 1" if unique else "top > 1"
    return f"""
tally AS (SELECT art_num, variable, vote, count(*) AS n FROM ({long}) WHERE vote IS NOT NULL GROUP BY ALL),
tops AS (SELECT *, max(n) OVER (PARTITION BY art_num, variable) AS top FROM tally),
winners AS (SELECT art_num, variable, min(vote) AS vote, count(*) AS at_top, min(top) AS top FROM tops WHERE n = top GROUP BY ALL),
elected AS (SELECT art_num, variable, vote FROM winners WHERE {rule})"""


def _elected_wide(variables, suffix: str, final=lambda x: x) -> str:
    picks = ", ".join(
        f"{final(f'max(e.vote) FILTER (e.variable = {_quoted([v])})')} AS {v}{suffix}" for v in variables
    )
    return f"SELECT r.art_num, {picks} FROM ratings r LEFT JOIN elected e USING (art_num) GROUP BY r.art_num"


_MODEL_COLUMNS = {v: [rating_column(m, v) for m in MODELS] for v in VARIABLES}
_ROLE_COLUMNS = {f"{r}_race": _MODEL_COLUMNS[f"{r}_race"] for r in ROLES}
_RAW_VOTE = lambda c: f"CASE WHEN {_low(c)} IN ('', 'not_provided') THEN NULL ELSE {_low(c)} END"

_oracle("majority_strict", "ratings", f"""WITH {_NORMAL},
{_elected(_unpivot_votes("normal", _MODEL_COLUMNS, lambda c: c), unique=False)}
{_elected_wide(VARIABLES, "_llm_majority")}""")
_oracle("vote_then_norm", "ratings", f"""WITH
{_elected(_unpivot_votes("ratings", _ROLE_COLUMNS, _RAW_VOTE), unique=True).strip()}
{_elected_wide(_ROLE_COLUMNS, "", _race_oe)}""")
_oracle("norm_then_vote", "ratings", f"""WITH
{_elected(_unpivot_votes("ratings", _ROLE_COLUMNS, _race_counts), unique=True).strip()}
{_elected_wide(_ROLE_COLUMNS, "")}""")

_LABELS = [rating_column(r, "crime_label") for r in RATERS]
_AGREE = f"len(list_distinct(list_filter([{', '.join(_LABELS)}], lambda x: x IS NOT NULL))) <= 1"
_oracle("all_agree", "ratings", f"WITH {_NORMAL} SELECT art_num, {_AGREE} AS agree FROM normal")


def _ratio(keys: str, table: str) -> str:
    ratio, half = "observed / expected", "1.96 / sqrt(observed)"
    low, high = f"exp(ln({ratio}) - {half})", f"exp(ln({ratio}) + {half})"
    both = "observed > 0 AND expected > 0"
    return f"""SELECT {keys},
  CASE WHEN expected > 0 THEN round({ratio}, 6) END AS ratio,
  CASE WHEN {both} THEN round({low}, 6) END AS ci_lower, CASE WHEN {both} THEN round({high}, 6) END AS ci_upper,
  CASE WHEN {both} THEN round(greatest({ratio} - {low}, 0), 6) END AS err_low,
  CASE WHEN {both} THEN round(greatest({high} - {ratio}, 0), 6) END AS err_high
FROM {table}"""


_oracle("oe_ratio_ci", "", _ratio("l_suppkey, observed, expected", """(
  SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS observed,
    sum(CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS expected
  FROM lineitem GROUP BY l_suppkey)"""))

_RAW_LONG = " UNION ALL ".join(
    f"SELECT art_num, '{v}' AS variable, '{r}' AS rater, {RATERS.index(r)} AS ord, {rating_column(r, v)} AS value FROM {{table}}"
    for v in VARIABLES for r in RATERS)
_oracle("ratings_wide_to_long", "ratings",
        f"SELECT art_num, variable, rater, value FROM ({_RAW_LONG.format(table='ratings')})")
_TITLES = "titles(variable, title) AS (" + _values(VARIABLES.items()) + ")"
_oracle("variable_labels", "ratings", f"""WITH {_TITLES}
SELECT title AS variable, count(value) AS n FROM ({_RAW_LONG.format(table='ratings')}) JOIN titles USING (variable) GROUP BY 1""")

# --- joins --------------------------------------------------------------------

_COLLECTIONS = "collections(year, collection, coll_pos) AS (" + _values(
    (y, c, i) for y, cs in CRAWL_COLLECTIONS.items() for i, c in enumerate(cs)) + ")"
_CANDIDATES = f"""
targets AS (SELECT source_id, name AS source, state, coalesce(nullif({_netloc("URL")}, ''), URL) AS domain FROM crawl_sources),
{_VARIANTS}, {_COLLECTIONS},
candidates AS (
  SELECT v.source_id, v.source, v.state, c.year, c.collection, v.host, v.variant_pos, c.coll_pos, i.url, i.filename, i.rec_offset, i.index_pos
  FROM variants v JOIN collections c ON true
  JOIN crawl_index i ON i.collection = c.collection AND lower({_netloc("i.url")}) = v.host)"""
_oracle("crawl_candidates", "crawl_index crawl_sources", f"""WITH {_CANDIDATES}
SELECT source_id, source, CAST(year AS INT) AS year, collection, host, CAST(variant_pos AS INT) AS variant_pos,
  CAST(coll_pos AS INT) AS coll_pos, url FROM candidates""")
_oracle("collect_matched_articles", "crawl_index crawl_sources", f"""WITH {_CANDIDATES}, {_TEXTS},
found AS (
  SELECT c.*, t.text, row_number() OVER (PARTITION BY source_id, year ORDER BY variant_pos, coll_pos, c.index_pos) AS place
  FROM candidates c JOIN crawl_pages p USING (filename, rec_offset) JOIN texts t USING (page_id)
  WHERE len({_hits("c.url", ALL_TERMS)}) > 0 AND length({_strip("t.text")}) > 1000)
SELECT source, state, url, CAST(year AS INT) AS year, {_hit_text("url", ALL_TERMS)} AS matched_keywords, text
FROM found WHERE place <= 80""")

_oracle("articles_with_ideology", "articles sources",
        f"WITH {_SCORED} SELECT doc_id, domain, ideology FROM scored")
_oracle("people_with_ideology", "people sources", f"""WITH {_LEANING}
SELECT art_num, l_linenumber, l_partkey, l_suppkey, url_norm, ideology, ideology_label, state FROM leaning""")
_oracle("people_with_population", "people sources", f"""WITH {_LEANING}, {_POPULATION}
SELECT art_num, l_linenumber, l_partkey, l_suppkey, state, white_prop, black_prop, round(other_prop, 6) AS other_prop
FROM leaning JOIN population USING (state)""")
_oracle("region_lookup", "articles", f"""WITH {_REGIONS}
SELECT a.doc_id, a.state, r.region FROM articles a LEFT JOIN regions r ON a.state = r.state""")

_HUMANS = "humans AS (SELECT a.art_num, " + ", ".join(
    f"{x}.{v} AS {rater}_{v}" for x, rater in (("a", "eleanor"), ("b", "sarah")) for v in VARIABLES
) + " FROM mapped a JOIN mapped b ON a.art_num = b.art_num AND a.rater = 'Eleanor' AND b.rater = 'Sarah')"
_oracle("human_pair", "sheets", f"WITH {_MAPPED}, {_HUMANS} SELECT * FROM humans")

_PEOPLE_COLUMNS = [rating_column(m, v) for v in VARIABLES for m in MODELS]
_FIRST = """
placed AS (SELECT *, row_number() OVER (PARTITION BY art_num ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM people),
firsts AS (SELECT art_num, """ + ", ".join(
    f"arg_min({c}, place) FILTER ({c} IS NOT NULL) AS {c}" for c in _PEOPLE_COLUMNS
) + " FROM placed GROUP BY art_num)"
_oracle("first_non_null", "people", f"WITH {_FIRST} SELECT * FROM firsts")
_oracle("model_human_merge", "people sheets", f"WITH {_FIRST}, {_MAPPED}, {_HUMANS} SELECT h.*, " + ", ".join(
    f"{_normal(v, f'f.{rating_column(m, v)}')} AS {rating_column(m, v)}" for v in VARIABLES for m in MODELS
) + " FROM humans h JOIN firsts f USING (art_num)")

_PAIRS = f"""{_NORMAL},
ratings_long AS ({_RAW_LONG.format(table="normal")}),
all_pairs AS (
  SELECT a.art_num, a.variable, a.rater AS rater_1, b.rater AS rater_2, a.value AS value_1, b.value AS value_2
  FROM ratings_long a JOIN ratings_long b ON a.art_num = b.art_num AND a.variable = b.variable AND a.ord < b.ord),
pairs AS (SELECT * FROM all_pairs WHERE value_1 IS NOT NULL AND value_2 IS NOT NULL)"""
_oracle("rater_pairs", "ratings", f"""WITH {_PAIRS}
SELECT variable, rater_1, rater_2, value_1, value_2, count(*) AS n, CAST(sum(art_num) AS BIGINT) AS art_nums
FROM all_pairs GROUP BY ALL""")

_oracle("resume_filter", "articles", f"""WITH
done AS (SELECT {_url_netloc("url")} AS domain, max(year) AS last_year FROM articles WHERE year <= 2018 + doc_id % 5 GROUP BY 1),
targets AS (SELECT doc_id, {_url_netloc("url")} AS domain, CAST(y AS INT) AS year FROM articles, range(2018, 2025) r(y))
SELECT doc_id, t.domain, year FROM targets t LEFT JOIN done d ON t.domain = d.domain
WHERE d.last_year IS NULL OR t.year > d.last_year""")

# --- aggregations -------------------------------------------------------------

_oracle("curation_funnel", "articles", f"""
SELECT count(*) AS total, count(*) FILTER (dated AND hit) AS kept, count(*) FILTER (NOT dated) AS no_date,
  count(*) FILTER (dated AND NOT hit) AS no_keyword
FROM (SELECT {_dated("text")} AS dated, len({_hits("text", TIER1_TERMS)}) > 0 AS hit FROM articles)""")
_oracle("curated_articles", "articles", f"""WITH {_CURATED}
SELECT doc_id, url, year, source, state, tier1_keywords, tier2_keywords, text FROM curated""")
_oracle("last_year_per_domain", "articles", f"""
SELECT {_url_netloc("url")} AS domain, max(year) AS last_year FROM articles GROUP BY 1""")

_oracle("ideology_bin_counts", "articles sources", f"""WITH {_SCORED},
bins(bin_pos, category) AS ({_values(enumerate(IDEOLOGY_BINS))})
SELECT CAST(bin_pos AS INT) AS bin_pos, b.category, count(s.category) AS count
FROM bins b LEFT JOIN (SELECT {_BIN} AS category FROM scored) s ON b.category = s.category GROUP BY ALL""")
_oracle("ideology_hist", "articles sources", f"""WITH {_SCORED}
SELECT CAST(i AS INT) AS bin, count(s.bin) AS count
FROM range(1, 20) r(i) LEFT JOIN (SELECT {_HIST} AS bin FROM scored) s ON r.i = s.bin GROUP BY ALL""")
_oracle("ideology_mean_median", "articles sources", f"""WITH {_SCORED}
SELECT round(avg(ideology), 6) AS mean, round(median(ideology), 6) AS median FROM scored""")
_oracle("state_counts", "articles", f"""
SELECT state, count(*) AS count FROM articles WHERE state IN ({_quoted(VALID_STATES)})
GROUP BY state ORDER BY count DESC, state""")
_oracle("region_counts", "articles", f"""WITH {_REGIONS}
SELECT region, count(*) AS count, count(DISTINCT state) AS n_states FROM articles JOIN regions USING (state)
GROUP BY region ORDER BY count DESC, region""")


def _person_votes(value) -> str:
    """Every person's three answers per role, in long form, keyed by person."""
    return " UNION ALL ".join(
        f"SELECT person AS art_num, '{role}' AS variable, {value(c)} AS vote FROM persons"
        for role in ROLES
        for c in _ROLE_COLUMNS[f"{role}_race"]
    )


_PERSONS = f"""{_LEANING},
persons AS (SELECT *, row_number() OVER (ORDER BY art_num, l_linenumber, l_partkey, l_suppkey) AS person FROM leaning)"""
_RACE_COUNTS = f"""{_PERSONS},
{_elected(_person_votes(_race_counts), unique=True).strip()},
race_counts AS (SELECT e.variable AS role, e.vote AS race, p.ideology_label AS ideology, count(*) AS count
  FROM elected e JOIN persons p ON e.art_num = p.person GROUP BY ALL)"""
_ROLLUP = f"""{_RACE_COUNTS},
rollup_all AS (SELECT * FROM race_counts UNION ALL SELECT role, race, 'all', CAST(sum(count) AS BIGINT) FROM race_counts GROUP BY role, race)"""
for _name in ("race_counts", "sink_race_counts"):
    _oracle(_name, "people sources",
            f"WITH {_RACE_COUNTS} SELECT role, race, ideology, count FROM race_counts")
_oracle("race_rollup_all", "people sources",
        f"WITH {_ROLLUP} SELECT role, race, ideology, count FROM rollup_all")
_oracle("race_share", "people sources", f"""WITH {_ROLLUP}
SELECT role, race, ideology, count, round(count / (SELECT sum(count) FROM rollup_all t WHERE t.ideology = r.ideology), 6) AS proportion
FROM rollup_all r""")
_oracle("race_oe", "people sources", f"""WITH {_PERSONS}, {_POPULATION},
{_elected(_person_votes(_RAW_VOTE), unique=True).strip()},
voted AS (
  SELECT p.ideology_label AS ideology, e.variable AS role, {_race_oe("e.vote")} AS race, white_prop, black_prop, other_prop
  FROM elected e JOIN persons p ON e.art_num = p.person JOIN population USING (state)),
cells AS (
  SELECT g.ideology, g.role, g.race, count(*) FILTER (v.race = g.race) AS observed,
    coalesce(sum(CASE g.race WHEN 'white' THEN white_prop WHEN 'black' THEN black_prop ELSE other_prop END) FILTER (v.race IS NOT NULL), 0) AS expected
  FROM ({_values((i, o, r) for i in ("negative", "positive") for o in ROLES for r in ("white", "black", "other"))}) g(ideology, role, race)
  LEFT JOIN voted v ON v.ideology = g.ideology AND v.role = g.role GROUP BY ALL)
{_ratio("ideology, role, race, observed, round(expected, 6) AS expected", "cells")}""")

_METRICS = """
agreement AS (SELECT variable, rater_1, rater_2, count(*) AS n, avg(CASE WHEN value_1 = value_2 THEN 1.0 ELSE 0.0 END) AS po FROM pairs GROUP BY ALL),
first_rater AS (SELECT variable, rater_1, rater_2, value_1 AS v, count(*) AS c FROM pairs GROUP BY ALL),
second_rater AS (SELECT variable, rater_1, rater_2, value_2 AS v, count(*) AS c FROM pairs GROUP BY ALL),
pooled AS (SELECT variable, rater_1, rater_2, v, sum(c) AS c FROM (SELECT * FROM first_rater UNION ALL SELECT * FROM second_rater) GROUP BY ALL),
chance AS (
  SELECT variable, rater_1, rater_2, a.n, a.po,
    coalesce((SELECT sum(x.c * y.c) FROM first_rater x JOIN second_rater y USING (variable, rater_1, rater_2, v)
      WHERE x.variable = a.variable AND x.rater_1 = a.rater_1 AND x.rater_2 = a.rater_2), 0) / (CAST(a.n AS DOUBLE) * a.n) AS pe,
    (SELECT sum(CAST(c AS DOUBLE) * c) FROM pooled p WHERE p.variable = a.variable AND p.rater_1 = a.rater_1 AND p.rater_2 = a.rater_2)
      / (4 * CAST(a.n AS DOUBLE) * a.n) AS ps
  FROM agreement a),
metrics AS (
  SELECT variable, rater_1, rater_2, n, CASE WHEN n >= 2 THEN (po - pe) / nullif(1 - pe, 0) END AS kappa,
    1 - (1 - po) / nullif(1 - ps, 0) AS alpha FROM chance)"""
_IS_BINARY = f"variable IN ({_quoted(BINARY_VARIABLES)})"
_oracle("cohen_kappa", "ratings", f"""WITH {_PAIRS}, {_METRICS}
SELECT variable, rater_1, rater_2, round(kappa, 6) AS value, n FROM metrics WHERE {_IS_BINARY}""")
_oracle("nominal_alpha_pairs", "ratings", f"""WITH {_PAIRS}, {_METRICS}
SELECT variable, rater_1, rater_2, round(alpha, 6) AS value, n FROM metrics WHERE NOT ({_IS_BINARY})""")
_oracle("nominal_alpha", "ratings", f"""WITH {_PAIRS},
ordered_pairs AS (SELECT variable, value_1 AS v, value_2 AS w FROM pairs UNION ALL SELECT variable, value_2, value_1 FROM pairs),
observed AS (SELECT variable, count(*) AS n, avg(CASE WHEN v <> w THEN 1.0 ELSE 0.0 END) AS d FROM ordered_pairs GROUP BY 1),
expected AS (SELECT variable, 1 - sum(c * c) / (sum(c) * sum(c)) AS d FROM (
  SELECT variable, v, CAST(count(*) AS DOUBLE) AS c FROM ordered_pairs GROUP BY ALL) GROUP BY 1)
SELECT variable, round(1 - o.d / nullif(e.d, 0), 6) AS value FROM observed o JOIN expected e USING (variable)""")
_oracle("label_kappa", "", """WITH
t AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
s AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po,
  avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM t)
SELECT 'crime_present' AS variable, 'eleanor' AS rater_1, 'sarah' AS rater_2, round((po - pe) / (1 - pe), 6) AS value, n FROM s""")
_oracle("coincidence_matrix", "ratings", f"""WITH {_PAIRS}
SELECT variable, value_1, value_2, count(*) AS n FROM (
  SELECT variable, value_1, value_2 FROM pairs UNION ALL SELECT variable, value_2, value_1 FROM pairs) GROUP BY ALL""")
_oracle("pair_valid_n", "ratings", f"""WITH {_PAIRS}
SELECT variable, rater_1, rater_2, count(*) FILTER (value_1 IS NOT NULL AND value_2 IS NOT NULL) AS n FROM all_pairs GROUP BY ALL""")

_IRR = f"""{_PAIRS}, {_METRICS}, {_TITLES},
irr AS (SELECT variable, rater_1, rater_2, CASE WHEN {_IS_BINARY} THEN 'cohens_kappa' ELSE 'krippendorff_alpha' END AS metric,
  round_even(CASE WHEN {_IS_BINARY} THEN kappa ELSE alpha END, 3) AS value, n FROM metrics)"""
_HUMAN_ONLY = "rater_1 = 'eleanor' AND rater_2 = 'sarah'"
_HUMAN_MODEL = f"rater_1 IN ('eleanor', 'sarah') AND rater_2 IN ({_quoted(MODELS)})"
_TITLED = "SELECT {extra}title AS variable, rater_1, rater_2, metric, value, n FROM irr JOIN titles USING (variable) WHERE {where}"
_oracle("irr_table", "ratings", f"WITH {_IRR} SELECT * FROM irr")
_oracle("irr_human_only", "ratings",
        f"WITH {_IRR} " + _TITLED.format(extra="", where=_HUMAN_ONLY))
_oracle("irr_human_vs_model", "ratings",
        f"WITH {_IRR} " + _TITLED.format(extra="", where=_HUMAN_MODEL))
_oracle("sink_irr_tables", "ratings", f"WITH {_IRR} "
        + _TITLED.format(extra="'irr_human_only' AS file, ", where=_HUMAN_ONLY) + " UNION ALL "
        + _TITLED.format(extra="'irr_human_vs_llm' AS file, ", where=_HUMAN_MODEL)
        # Disagreements: a row per article, its labels in one cell.
        + f""" UNION ALL SELECT 'crime_label_disagreements' AS file, 'crime_label' AS variable,
  concat_ws('|', {", ".join(f"coalesce({c}, '-')" for c in _LABELS)}) AS rater_1,
  NULL AS rater_2, 'false' AS metric, NULL AS value, art_num AS n
FROM (WITH {_NORMAL} SELECT * FROM normal) d WHERE NOT ({_AGREE})""")
_oracle("label_disagreements", "ratings", f"WITH {_NORMAL} SELECT art_num, " + ", ".join(
    f"{c} AS {r}" for r, c in zip(RATERS, _LABELS)) + f", {_AGREE} AS all_agree FROM normal WHERE NOT ({_AGREE})")

# --- windows, sets, reshape ---------------------------------------------------

_oracle("cap_per_source_year", "matched", """
SELECT source_id, year, variant_pos, coll_pos, index_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, year ORDER BY variant_pos, coll_pos, index_pos) AS place FROM matched)
WHERE place <= 80""")
_oracle("keyword_union", "articles", f"""
SELECT term, count(doc_id) AS n FROM (SELECT DISTINCT unnest([{_quoted(ALL_TERMS)}]) AS term) k
LEFT JOIN articles a ON contains(lower(a.text), k.term) GROUP BY term""")
_oracle("hits_distinct", "articles",
        f"SELECT doc_id, CAST(len({_hits('text', TIER2_TERMS)}) AS INT) AS n_hits FROM articles")

ORACLES["irr_table_by_batches"] = ORACLES["irr_table"]
