"""Views that dress the test tables up as news-corpus inputs.

Each view is one SELECT that Spark and DuckDB both read; ``{table}`` names a
base table. They only relabel rows: every row of the base table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.dims import HUMANS, MODELS, RATERS, SURVEY_QUESTIONS, VARIABLES, rating_column


# Words that the two engines spell differently.
SPARK_WORDS = {"at": "element_at", "list": "array"}
DUCKDB_WORDS = {"at": "list_extract", "list": "list_value"}


def _pick(values: list[str | None], key: str) -> str:
    """The value at ``key`` modulo their number."""
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"{{at}}({{list}}({listed}), CAST(({key}) % {len(values)} + 1 AS INT))"


# Raw answers as raters type them.
_ANSWERS: dict[str, list[str | None]] = {
    "yes_no": ["Yes", "no", " TRUE", "0", None, "maybe", "false", "1"],
    "race": ["white", " White", "Black", "Hispanic", "unknown", "not_provided", "multiple",
             None, "asian", "not provided", "", "black"],
    "gender": ["male", "Female ", "unknown", "Nonbinary/Other", "not provided", None],
    "label": ["Murder", "theft ", "Assault", "none", "arson", None, "THEFT"],
}


def _kind(variable: str) -> str:
    if variable.endswith("_race"):
        return "race"
    if variable.endswith("_gender"):
        return "gender"
    return "label" if variable == "crime_label" else "yes_no"


def _answer(variable: str, rater: str, key: str, noise: str) -> str:
    """Raters mostly give the answer of ``key``; the later ones stray more often."""
    i, j = RATERS.index(rater), list(VARIABLES).index(variable)
    values = _ANSWERS[_kind(variable)]
    stray = f"CASE WHEN ({noise} + {3 * i + j}) % 10 < {9 - i} THEN 0 ELSE {i + 1} END"
    return _pick(values, f"{key} + {j} + {stray}")


def _answers(raters: tuple[str, ...], key: str, noise: str) -> str:
    return ",\n  ".join(
        f"{_answer(v, r, key, noise)} AS {rating_column(r, v)}" for v in VARIABLES for r in raters
    )


_SURVEY_COLUMNS = [
    (f"ART{a:04d}_{text}", v, a) for a in (1, 2, 13) for v, text in SURVEY_QUESTIONS.items()
]

VIEWS = {
    # Date style by doc_id % 5, keywords by doc_id % 4.
    "articles": """
SELECT doc_id,
  'https://' || CASE WHEN doc_id % 3 = 0 THEN 'www.' ELSE '' END || source || '.example.com/a/' || CAST(doc_id AS STRING)
    || CASE doc_id % 4 WHEN 0 THEN '-sexual-assault' WHEN 1 THEN '-victim-shot' ELSE '' END AS url,
  CAST(2018 + doc_id % 7 AS INT) AS year, source,
  CASE doc_id % 11 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'NY' WHEN 3 THEN 'IL' WHEN 4 THEN 'DC' WHEN 5 THEN 'XX'
    WHEN 6 THEN 'ca' WHEN 7 THEN 'OH' WHEN 8 THEN 'FL' WHEN 9 THEN NULL ELSE 'WA' END AS state,
  CASE doc_id % 5 WHEN 0 THEN 'Posted March 3, 2020. ' WHEN 1 THEN '2021-04-05 ' WHEN 2 THEN 'le 3 août 2019 ' WHEN 3 THEN 'x12345-1-1 ' ELSE '' END
    || CASE doc_id % 4 WHEN 0 THEN 'A Sexual-Assault and a convict on trial. ' WHEN 1 THEN 'the -suspects fled; a convict. '
       WHEN 2 THEN 'MURDER and shooting crime. ' ELSE '' END || text AS text
FROM {documents}""",
    # Scores -1.0 ... 0.9 meet every bin edge.
    "sources": """
SELECT DISTINCT source AS name, source || '.example.com' AS URL,
  CAST(CAST(substr(source, 4) AS INT) - 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS ideology,
  CASE CAST(substr(source, 4) AS INT) % 6 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'NY' WHEN 3 THEN 'DC' WHEN 4 THEN 'XX' ELSE 'OH' END AS state,
  source AS source_id
FROM {documents}""",
    # One person per line item; an order is an article. row_idx is the place of a
    # person among those of an article, by the four columns before.
    "people": f"""
SELECT l_orderkey AS art_num,
  'https://www.src' || CAST(l_orderkey % 23 AS STRING) || '.example.com/p/' || CAST(l_orderkey AS STRING) AS url,
  {_answers(MODELS, "l_partkey", "l_suppkey + l_linenumber")},
  l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_idx
FROM {{lineitem}}""",
    # One article per order, rated by all five.
    "ratings": f"""
SELECT o_orderkey AS art_num,
  {_answers(RATERS, "o_custkey", "o_orderkey")}
FROM {{orders}}""",
    # Answer sheets: two orders make one article, some articles lack a coder.
    "sheets": """
SELECT CASE WHEN o_orderkey % 7 = 3 THEN 'Third' WHEN o_orderkey % 2 = 0 THEN 'Eleanor' ELSE 'Sarah' END AS rater,
  CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS art_num,
  """ + ",\n  ".join(
        f'{_answer(v, "eleanor", "o_custkey", "o_orderkey")} AS {text}'
        for v, text in SURVEY_QUESTIONS.items()
    ) + """
FROM {orders}""",
    # Exports of a thousand articles with a row for each of two coders.
    "exports": """
SELECT CAST((art_num - art_num % 1000) / 1000 AS BIGINT) AS export, CAST(art_num % 1000 + 1 AS INT) AS art, coder, """
    + ", ".join(SURVEY_QUESTIONS.values()) + """
FROM (SELECT CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS art_num, CAST(o_orderkey % 2 AS INT) AS coder,
  """ + ",\n  ".join(
        f'{_answer(v, "eleanor", "o_custkey", "o_orderkey")} AS {text}'
        for v, text in SURVEY_QUESTIONS.items()
    ) + """
FROM {orders}) a""",
    # A wide survey export with one respondent per order.
    "survey": "\nSELECT 'R' || CAST(o_orderkey AS STRING) AS rater, o_orderpriority AS note,\n  "
    + ",\n  ".join(
        f"CASE WHEN (o_orderkey + {a}) % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 5 AND {a} = 1 THEN "
        + f"""chr(123) || '"ImportId"' || chr(125) ELSE {_answer(v, "sarah", f"o_custkey + {a}", "o_orderkey")} END AS {name}"""
        for name, v, a in _SURVEY_COLUMNS
    )
    + "\nFROM {orders}",
    # Text and HTML pages keyed like crawl records, in four kinds of container; some with
    # unclosed, stray, self-closed or mis-nested tags, decoys in attributes and entities.
    "crawl_pages": """
SELECT page_id, 'w/' || CAST(page_id % 10 AS STRING) || '.warc' AS filename, page_id * 1000 AS rec_offset,
  url || CASE page_id % 4 WHEN 0 THEN '&t=sexual-assault' WHEN 1 THEN '&t=-victim-shot' WHEN 2 THEN '&T=Murder' ELSE '' END AS url,
  CASE page_id % 3 WHEN 0 THEN html
    WHEN 1 THEN replace(replace(html, '<article>', '<div class="story article-body">'), '</article>', '</div>')
    ELSE replace(replace(html, '<article>', '<section>'), '</article>', '</section>') END AS html
FROM (SELECT page_id, url, CASE page_id % 8
    WHEN 1 THEN replace(html, '<h1>', '<div class="x"><h1>')
    WHEN 2 THEN replace(html, '</h1>', '</h1></aside></span></li>')
    WHEN 3 THEN replace(html, '</h1>', '</h1><div/><article/><img src="a>b" alt="<article id=x>"/>')
    WHEN 4 THEN replace(replace(html, '<article>', '<main><article>'), '</p>', '</p></main>')
    WHEN 5 THEN replace(html, '</h1>', ' &lt;p&gt; caf&eacute; &#8211; &hellip;</h1><div title="x > y">in <b>it</div> after')
    WHEN 6 THEN replace(html, '<h1>', '<article class=inner><h1>')
    ELSE html END AS html FROM {pages}) p""",
    "crawl_index": """
SELECT url, filename, rec_offset, 500 + page_id AS length, page_id AS index_pos,
  CASE page_id % 5 WHEN 0 THEN 'CC-MAIN-2018-43' WHEN 1 THEN 'CC-MAIN-2019-09' WHEN 2 THEN 'CC-MAIN-2024-10'
    WHEN 3 THEN 'CC-MAIN-2024-51' ELSE 'CC-MAIN-2021-04' END AS collection
FROM {crawl_pages} p
UNION ALL
SELECT url, filename, rec_offset, 500 + page_id AS length, page_id AS index_pos, 'CC-MAIN-2024-18' AS collection
FROM {crawl_pages} q WHERE page_id % 3 = 0""",
    "crawl_sources": """
SELECT DISTINCT domain AS source_id, 'The ' || domain AS name, 'CA' AS state, 'City' AS city,
  CASE WHEN length(domain) % 2 = 0 THEN 'https://' || domain || '/home' ELSE domain END AS URL
FROM (SELECT regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(www|m|blog)[.]', '') AS domain FROM {pages}) d""",
    # Source inventory with gaps, one row per customer.
    "inventory": """
SELECT CASE c_custkey % 13 WHEN 0 THEN NULL ELSE c_name END AS name,
  CASE c_nationkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN NULL WHEN 3 THEN 'NY' ELSE 'DC' END AS state,
  CASE c_custkey % 7 WHEN 0 THEN 'n/a' ELSE c_mktsegment END AS city,
  CASE c_custkey % 11 WHEN 0 THEN 'NA' ELSE 'https://www.s' || CAST(c_custkey AS STRING) || '.example.com, "x"' END AS URL
FROM {customer}""",
    # URLs in many shapes, one per document.
    "urls": """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'HTTPS://User:pw@WWW.' || source || '.Example.com:8080/A?b#c'
    WHEN 1 THEN source || '.example.com/path/' || CAST(doc_id AS STRING)
    WHEN 2 THEN ' https://www.' || source || '.example.com '
    WHEN 3 THEN '//cdn.' || source || '.example.com?x=1/2'
    WHEN 4 THEN 'http://' || source || '.example.com#top/x'
    WHEN 5 THEN 'www.' || source || '.EXAMPLE.com'
    WHEN 6 THEN NULL
    WHEN 7 THEN 'https://www.' || source || '.example.com/a-shooting?x=' || CAST(doc_id AS STRING)
    ELSE 'http://[' || source || '.example.com/x' END AS url
FROM {documents}""",
    # Matched articles by source and year; several groups exceed the cap.
    "matched": """
SELECT l_suppkey AS source_id, CAST(year(l_shipdate) AS INT) AS year,
  CAST(l_linenumber % 7 AS INT) AS variant_pos, CAST(l_partkey % 10 AS INT) AS coll_pos,
  lpad(CAST(l_orderkey AS STRING), 12, '0') || lpad(CAST(l_partkey AS STRING), 12, '0')
    || lpad(CAST(l_suppkey AS STRING), 12, '0') || lpad(CAST(l_linenumber AS STRING), 4, '0') AS index_pos
FROM {lineitem}""",
}

# Views that build on other views.
USES = {"crawl_index": ["crawl_pages"]}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Spark computes what stands beside a window function before it and would shuffle and sort the answers.
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_idx"
SPARK_VIEWS = {"people": VIEWS["people"].replace(_PLACE, "row_idx").replace("{lineitem}", f"(SELECT *, {_PLACE} FROM {{lineitem}}) l")}

COMPILED_BYTES = 8000  #: HotSpot interprets methods of more


class Tables:
    """Base tables and views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Views of many columns make longer methods than the JVM compiles; such stages run without whole-stage code.
        if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > COMPILED_BYTES:
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = SPARK_VIEWS.get(name, VIEWS[name])
        needed = [t for t in (*BASE_TABLES, *VIEWS) if f"{{{t}}}" in sql]
        tables = {t: f"{{{t}}}" for t in needed}
        text = sql.format(**SPARK_WORDS, **tables)
        return self.spark.sql(text, **{t: getattr(self, t) for t in needed})


class StoredViews(Tables):
    """Views written to Parquet once, as a corpus would be, and read from there."""

    def __init__(self, spark: SparkSession, folder: str, store: str, files: int):
        super().__init__(spark, folder)
        self.store, self.files, self.written = store, files, set()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in BASE_TABLES:
            raise AttributeError(name)
        path = f"{self.store}/{name}"
        if name not in self.written:
            rows = super().__getattr__(name).repartition(self.files)
            rows.write.mode("overwrite").parquet(path)
            self.written.add(name)
        return self.spark.read.parquet(path)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB."""
    ordered = []
    for name in names:
        ordered += [n for n in (*USES.get(name, []), name) if n not in ordered]
    words = {t: t for t in (*BASE_TABLES, *VIEWS)} | DUCKDB_WORDS
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].format(**words)})" for n in ordered)
