"""Stand-in inputs derived from the driver's test tables.

The test tables hold no bibliography, rank pages, paper metadata or rating
responses, so these views reshape them into the schemas the operators expect.
They do none of the operators' work.  The SQL text is shared with the DuckDB
oracle (``{table}`` placeholders are filled with DataFrames in Spark and with
view names in DuckDB), so both engines see identical inputs.
"""

from __future__ import annotations

import json
import os

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    # bibliography records: repeated DOIs, rows without DOI, a venue type
    # outside conf/journals; 'workload' and 'for' hit the mid-word 'or' split.
    # ord is the dump order.
    "bib": """
SELECT o_orderkey AS rec_id, o_orderkey AS ord,
 concat(CASE o_orderstatus WHEN 'F' THEN 'conf' WHEN 'O' THEN 'journals' ELSE 'phd' END, '/v',
        CAST(o_custkey % 40 AS STRING), '/K', CAST(o_orderkey AS STRING)) AS key,
 concat(p_name, ' for ', lower(p_type), ' workload ', lower(substr(o_orderpriority, 3))) AS title,
 CAST(year(o_orderdate) AS INT) AS year,
 CASE WHEN o_custkey % 7 = 0 THEN concat('https://example.org/x', CAST(o_orderkey AS STRING))
      ELSE concat('https://doi.org/10.', CAST(1000 + o_custkey % 9000 AS STRING), '/Bib.', CAST(o_custkey AS STRING)) END AS ee
FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200
""",
    # one small review per distinct name and type of parts
    "part_studies": """
SELECT CAST(min(p_partkey) AS BIGINT) AS study_id, split_part(p_name, ' ', 1) AS w1, lower(p_type) AS w2, split_part(p_name, ' ', 2) AS w3,
 CAST(1995 + min(p_partkey) % 5 AS BIGINT) AS year_min, CAST(1995 + min(p_partkey) % 5 + min(p_partkey) % 2 AS BIGINT) AS year_max,
 CASE min(p_partkey) % 3 WHEN 0 THEN 'A*' WHEN 1 THEN 'B' ELSE 'C' END AS venue_rank_threshold,
 CASE WHEN min(p_partkey) % 4 = 0 THEN 'phd' ELSE 'conf' END AS venue_type
FROM {part} GROUP BY p_name, p_type
""",
    # their allow-lists as rows: prefixes of several lengths, some within others
    "part_allow": """
SELECT CAST(min(p_partkey) AS BIGINT) AS study_id, concat('conf/v', CAST(max(p_size) % 40 AS STRING)) AS prefix FROM {part} GROUP BY p_name, p_type
UNION ALL SELECT CAST(min(p_partkey) AS BIGINT), concat('conf/v', CAST(max(p_size) % 10 AS STRING)) FROM {part} GROUP BY p_name, p_type
UNION ALL SELECT CAST(min(p_partkey) AS BIGINT), concat('phd/v3/K', CAST(max(p_size) AS STRING)) FROM {part} GROUP BY p_name, p_type
""",
    # venue ranks as a plain table: v0..v24 ranked, v25..v39 missing
    "ranks": """
SELECT concat('v', CAST(n_nationkey AS STRING)) AS venue_code,
 CASE n_regionkey WHEN 0 THEN 'A*' WHEN 1 THEN 'a' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'Australasian B' END AS rank_text
FROM {nation}
""",
    # one rank page per nation: header row, then title / acronym / source / rank
    "rank_html": """
SELECT CAST(n_regionkey AS BIGINT) AS page_id,
 concat('<table><tr><th>Title</th><th>Acronym</th><th>Source</th><th>Rank</th></tr><tr><td>Venue ', n_name,
        '</td><td> V', CAST(n_nationkey AS STRING), ' </td><td>S</td><td>',
        CASE n_regionkey WHEN 0 THEN 'A*' WHEN 1 THEN 'a' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'Australasian B' END,
        '</td></tr></table>') AS html
FROM {nation}
""",
    # paper metadata: joins bib on DOI; empty and NULL texts included
    "meta": """
SELECT concat('10.', CAST(1000 + doc_id % 9000 AS STRING), '/Bib.', CAST(doc_id AS STRING)) AS doi,
 CAST(doc_id AS STRING) AS semantic_scholar_id,
 CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 1, 400) END AS abstract,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(text, 1, 60) END AS tldr,
 doc_id % 2 = 0 AS is_open_access,
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('https://pdf.example.org/', CAST(doc_id AS STRING)) END AS pdf_url,
 CAST(n_chars % 500 AS INT) AS citations, CAST(n_chars % 20 AS INT) AS influential_citations
FROM {documents}
""",
    # web pages with the site-specific routes
    "web": """
SELECT page_id,
 CASE page_id % 3 WHEN 0 THEN concat('https://ieeexplore.ieee.org/document/', CAST(page_id AS STRING))
                  WHEN 1 THEN concat('https://arxiv.org/abs/', CAST(page_id AS STRING)) ELSE url END AS url,
 CASE page_id % 3 WHEN 0 THEN concat('<meta property="og:description" content="Summary ', CAST(page_id AS STRING), '">', html)
                  WHEN 1 THEN concat('<div id="abs">Abstract: item ', CAST(page_id AS STRING), '</div>', html)
                  ELSE html END AS html
FROM {pages}
""",
    # rating responses for two criteria, keyed like meta.semantic_scholar_id
    "llm": """
SELECT doc_id, concat('{{"ratings":["', CAST(1 + 6 * quality AS STRING), '","', CAST(1 + 3 * toxic AS STRING), '"]}}') AS response
FROM {labels}
""",
    # rating responses used by the review run: the first rating passes for
    # good documents, the second for non-toxic ones
    "responses": """
SELECT doc_id, concat('{{"ratings":["', CAST(1 + 6 * quality AS STRING), '","', CAST(7 - 3 * toxic AS STRING), '"]}}') AS response
FROM {labels}
""",
    # per-row query expressions next to bib titles: plain disjunctions,
    # conjunctions, and CNF strings with blanks and nested parentheses
    "exprs": """
SELECT o_orderkey AS rec_id,
 concat(p.p_name, ' for ', lower(p.p_type), ' workload ', lower(substr(o_orderpriority, 3))) AS title,
 concat(q.p_name, ' or ', lower(q.p_type), ' OR ', substr(o_orderpriority, 3)) AS or_expr,
 concat(substr(q.p_name, 1, 3), ' AND ', lower(p.p_type), ' and ', CASE WHEN o_custkey % 3 = 0 THEN 'load' ELSE 'rand' END) AS and_expr,
 CASE o_orderkey % 4
   WHEN 0 THEN concat('(', q.p_name, ' OR ', lower(q.p_type), ') AND (', lower(substr(o_orderpriority, 3)), ' or zzz)')
   WHEN 1 THEN concat('( ', substr(q.p_name, 1, 4), ' ) AND (', lower(p.p_type), ')')
   WHEN 2 THEN concat(lower(q.p_type), ' and workload')
   ELSE concat('(', substr(q.p_name, 1, 3), ' OR ((x)) AND (', lower(q.p_type), ' OR ring)') END AS cnf_expr
FROM {orders} JOIN {part} p ON p.p_partkey = o_orderkey % 200
              JOIN {part} q ON q.p_partkey = (o_orderkey * 7 + 3) % 200
""",
    # title search index for identifier resolution: the same titles as bib,
    # many hits per title, some hits without DOI; hit_rank orders the hits
    "title_index": """
SELECT concat(p_name, ' for ', lower(p_type), ' workload ', lower(substr(o_orderpriority, 3))) AS title,
 concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS semantic_scholar_id,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL
      ELSE concat('10.', CAST(1000 + l_suppkey % 9000 AS STRING), '/Idx.', CAST(l_orderkey AS STRING)) END AS doi,
 l_orderkey * 8 + l_linenumber AS hit_rank
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey % 200
""",
    # bibliography titles as people cite them: words left out, added, reordered
    # or set in capitals; DOI as in bib
    "cited": """
SELECT o_orderkey AS rec_id,
 CASE o_orderkey % 5
   WHEN 0 THEN concat(p_name, ' for ', lower(p_type), ' workload ', lower(substr(o_orderpriority, 3)))
   WHEN 1 THEN concat(p_name, ': ', lower(p_type), ', ', lower(substr(o_orderpriority, 3)))
   WHEN 2 THEN concat('On ', p_name, ' for ', lower(p_type), ' workload (', lower(substr(o_orderpriority, 3)), ') - a survey')
   WHEN 3 THEN upper(concat(lower(p_type), ' WORKLOAD, ', p_name))
   ELSE concat(p_name, ' and something else entirely') END AS title,
 CASE WHEN o_custkey % 7 = 0 THEN NULL
      ELSE concat('10.', CAST(1000 + o_custkey % 9000 AS STRING), '/Bib.', CAST(o_custkey AS STRING)) END AS doi
FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200
""",
    # landing pages: the page a bib publisher link (url) leads to, with the
    # final URL after redirects and its html (the web routes above)
    "landing": """
SELECT concat('https://doi.org/10.', CAST(1000 + page_id % 9000 AS STRING), '/Bib.', CAST(page_id AS STRING)) AS url,
 CASE page_id % 3 WHEN 0 THEN concat('https://ieeexplore.ieee.org/document/', CAST(page_id AS STRING))
                  WHEN 1 THEN concat('https://arxiv.org/abs/', CAST(page_id AS STRING)) ELSE url END AS final_url,
 CASE page_id % 3 WHEN 0 THEN concat('<meta property="og:description" content="Summary ', CAST(page_id AS STRING), '">', html)
                  WHEN 1 THEN concat('<div id="abs">Abstract: item ', CAST(page_id AS STRING), '</div>', html)
                  ELSE html END AS html
FROM {pages}
""",
    # pages whose lists, blocks and tables nest, around two pieces of a text
    "nested": """
SELECT doc_id, a, b,
 concat('<html><body><div id="top"><ul class="x>y"><li>no', a, '<ul><li>no</li><li>no<ul><li>', b, '</li></ul></li></ul>no</li></ul>',
        '<div id="abs">', a, '<div>inner<ul><li>no</li></ul></div><br>', b, '</div></li>tail<script>var t = "<ul>";</script></div>',
        '<table><tr><th>h</th></tr><tr><td>', a, '</td><td><table><tr><td>', b, '</td></tr></table></td><td>x</td></tr></table></body></html>') AS html
FROM (SELECT doc_id, trim(translate(substr(coalesce(text, ''), 1, 40), concat('<>&', chr(9), chr(10), chr(13)), '      ')) AS a,
             concat('doc ', CAST(doc_id AS STRING)) AS b FROM {documents}) t
""",
    # pilot set for recall: DOIs of documents labelled high quality, every
    # fifth in upper case (recall is case-sensitive)
    "pilots": """
SELECT doc_id AS pilot_id,
 CASE WHEN doc_id % 5 = 0 THEN upper(concat('10.', CAST(1000 + doc_id % 9000 AS STRING), '/Bib.', CAST(doc_id AS STRING)))
      ELSE concat('10.', CAST(1000 + doc_id % 9000 AS STRING), '/Bib.', CAST(doc_id AS STRING)) END AS doi
FROM {labels} WHERE quality = 1
""",
    # rating responses in the shapes a validator must judge: valid, numbers
    # instead of strings, an extra key, an escaped quote, an empty list, not a
    # list, broken JSON, a bare array (chr(92) is a backslash in both engines)
    "raw_responses": """
SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN concat('{{"ratings":["', CAST(1 + 6 * quality AS STRING), '","', CAST(1 + 3 * toxic AS STRING), '"]}}')
  WHEN 1 THEN concat('{{"ratings":[', CAST(1 + 6 * quality AS STRING), ']}}')
  WHEN 2 THEN concat('{{"ratings":["', CAST(quality AS STRING), '"],"note":"x"}}')
  WHEN 3 THEN concat('{{"ratings":["a', chr(92), '"b", "', CAST(toxic AS STRING), '"]}}')
  WHEN 4 THEN '{{ "ratings" : [ ] }}'
  WHEN 5 THEN concat('{{"ratings":"', CAST(quality AS STRING), '"}}')
  WHEN 6 THEN concat('{{"ratings":["', CAST(quality AS STRING), '"]')
  ELSE concat('["', CAST(toxic AS STRING), '"]') END AS response
FROM {labels}
""",
    # study spec documents to validate: one per customer, some invalid
    "spec_docs": """
SELECT c_custkey AS doc_id,
 concat('{{',
   CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('"search_word_groups": [["', lower(c_mktsegment), '"]], ') END,
   CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '"inclusion_criteria": ["English"], ' END,
   '"year_min": ', CAST(1990 + c_nationkey - 3 * CAST(c_custkey % 17 = 0 AS INT) * 700 AS STRING), ', ',
   '"year_max": ', CASE WHEN c_custkey % 19 = 0 THEN '"2001"' ELSE CAST(2000 + c_nationkey AS STRING) END,
   CASE c_custkey % 5 WHEN 0 THEN ', "venue_rank_threshold": "A*"' WHEN 1 THEN ', "venue_rank_threshold": "D"'
                      WHEN 2 THEN ', "venue_rank_threshold": "B"' ELSE '' END,
   CASE c_custkey % 7 WHEN 0 THEN ', "accepted_venue_types": ["conf", "blog"]'
                      WHEN 1 THEN ', "accepted_venue_types": ["journals"]' ELSE '' END,
   CASE WHEN c_custkey % 23 = 0 THEN ', "extra_key": 1' ELSE '' END,
 '}}') AS doc
FROM {customer}
""",
}


def view_sql(name: str) -> str:
    return VIEWS[name]


def duckdb_view_sql(name: str) -> str:
    """The same view text for DuckDB (table names in place of placeholders)."""
    return VIEWS[name].format(**{t: t for t in BASE_TABLES}).replace("AS STRING)", "AS VARCHAR)")


# A test table that is one local file below this size is read by few tasks.
SPREAD_BELOW_BYTES = 1 << 30

# Views that look ``part`` up by ``p_partkey = <key> % 200``: no other keys than the
# remainders, from -199 to 199, can match, whatever the tables hold.
PART_BY_REMAINDER = {"bib": 200, "exprs": 200, "title_index": 200, "cited": 200}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  The test tables are single small Parquet files (one row
    group), so their scan is one task; such a table is spread over the
    default parallelism (round-robin, which Spark keeps deterministic under
    retries) so per-row work uses every core.  Files with a row group for every
    core, and tables stored as many files, as on a cluster, are read as they are."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if os.path.isfile(path) and os.path.getsize(path) < SPREAD_BELOW_BYTES and pq.read_metadata(path).num_row_groups < cores:
        df = df.repartition(cores)
    return df


def _parts_by_remainder(part: DataFrame, n: int) -> DataFrame:
    """The parts a join on ``p_partkey = <key> % n`` can meet, broadcast if their number
    allows: by shuffle, its few key values would hold whole tables in few tasks."""
    return bounded_broadcast(part.where(F.abs("p_partkey") < n), name="parts")[0]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived view over the parquet tables of ``sf_dir``."""
    sql = VIEWS[name]
    used = {t: base_table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in sql}
    if name in PART_BY_REMAINDER:
        used["part"] = _parts_by_remainder(used["part"], PART_BY_REMAINDER[name])
    return spark.sql(sql, **used)


# --- review parameters --------------------------------------------------------
# Four reviews run together over the bibliography.  They cover the substring
# quirks, a NULL threshold, the strict 'A*' threshold, an absent venue-type
# list (accept all), allow-list prefixes and criteria counts 1, 2 and 3.
REVIEW_SPECS: list[dict] = [
    {
        "study_name": "Rings and anvils under load",
        "research_goal": "Which parts fail under economy workloads?",
        "research_questions": ["Which parts?", "Which loads?"],
        "inclusion_criteria": ["Study is written in English", "Presents at least one method"],
        "year_min": 1996, "year_max": 1999,
        "search_word_groups": [["ring", "anvil", "gizmo"], ["economy", "promo", "standard"], ["urgent", "high", "low"]],
        "venue_rank_threshold": "B",
        "accepted_venue_types": ["conf", "journals"],
        "manually_accepted_venue_codes": ["conf/v3", "journals/v27"],
    },
    {
        "study_name": "Orchestration of bolts",
        "inclusion_criteria": ["Study is written in English", "Reports an evaluation"],
        "year_min": 1995, "year_max": 2001,
        "search_word_groups": [["orchestrat", "bolt"], ["workload"], ["for"]],
        "accepted_venue_types": ["conf", "phd"],
    },
    {
        "study_name": "Large widgets and gears",
        "inclusion_criteria": ["Presents at least one method"],
        "year_min": 1997, "year_max": 1998,
        "search_word_groups": [["widget", "gear"], ["large", "small"]],
        "venue_rank_threshold": "A*",
        "accepted_venue_types": ["journals"],
        "manually_accepted_venue_codes": [],
    },
    {
        "study_name": "Plates",
        "inclusion_criteria": ["Study is written in English", "Presents at least one method", "Is peer reviewed"],
        "year_min": 1995, "year_max": 1996,
        "search_word_groups": [["plate", "rod"]],
        "venue_rank_threshold": "C",
    },
]

# Run date recorded for every study of the review run.
RUN_DATE = "2024-09-09"
DUMP_NAME = "bib.parquet"


def spec_json(i: int) -> str:
    return json.dumps(REVIEW_SPECS[i])


def spec_rows() -> list[tuple[int, str]]:
    """(study_id, spec JSON) rows; ids start at 1."""
    return [(i + 1, json.dumps(s)) for i, s in enumerate(REVIEW_SPECS)]
