"""Derived inputs: portable SQL over the driver tables.

The same text runs on Spark (``spark.sql`` with DataFrame parameters) and, as
common table expressions, in the oracle. Every table covers its whole source.
A failed fetch is a page row without html.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "https://learn.example.org"

UNIT_PAGES = """
SELECT page_id,
  concat('https://learn.example.org/en-us/training/modules/mod-', CAST(floor(page_id/8) AS BIGINT), '/',
    page_id % 8 + 1, '-', CASE page_id % 4 WHEN 0 THEN 'introduction' WHEN 1 THEN 'provision'
    WHEN 2 THEN 'exercise' ELSE 'summary' END) AS url,
  CASE WHEN page_id % 17 = 16 THEN NULL ELSE
  replace(html, '</h1>', concat('</h1><h2>Part ', page_id % 7, '</h2><p>short</p><figure><img src="',
    CASE page_id % 5 WHEN 0 THEN '../../wwl/media/arch-diagram.png' WHEN 1 THEN '/media/portal-screen.png?v=2'
      WHEN 2 THEN 'media/plot.svg' WHEN 3 THEN 'https://cdn.example.org/a/b/guide.png'
      ELSE '//cdn.example.org/x.png' END,
    '" alt="', CASE page_id % 6 WHEN 0 THEN 'Resource hierarchy' WHEN 1 THEN 'Portal window' WHEN 2 THEN 'a > b'
      WHEN 3 THEN 'Syntax &amp; sample' WHEN 4 THEN 'Save button' ELSE '' END,
    '" title="t', page_id, '"><figcaption>Figure ', page_id, '</figcaption></figure><p>',
    CASE WHEN page_id % 9 = 0 THEN 'tiny' ELSE concat('Paragraph that <b>follows</b> image ', page_id, '.') END,
    '</p><pre><code>print(', page_id, ')  # sample</code></pre><a href="#part">jump</a>')) END AS html
FROM {pages}
"""

MODULE_PAGES = """
SELECT m AS page_id, concat('https://learn.example.org/en-us/training/modules/mod-', m, '/') AS url,
  CASE WHEN m % 13 = 12 THEN NULL ELSE
  concat('<main><h1>Module <b>', m, '</b></h1><a href="/about">About</a><a href="1-introduction">Introduction</a>',
    '<a href="4-summary">Wrap up</a><a href="3-exercise">Try it</a><a href="2-provision">Provision</a>',
    '<a href="1-introduction">Introduction again</a><a href="5-introduction"></a><a href="6-provision">More</a>',
    '<a href="7-exercise">Practice</a><a href="8-summary">Summary</a></main>') END AS html
FROM (SELECT DISTINCT CAST(floor(page_id/8) AS BIGINT) AS m FROM {pages}) t
"""

PATH_PAGES = """
SELECT p AS page_id, concat('https://learn.example.org/en-us/training/paths/path-', p, '-3d/') AS url,
  concat('<article><h1>Path ', p, '</h1><a href="../../modules/mod-', 4*p, '/">Module ', 4*p, '</a>',
    '<a href="/modules/mod-', 4*p+1, '"></a><a href="/modules/mod-', 4*p+1, '">Module ', 4*p+1, '</a>',
    '<a href="/training/modules/mod-', 4*p+2, '/">Module ', 4*p+2, '</a>',
    '<a href="https://learn.example.org/en-us/training/modules/mod-', 4*p+3, '/">Module ', 4*p+3, '</a>',
    '<a href="../../modules/mod-', 4*p, '">Module copy</a></article>') AS html
FROM (SELECT DISTINCT CAST(floor(page_id/32) AS BIGINT) AS p FROM {pages}) t
"""

COURSE_PAGES = """
SELECT c AS page_id, concat('https://learn.example.org/en-us/training/courses/c-', c) AS url,
  concat('<main><h1>Course ', c, '</h1><article data-learn-uid="learn.wwl.path-', 3*c, '-3d"></article>',
    '<article data-learn-uid="learn.wwl.path-', 3*c+1, '-3d"></article><article data-learn-uid="other.x"></article>',
    '<article>no uid</article><article data-learn-uid="learn.wwl.path-', 3*c+2, '-3d"></article></main>') AS html
FROM (SELECT DISTINCT CAST(floor(page_id/96) AS BIGINT) AS c FROM {pages}) t
"""

PAGE_STORE = """
SELECT url, html FROM {unit_pages} UNION ALL SELECT url, html FROM {module_pages}
UNION ALL SELECT url, html FROM {path_pages} UNION ALL SELECT url, html FROM {course_pages}
"""

SEEDS = "SELECT url AS course_url FROM {course_pages}"

UNIT_SNAPSHOT = """
SELECT page_id,
  concat('https://learn.example.org/en-us/training/courses/c-', CAST(floor(page_id/96) AS BIGINT)) AS course_url,
  concat('Path ', CAST(floor(page_id/32) AS BIGINT)) AS path_title,
  concat('Module', CAST(floor(page_id/8) AS BIGINT)) AS module_title,
  CASE page_id % 8 WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Provision' WHEN 2 THEN 'Try it' WHEN 3 THEN 'Wrap up'
    WHEN 4 THEN '' WHEN 5 THEN 'More' WHEN 6 THEN 'Practice' ELSE 'Summary' END AS unit_title,
  CASE WHEN page_id % 3 <> 0 OR page_id % 9 = 0 THEN '' ELSE concat('stored content ', page_id) END AS content
FROM {pages}
"""

QUESTION_BANK = """
SELECT doc_id AS question_id, text AS question, concat('first ', doc_id) AS option_a,
  concat('second ', doc_id) AS option_b, concat('third ', doc_id) AS option_c,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE concat('fourth ', doc_id) END AS option_d,
  CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS correct_answer,
  CASE WHEN doc_id % 19 = 0 THEN '' ELSE text END AS explanation, source AS learning_path,
  concat(source, '-', lang) AS module, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE '' END AS additional_notes,
  CASE WHEN doc_id % 10 < 3 THEN 'easy' WHEN doc_id % 10 < 8 THEN 'medium' ELSE 'hard' END AS difficulty
FROM {documents}
"""

# answers before they have a position; the position is assigned by ordinals
ANSWER_EVENTS = """
SELECT event_id, user_id AS attempt_id, ts, event_id % (SELECT count(*) FROM {documents}) AS question_id,
  CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN ' b' WHEN 2 THEN 'C' WHEN 3 THEN 'd ' WHEN 4 THEN 'x' ELSE 'B' END
    AS user_answer
FROM {events}
"""

REQUEST = """
SELECT source AS learning_path, 5 + count(*) % 7 AS requested,
  CASE WHEN count(*) % 2 = 0 THEN 'even' ELSE 'proportional' END AS distribution
FROM {documents} GROUP BY source
"""

DERIVED = {
    "unit_pages": UNIT_PAGES,
    "module_pages": MODULE_PAGES,
    "path_pages": PATH_PAGES,
    "course_pages": COURSE_PAGES,
    "page_store": PAGE_STORE,
    "seeds": SEEDS,
    "unit_snapshot": UNIT_SNAPSHOT,
    "question_bank": QUESTION_BANK,
    "answer_events": ANSWER_EVENTS,
    "request": REQUEST,
}


def inputs_of(name: str) -> list[str]:
    """Tables a derived table reads, in order of appearance."""
    text = DERIVED[name]
    return [t for t in [*DERIVED, "pages", "documents", "events", "benchmark"] if "{" + t + "}" in text]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived table as a DataFrame."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(DERIVED[name], **{t: table(spark, sf_dir, t) for t in inputs_of(name)})


def derived_ctes(*names: str) -> str:
    """``WITH``-list text of derived tables and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in DERIVED and name not in done:
            for needed in inputs_of(name):
                add(needed)
            text = DERIVED[name].format(**{needed: needed for needed in inputs_of(name)})
            done[name] = f"{name} AS ({text.strip()})"

    for name in names:
        add(name)
    return ",\n".join(done.values())


# --- small relations the registered queries add on top -------------------

NUMBER_CASES = """
SELECT page_id,
  concat('https://learn.example.org/training/modules/', CASE page_id % 6 WHEN 0 THEN '3-things/summary'
    WHEN 1 THEN concat('m', page_id, '/', page_id % 40, '-unit') WHEN 2 THEN 'mod/exercise' WHEN 3 THEN 'mod/check'
    WHEN 4 THEN 'mod/other' ELSE concat('mod/x', page_id, '-y') END) AS unit_url,
  CASE page_id % 7 WHEN 0 THEN concat(page_id, '. Start') WHEN 1 THEN 'Exercise summary' WHEN 2 THEN 'Introduction'
    WHEN 3 THEN 'Knowledge-check' WHEN 4 THEN 'Exercise' WHEN 5 THEN 'Module assessment' ELSE 'Overview' END AS title
FROM {pages}
"""

SELECTIONS = """
SELECT attempt_id, CASE attempt_id % 5 WHEN 0 THEN '1,99' WHEN 1 THEN '1,x' WHEN 2 THEN '99' WHEN 3 THEN '2, 3'
  ELSE '' END AS selection,
  CASE attempt_id % 6 WHEN 0 THEN '' WHEN 1 THEN '5' WHEN 2 THEN '0' WHEN 3 THEN 'abc' WHEN 4 THEN '100000'
  ELSE ' 7 ' END AS requested
FROM (SELECT DISTINCT user_id AS attempt_id FROM {events}) t
"""

BATCHES = """
SELECT 1 AS batch, doc_id AS question_id, text AS question FROM {documents}
UNION ALL SELECT 2 AS batch, item_id AS question_id, text AS question FROM {benchmark}
"""

MODULE_CATALOG = """
SELECT DISTINCT source AS learning_path, concat(source, '-', lang) AS module FROM {documents}
UNION SELECT concat('src', item_id % 25) AS learning_path, concat('src', item_id % 25, '-', CASE item_id % 3
  WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'it' END) AS module FROM {benchmark}
"""

# one line per question, whole texts; some are cut short, some lack or rename a key
QUESTION_LINES = """
SELECT question_id, CASE
  WHEN question_id % 29 = 0 THEN concat('{{"question": "', quoted, '", "module": "')
  WHEN question_id % 13 = 0 THEN concat('{{"question": "', quoted, '", "options": {{"A": "x"}}, "answer": "A", "module": "',
    source, '", "learning_path": "', lang, '", "explanation": "', quoted, '"}}')
  ELSE concat('{{"question": "', quoted, '", "options": {{"A": "x"}}, "correct_answer": "A", "module": "', source,
    '", "learning_path": "', lang, '", "explanation": "', quoted, '", "additional_notes": ""}}') END AS line
FROM (SELECT doc_id AS question_id, source, lang, replace(replace(replace(replace(replace(text,
    chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')),
    chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')) AS quoted FROM {documents}) t
"""

DERIVED.update({
    "number_cases": NUMBER_CASES,
    "selections": SELECTIONS,
    "batches": BATCHES,
    "module_catalog": MODULE_CATALOG,
    "question_lines": QUESTION_LINES,
})
