"""Course -> learning path -> module -> unit from a page store.

The levels are worked off one after the other. The URLs that a level wants form
its frontier; a fixed-size bitmap of their hashes is broadcast to the page store,
and only pages it lets through are parsed, each for what its level needs. Pages
beyond a limit, unit pages that are not asked for and units that an earlier run
has stored are never tokenised, and raw html never crosses the network: a page
becomes a narrow record in the scan stage, and the joins on URL read those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions import markup, urls
from coursemill.functions.columns import let
from coursemill.operators import content, resume, structure
from coursemill.operators.sieve import sieve
from coursemill.sources.staging import Scratch, stage

#: Bits of a frontier's filter: as a broadcast table it takes at most an eighth of that in bytes, whatever the frontier.
FILTER_BITS = 1 << 26
CONTENT_FIELDS = ["content", "headings", "code_blocks", "images", "links"]
UNIT_KEYS = ["course_url", "path_ord", "module_ord", "unit_ord"]


@dataclass(frozen=True)
class Limits:
    """Children expanded per parent; None or 0 means all of them, a negative number all but so many at the end."""

    paths: int | None = None
    modules: int | None = None
    units: int | None = None

    @staticmethod
    def selects(ord_column: str, limit: int | None) -> str:
        """Condition on a child's place; ``siblings`` is the number of children."""
        if not limit:
            return f"{ord_column} IS NOT NULL"
        return f"{ord_column} < {limit}" if limit > 0 else f"{ord_column} < siblings - {-limit}"


def page_lookup(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier URLs with their html; null html is a failed fetch."""
    return frontier.join(pages.select("url", "html"), "url", "left")


def frontier_pages(pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """``(url, html)`` of the ``pages`` whose URL may be in ``frontier(url)``, without a shuffle of pages.

    No wanted page is lost. Others pass with the share of set bits, so a frontier
    much larger than ``FILTER_BITS`` only saves less; the join on URL that follows decides.
    """
    return sieve(pages.select("url", "html"), frontier, "url", FILTER_BITS)


def _facts(pages: DataFrame, parsed: str | None, *more: str) -> DataFrame:
    """One narrow record per page row; an empty page counts as a failed fetch, like one without html."""
    columns = ["url", "monotonically_increasing_id() AS row_id", "coalesce(html <> '', false) AS fetched",
               "xxhash64(html) AS html_digest", *more]
    if parsed is None:
        return pages.selectExpr(*columns)
    return pages.selectExpr(*columns, f"IF(coalesce(html, '') = '', NULL, {parsed}) AS f").selectExpr(
        "url", "row_id", "fetched", "html_digest", *(m.split(" AS ")[-1] for m in more), "f.*")


def level_facts(pages: DataFrame, level: str, site: str = urls.SITE) -> DataFrame:
    """``(url, row_id, fetched, html_digest, title, children)`` of course, path or module pages."""

    def fields(doc: str) -> str:
        children = {
            "course": lambda: structure.path_links(doc, site),
            "path": lambda: structure.module_links(structure.anchors(doc), "url", site),
            "module": lambda: structure.unit_links(structure.anchors(doc), "url"),
        }[level]()
        return f"named_struct('title', {structure.page_title(doc)}, 'children', {children})"

    return _facts(pages, let(markup.document("html", False), fields))


def unit_facts(pages: DataFrame, fields: list[str], site: str = urls.SITE) -> DataFrame:
    """``(url, row_id, fetched, html_digest, html_bytes[, fields...])`` of unit pages; without fields nothing is parsed."""
    parsed = let(markup.document("html", True), lambda doc: content.record(doc, "url", site, fields)) if fields else None
    return _facts(pages, parsed, "coalesce(octet_length(html), 0) AS html_bytes")


def unique_pages(facts: DataFrame) -> DataFrame:
    """One record per URL: a fetched page before a failed one, then the least digest of the html.

    ``facts`` is a written table, so its row ids hold. Only ids and digests are
    shuffled; records are dropped by id, and where nothing repeats none is.
    """
    rank = F.struct(~F.col("fetched"), "html_digest", "row_id")
    repeated = facts.groupBy("url").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    surplus = facts.select("url", "row_id").join(repeated, "url").where("row_id <> first.row_id").select("row_id")
    return facts.join(surplus, "row_id", "left_anti")


def _expand(rows: DataFrame, facts: DataFrame, level: str, selected: str, anchor: str) -> DataFrame:
    """Join the rows' page records.

    Rows that are not looked up get a key of their own instead of null, which
    spreads them over the partitions of the join.
    """
    looked_up = facts.selectExpr("url AS page_key", "fetched AS page_fetched", "title AS page_title", "children")
    keyed = rows.withColumn(
        "row_key", F.expr(f"IF({selected}, {level}_url, concat('-', coalesce({level}_url, {anchor})))")
    )
    joined = keyed.join(looked_up, F.col("row_key") == F.col("page_key"), "left")
    return joined.withColumns({
        f"{level}_status": F.expr(f"""CASE WHEN {level}_url IS NULL THEN NULL
            WHEN NOT ({selected}) THEN 'not_selected'
            WHEN page_fetched THEN 'ok' ELSE 'failed' END"""),
        f"{level}_title": F.expr(f"IF(page_fetched, page_title, {level}_title)"),
    }).drop("row_key", "page_key", "page_fetched", "page_title")


def _fan_out(rows: DataFrame, keep: list[str], ord_name: str, columns: list[str]) -> DataFrame:
    exploded = rows.selectExpr(
        *keep, "CAST(size(children) AS BIGINT) AS siblings", "posexplode_outer(children) AS (child_ord, c)")
    return exploded.selectExpr(*keep, "siblings", f"CAST(child_ord AS BIGINT) AS {ord_name}", *columns)


def structure_rows(pages: DataFrame, seeds: DataFrame, tables: Scratch, site: str = urls.SITE, limits: Limits = Limits()) -> DataFrame:
    """One row per unit; parents without children keep one row with nulls.

    ``seeds`` are the first frontier; every level hands the next one its own.
    """
    course_cols = ["course_url", "course_title", "course_status"]
    path_cols = [*course_cols, "path_ord", "path_url", "learn_uid", "path_title", "path_status"]
    module_cols = [*path_cols, "module_ord", "module_url", "module_title", "module_status"]

    def children(rows: DataFrame, level: str, selected: str, anchor: str, keep: list[str], ord_name: str, columns: list[str]) -> DataFrame:
        frontier = rows.where(f"{selected} AND {level}_url IS NOT NULL").selectExpr(f"{level}_url AS url")
        facts = tables.stage(level_facts(frontier_pages(pages, frontier), level, site), f"{level}-pages")
        return _fan_out(_expand(rows, unique_pages(facts), level, selected, anchor), keep, ord_name, columns)

    courses = seeds.selectExpr("course_url", "'' AS course_title")
    paths = tables.stage(children(
        courses, "course", "true", "course_url", course_cols, "path_ord",
        ["c.url AS path_url", "c.learn_uid AS learn_uid", "c.title AS path_title"]), "paths")
    modules = tables.stage(children(
        paths, "path", Limits.selects("path_ord", limits.paths), "course_url", path_cols, "module_ord",
        ["c.url AS module_url", "c.title AS module_title"]), "modules")
    return children(
        modules, "module", Limits.selects("module_ord", limits.modules), "concat(course_url, coalesce(path_url, ''))",
        module_cols, "unit_ord", ["c.number AS unit_number", "c.title AS unit_title", "c.url AS unit_url", "c.href AS unit_href"],
    ).withColumn("unit_selected", F.expr(Limits.selects("unit_ord", limits.units))).drop("siblings")


def with_unit_pages(rows: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """Join fetch status, page size and the given content fields of the units to look up."""
    body = facts.selectExpr("url AS page_key", "fetched AS page_fetched", "html_bytes", *fields)
    key = F.expr("""IF(unit_selected, unit_url, concat('-', coalesce(unit_url,
        concat_ws(' ', course_url, path_url, module_url))))""")
    return (
        rows.withColumn("row_key", key)
        .join(body, F.col("row_key") == F.col("page_key"), "left")
        .withColumn("unit_status", F.expr("""CASE WHEN unit_url IS NULL THEN NULL
            WHEN NOT unit_selected THEN 'not_selected' WHEN page_fetched THEN 'ok' ELSE 'failed' END"""))
        .drop("row_key", "page_key", "page_fetched")
    )


def course_hierarchy(
    pages: DataFrame,
    seeds: DataFrame,
    site: str = urls.SITE,
    limits: Limits = Limits(),
    extract_content: bool = True,
    look_up_units: bool = True,
    snapshot: DataFrame | None = None,
    fields: list[str] | None = None,
) -> DataFrame:
    """The whole hierarchy, one row per unit, for the seed courses.

    Without ``extract_content`` no content is built; without ``look_up_units``
    unit pages are not touched at all. ``fields`` limits what is extracted.

    With a ``snapshot`` of an earlier run (as in ``resume``), selected units it
    holds content for get that content, status ``resumed`` and ``resumed`` true;
    their pages are not looked up.
    """
    wanted = list(fields or CONTENT_FIELDS) if extract_content or snapshot is not None else []
    with Scratch(pages.sparkSession, "hierarchy") as tables:
        rows = structure_rows(pages, seeds, tables, site, limits)
        if not (extract_content or look_up_units or snapshot is not None):
            return stage(rows, "structure")
        if snapshot is not None:
            rows = resume.with_stored(rows, snapshot, wanted, "unit_selected")
        rows = stage(rows, "units")
    to_fetch = rows.where("unit_selected AND unit_url IS NOT NULL")
    if snapshot is not None:
        to_fetch, rows = to_fetch.where("stored IS NULL"), rows.withColumn("fetching", F.expr("unit_selected AND stored IS NULL"))
    extracted = wanted if extract_content else []
    if extract_content or look_up_units:
        found = frontier_pages(pages, to_fetch.selectExpr("unit_url AS url"))
        facts = unique_pages(stage(unit_facts(found, extracted, site), "unit-pages"))
    else:
        facts = pages.sparkSession.createDataFrame([], "url string, fetched boolean, html_bytes int")
    if snapshot is None:
        return with_unit_pages(rows, facts, extracted)
    looked_up = with_unit_pages(rows.withColumnsRenamed({"unit_selected": "chosen", "fetching": "unit_selected"}), facts, extracted)
    return resume.merged(looked_up.drop("unit_selected").withColumnRenamed("chosen", "unit_selected"), wanted, extracted)
