"""What a run publishes: complete document, training records, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions import urls
from coursemill.operators.hierarchy import Limits

TRAINING_FIELDS = [
    "course_title", "learning_path", "module_title", "unit_title", "unit_url",
    "content", "headings", "code_blocks", "images", "scraped_at",
]
LINE_KEY = ["course_url", "path_key", "module_key", "unit_key"]
_LAST = "9223372036854775807L"

# flat rows are dense in every ordinal, so the first row of a parent stands for it
FIRST_OF_MODULE = "module_ord IS NOT NULL AND coalesce(unit_ord, 0) = 0"
FIRST_OF_PATH = "path_ord IS NOT NULL AND coalesce(module_ord, 0) = 0 AND coalesce(unit_ord, 0) = 0"
FIRST_OF_COURSE = "coalesce(path_ord, 0) = 0 AND coalesce(module_ord, 0) = 0 AND coalesce(unit_ord, 0) = 0"


def complete_lines(rows: DataFrame, with_content: bool = True) -> DataFrame:
    """The nested course document as ordered lines of JSON text.

    Sorted by ``LINE_KEY`` the lines of a course form one JSON object holding
    its whole hierarchy. Lines are made row by row, so a course of any size is
    never gathered in one place; only the sort moves them.
    """
    json = "to_json({}, map('ignoreNullFields', 'false'))"
    unit = "named_struct('number', unit_number, 'title', unit_title, 'url', unit_url, 'href', unit_href)"
    unit_line = json.format(unit)
    if with_content:
        full = unit[:-1] + """, 'content', content, 'headings', headings, 'code_blocks', code_blocks,
            'images', images, 'links', links)"""
        unit_line = f"IF(content IS NULL, {unit_line}, {json.format(full)})"

    def opening(fields: str, children: str) -> str:
        text = json.format(f"named_struct({fields})")
        return f"""concat(substr({text}, 1, length({text}) - 1), ',"{children}":[')"""

    def line(when: str, path: str, module: str, unit_key: str, text: str, ord_column: str = "") -> str:
        comma = f"IF({ord_column} > 0, ',', '')" if ord_column else "''"
        return f"""IF({when}, named_struct('path_key', {path}, 'module_key', {module},
            'unit_key', {unit_key}, 'line', concat({comma}, {text})), NULL)"""

    course = opening("'url', course_url, 'title', course_title, 'description', ''", "learning_paths")
    path = opening("'title', path_title, 'url', path_url, 'learn_uid', learn_uid", "modules")
    empty_list = "CAST(array() AS array<string>)"
    module = opening(
        f"""'title', module_title, 'url', module_url, 'description', '',
            'learning_objectives', {empty_list}, 'prerequisites', {empty_list}""",
        "units",
    )
    lines = ", ".join([
        line(FIRST_OF_COURSE, "-1L", "-1L", "-1L", course),
        line(FIRST_OF_COURSE, _LAST, _LAST, _LAST, "']}'"),
        line(FIRST_OF_PATH, "path_ord", "-1L", "-1L", path, "path_ord"),
        line(FIRST_OF_PATH, "path_ord", _LAST, _LAST, "']}'"),
        line(FIRST_OF_MODULE, "path_ord", "module_ord", "-1L", module, "module_ord"),
        line(FIRST_OF_MODULE, "path_ord", "module_ord", _LAST, "']}'"),
        line("unit_ord IS NOT NULL", "path_ord", "module_ord", "unit_ord", unit_line, "unit_ord"),
    ])
    return rows.selectExpr("course_url", "course_title", f"inline(filter(array({lines}), x -> x IS NOT NULL))")


def complete_slices(rows: DataFrame) -> DataFrame:
    """Complete documents cut by unit: each row is a course holding one unit.

    Same schema as the whole document, made row by row and free of grouping;
    this is the form to keep as a snapshot for later runs.
    """
    return rows.where("unit_ord IS NOT NULL").selectExpr(
        "course_url AS url", "course_title AS title", "'' AS description",
        """array(named_struct('title', path_title, 'url', path_url, 'learn_uid', learn_uid,
            'modules', array(named_struct('title', module_title, 'url', module_url, 'description', '',
                'learning_objectives', CAST(array() AS array<string>), 'prerequisites', CAST(array() AS array<string>),
                'units', array(named_struct('number', unit_number, 'title', unit_title, 'url', unit_url,
                    'href', unit_href, 'content', content, 'headings', headings, 'code_blocks', code_blocks,
                    'images', images, 'links', links)))))) AS learning_paths""",
    )


def training_records(rows: DataFrame, scraped_at: str | None = None) -> DataFrame:
    """One flat record per unit that has content."""
    stamp = F.lit(scraped_at) if scraped_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return (
        rows.where("content <> ''")
        .withColumn("learning_path", F.col("path_title"))
        .withColumn("scraped_at", stamp)
        .select(*TRAINING_FIELDS)
    )


def course_summary(
    rows: DataFrame, limits: Limits = Limits(), content_extracted: bool = True, scraped_at: str | None = None
) -> DataFrame:
    """Counts and run settings per course; one combining aggregate."""
    slug = urls.output_slug("course_title")
    stamp = F.lit(scraped_at) if scraped_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    counts = rows.groupBy("course_url", "course_title").agg(
        F.count_if(F.expr(FIRST_OF_PATH)).alias("learning_paths_count"),
        F.count_if(F.expr(FIRST_OF_MODULE)).alias("total_modules"),
        F.count("unit_ord").alias("total_units"),
    )
    training = f"concat({slug}, '_training.jsonl')" if content_extracted else "CAST(NULL AS STRING)"

    def limit(n: int | None) -> str:
        return f"CAST({'NULL' if n is None else n} AS INT)"

    return counts.withColumn("scraped_at", stamp).selectExpr(
        "course_title", "course_url", "scraped_at", "learning_paths_count", "total_modules", "total_units",
        f"{str(content_extracted).lower()} AS content_extracted",
        f"""named_struct('max_paths', {limit(limits.paths)}, 'max_modules_per_path', {limit(limits.modules)},
            'max_units_per_module', {limit(limits.units)}) AS limits_applied""",
        f"array(concat({slug}, '_complete.json'), {training}) AS files_created",
    )


def compaction(rows: DataFrame) -> DataFrame:
    """Raw html bytes against extracted bytes per course."""
    return rows.groupBy("course_url").agg(
        F.sum(F.coalesce("html_bytes", F.lit(0)).cast("bigint")).alias("html_bytes"),
        F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")).alias("content_bytes"),
    ).withColumn("ratio", F.expr("try_divide(html_bytes, content_bytes)"))
