"""JSON/JSONL readers and writers of the course and question files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coursemill.operators import ordinals
from coursemill.operators.publish import LINE_KEY
from coursemill.sources.staging import stage

HEADINGS = "array<struct<level:int,text:string>>"
IMAGES = (
    "array<struct<src:string,absolute_url:string,alt_text:string,title:string,filename:string,image_type:string,"
    "context:struct<preceding_heading:string,following_text:string,figure_caption:string,parent_section:string>>>"
)
LINKS = "array<struct<url:string,text:string>>"

QUESTION = (
    "question STRING, options MAP<STRING,STRING>, correct_answer STRING, explanation STRING, "
    "learning_path STRING, module STRING, additional_notes STRING"
)
TRAINING = (
    "course_title STRING, learning_path STRING, module_title STRING, unit_title STRING, unit_url STRING, "
    f"content STRING, headings {HEADINGS}, code_blocks ARRAY<STRING>, images {IMAGES}, scraped_at STRING"
)
SUMMARY = (
    "course_title STRING, course_url STRING, scraped_at STRING, learning_paths_count BIGINT, total_modules BIGINT, "
    "total_units BIGINT, content_extracted BOOLEAN, "
    "limits_applied STRUCT<max_paths:INT,max_modules_per_path:INT,max_units_per_module:INT>, "
    "files_created ARRAY<STRING>"
)
_UNIT = (
    f"struct<number:bigint,title:string,url:string,href:string,content:string,headings:{HEADINGS},"
    f"code_blocks:array<string>,images:{IMAGES},links:{LINKS}>"
)
_MODULE = (
    "struct<title:string,url:string,description:string,learning_objectives:array<string>,"
    f"prerequisites:array<string>,units:array<{_UNIT}>>"
)
_PATH = f"struct<title:string,url:string,learn_uid:string,modules:array<{_MODULE}>>"
#: A null field of a CSV file.
CSV_NULL = r"\N"
COMPLETE = f"url STRING, title STRING, description STRING, learning_paths ARRAY<{_PATH}>"


# --- S2-S5 ---------------------------------------------------------------


def read_questions(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Question JSONL; a malformed line fails the read, blank lines are skipped."""
    return spark.read.schema(QUESTION + extra).option("mode", "FAILFAST").json(path)


def read_training(spark: SparkSession, root: str) -> DataFrame:
    """All ``*_training.jsonl`` under ``<root>/*_data``, with their course slug."""
    files = spark.read.schema(TRAINING).option("recursiveFileLookup", "true").json(f"{root}/*_data/*_training.jsonl")
    location = F.col("_metadata.file_path")
    partition = F.regexp_extract(location, r"/course_slug=([^/]*)/", 1)
    named = F.regexp_extract(location, r"([^/]+)_training\.jsonl", 1)
    return files.select("*", F.when(partition != "", partition).otherwise(named).alias("course_slug"))


def read_summaries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Summary files: one pretty-printed object each, or one object per line."""
    return spark.read.option("multiLine", str(multi_line).lower()).schema(SUMMARY).json(path)


def read_snapshot(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Complete course documents; unreadable ones are left out, a missing path is empty.

    ``multi_line`` reads one pretty-printed object per file; without it every
    line is a document and files are split among tasks.
    """
    schema = COMPLETE + ", _corrupt_record STRING"
    reader = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE")
    try:
        found = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found.where("_corrupt_record IS NULL").drop("_corrupt_record")


def snapshot_units(snapshot: DataFrame) -> DataFrame:
    """Units of complete course files, in stored order."""
    return (
        snapshot.selectExpr("url AS course_url", "posexplode(learning_paths) AS (p, path)")
        .selectExpr("course_url", "p", "path.title AS path_title", "posexplode(path.modules) AS (m, module)")
        .selectExpr("course_url", "p", "m", "path_title", "module.title AS module_title",
                    "posexplode(module.units) AS (u, unit)")
        .selectExpr("struct(course_url, p, m, u) AS ord", "course_url", "path_title", "module_title",
                    "unit.title AS unit_title", "unit.url AS unit_url", "unit.content AS content",
                    "unit.headings AS headings", "unit.code_blocks AS code_blocks", "unit.images AS images",
                    "unit.links AS links")
    )


def read_exemplar(spark: SparkSession, path: str) -> StructType:
    """Structure of an exemplar JSONL file, all its lines taken together; a malformed line fails the read."""
    return spark.read.option("mode", "FAILFAST").json(path).schema


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 1-based number in the file.

    Numbers are counted per file split and offset by the splits before it; a
    split is read by one task, so its sequence follows the lines.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    return ordinals.row_number(lines, ["file"], ["seq"], F.col("block"), "line_no").select("file", "line_no", "line")


# --- K1-K4, K7 -----------------------------------------------------------


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Bring equal keys together for partitioned output; AQE splits hot keys."""
    return df.hint("rebalance", *keys)


def write_complete(lines: DataFrame, path: str) -> None:
    """Complete course documents, one folder per course, named by a digest of its URL.

    Courses may share a title or have none, so titles name no folder. Part files
    of a course, read in name order, are one JSON object. The sort starts with
    the partition column, or the writer would sort once more.
    """
    order = ["course_key", *LINE_KEY]
    keyed = lines.withColumn("course_key", F.md5("course_url"))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("course_key", "line").write.mode("overwrite").partitionBy("course_key").text(path)


def write_slices(slices: DataFrame, path: str) -> None:
    """Snapshot for later runs, one document per line."""
    slices.write.mode("overwrite").json(path)


def write_training(records: DataFrame, path: str) -> None:
    """Training JSONL partitioned by ``course_slug``."""
    balanced(records, "course_slug").write.mode("overwrite").partitionBy("course_slug").json(path)


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Summaries, one per line; splits and scales like any JSONL."""
    summaries.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary_files(summaries: DataFrame, path: str) -> None:
    """Summaries as one pretty-printed file per course, keyed by its URL."""
    pretty = "map('pretty', 'true', 'ignoreNullFields', 'false')"
    summaries.selectExpr(
        "md5(course_url) AS course_key", f"to_json(struct(*), {pretty}) AS value"
    ).write.mode("overwrite").partitionBy("course_key").text(path)


def write_questions(questions: DataFrame, path: str, mode: str = "append") -> None:
    """Question JSONL, appended to or replacing what is there."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    questions.write.mode(mode).option("ignoreNullFields", "false").json(path)


def flat_questions(questions: DataFrame) -> DataFrame:
    """Questions with one column per option, as CSV needs."""
    options = [f"try_element_at(options, '{c}') AS option_{c.lower()}" for c in "ABCD"]
    others = [c for c in questions.columns if c != "options"]
    return questions.selectExpr(*others, *options)


def write_csv(questions: DataFrame, path: str) -> None:
    """CSV with a header; texts keep their line breaks and outer spaces, and a null is not an empty text."""
    writer = flat_questions(questions).write.mode("overwrite").option("header", "true").option("escape", '"')
    whole = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    whole.option("nullValue", CSV_NULL).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV of ``write_csv``; as texts hold line breaks, a file is read by one task."""
    reader = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.option("nullValue", CSV_NULL).csv(path)


def write_xml(questions: DataFrame, path: str) -> None:
    flat_questions(questions).write.mode("overwrite").option("rowTag", "question").format("xml").save(path)


def json_array_lines(questions: DataFrame, order: str) -> DataFrame:
    """Lines ``(line_key, tie, line)`` that, sorted by the first two, form one JSON array.

    Every element but the first starts with a comma. The ends are a combining
    minimum and maximum, so nothing is gathered. Rows are staged with a number
    that tells equal keys apart.
    """
    fields = ", ".join(f"'{c}', {c}" for c in questions.columns if c != order)
    rows = stage(questions.selectExpr(
        f"{order} AS line_key", "monotonically_increasing_id() AS tie",
        f"to_json(named_struct({fields}), map('ignoreNullFields', 'false')) AS body"), "array-lines")
    return questions.sparkSession.sql(
        """SELECT line_key, tie, concat(
            IF(struct(line_key, tie) = (SELECT min(struct(line_key, tie)) FROM {rows}), '[', ','), body,
            IF(struct(line_key, tie) = (SELECT max(struct(line_key, tie)) FROM {rows}), ']', '')) AS line FROM {rows}""",
        rows=rows,
    )


def write_json_array(questions: DataFrame, order: str, path: str) -> None:
    """One JSON array over ordered part files."""
    lines = json_array_lines(questions, order).repartitionByRange("line_key", "tie").sortWithinPartitions("line_key", "tie")
    lines.select("line").write.mode("overwrite").text(path)
