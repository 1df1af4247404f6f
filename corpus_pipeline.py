"""Training-corpus pipeline: from raw documents to packed token sequences.

Every stage reads all its predecessor kept, as a written table. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coursemill.llm import langid, lines, packing, secrets, simhash
from coursemill.llm.queries import prepare, table
from coursemill.sources.staging import new_path, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Those without a letter go, null and empty texts included, and those whose
    n-grams the learned languages do not know or that do not stand out for two of
    them. Repeated rows stay or go together; a null id counts as empty text when
    documents are held out. Without labels, and on an empty table, no row is left.
    """
    prepare(spark)
    return langid.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one.

    No row goes; null texts stay null, rows that repeat id and text are one
    document, a null id comes first in order. An empty table stays empty.
    """
    prepare(spark)
    return lines.drop_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles are linked by two differing bits or fewer.

    The one with the smallest id stays, a null id only in a group without other
    ids; null and wordless texts are one group. An empty table stays empty.
    """
    prepare(spark)
    return simhash.keep_one(docs, distance=2, size=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; null texts stay null. An empty table stays empty."""
    prepare(spark)
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the packed sequences.

    A null text is an empty document; repeated rows are packed as often as given,
    null ids stay null. An empty table gives no pieces.
    """
    prepare(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The fitted classifier, edit distances and XXH64 fingerprints cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again, and goes when the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        path = new_path(spark, name)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
