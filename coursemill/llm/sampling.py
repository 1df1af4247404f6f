"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.sources.staging import stage


def draw() -> Column:
    """Digest of id and text: where a row stands in the order of drawing. Rows that repeat both are one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def bounded(docs: DataFrame, labelled: DataFrame, label: str, most: int) -> DataFrame:
    """``(draw, text, label)``: at most ``most`` rows of ``docs(doc_id, text)`` for each label, those with the least digests.

    ``labelled(draw, label)`` says which rows may be drawn. Digests alone are
    ranked, and a task hands on no more than ``most`` of a label; texts are read
    for the rows drawn. The bound is hard: rows that repeat a digest count once.
    Rows without a label are not drawn; an empty table gives none.
    """
    order = Window.partitionBy(label).orderBy("draw")
    rows = labelled.where(F.col(label).isNotNull()).select("draw", label).distinct()
    # written, so that Spark knows its size before it plans the join with the texts
    drawn = stage(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth"), "drawn")
    found = docs.select(draw().alias("draw"), F.coalesce("text", F.lit("")).alias("text")).join(drawn, "draw")
    return found.groupBy("draw", label).agg(F.first("text").alias("text")).select("draw", "text", label)
