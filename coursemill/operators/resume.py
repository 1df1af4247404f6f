"""Incremental runs: match units against an earlier snapshot.

A snapshot has ``(ord, course_url, path_title, module_title, unit_title, content, ...)``;
units are identified by their course and their three titles, and only stored
units with content count as done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["course_url", "path_title", "module_title", "unit_title"]


def stored_units(snapshot: DataFrame, fields: list[str]) -> DataFrame:
    """First stored unit of each course and titles.

    ``min_by`` combines map-side, so copies of one unit shrink to a row per
    task before the shuffle.
    """
    return (
        snapshot.where("content <> ''")
        .groupBy(*KEY)
        .agg(F.min_by(F.struct(*fields), F.col("ord")).alias("stored"))
    )


def snapshot_match(units: DataFrame, snapshot: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Units with the content the snapshot holds for them."""
    return units.join(stored_units(snapshot, fields or ["content"]), KEY).select(units["*"], "stored.*")


def units_done(units: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Units the snapshot already has content for."""
    return units.join(snapshot.where("content <> ''").select(*KEY), KEY, "left_semi")


def units_todo(units: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Units still to extract."""
    return units.join(snapshot.where("content <> ''").select(*KEY), KEY, "left_anti")


def resume_merge(units: DataFrame, snapshot: DataFrame, fields: list[str]) -> DataFrame:
    """Stored fields where the snapshot has them, freshly extracted otherwise."""
    stored = stored_units(snapshot, fields)
    others = [c for c in units.columns if c not in fields]
    return units.join(stored, KEY, "left").select(
        *others,
        *[F.when(F.col("stored").isNotNull(), F.col(f"stored.{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.col("stored").isNotNull().alias("resumed"),
    )


def with_stored(units: DataFrame, snapshot: DataFrame, fields: list[str], selected: str) -> DataFrame:
    """Units with ``stored``: what the snapshot holds for them, null if nothing or if they are not selected."""
    rows = units.join(stored_units(snapshot, fields), KEY, "left")
    return rows.select(*units.columns, F.when(F.expr(selected), F.col("stored")).alias("stored"))


def merged(units: DataFrame, fields: list[str], extracted: list[str]) -> DataFrame:
    """Units after a run that looked up only what was not ``stored``: fields, status and flag of both kinds in one."""
    stored = F.col("stored").isNotNull()
    new = {f: F.when(stored, F.col(f"stored.{f}")).otherwise(F.col(f)) if f in extracted else F.col(f"stored.{f}") for f in fields}
    new["unit_status"] = F.when(stored, F.lit("resumed")).otherwise(F.col("unit_status"))
    others = [c for c in units.columns if c not in {*new, "stored"}]
    return units.select(*others, *(c.alias(n) for n, c in new.items()), stored.alias("resumed"))
