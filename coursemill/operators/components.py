"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.sources.staging import Scratch, stage


def components(links: DataFrame, into: Scratch | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the least node reached.

    Alternating star contraction: the large-star step hangs the greater
    neighbours of every node on its least neighbour, the small-star step does so
    with the lesser ones. Both keep the components and the edge table never
    grows; it ends as stars after a number of rounds logarithmic in the size.
    Minima combine map-side and are staged, so that the join with a node of very
    many links has a plain exchange on both sides, which Spark can split. Tables
    of a round go when the next one is written; the result is staged, in ``into``
    if that is given.

    Rows with a null end and self links are ignored; an empty table gives none.
    """
    with Scratch(links.sparkSession, "components") as tables:
        edges = tables.stage(
            links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .distinct(),
            "edges",
        )
        before = None
        while (now := _digest(edges)) != before:
            before = now
            edges = _small_star(_large_star(edges, tables), tables)
        roots = edges.selectExpr("u AS node", "v AS root").unionByName(edges.selectExpr("v AS node", "v AS root").distinct())
        return into.stage(roots, "roots") if into else stage(roots, "roots")


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal before and after a round of no change."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, tables: Scratch) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = tables.stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    star = tables.stage(
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
    )
    tables.drop(edges, least)
    return star


def _small_star(edges: DataFrame, tables: Scratch) -> DataFrame:
    least = tables.stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    star = tables.stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    tables.drop(edges, least)
    return star
