"""Incremental unit ingest: every new page is extracted once.

Files of new pages arrive in a folder. Which URLs are new is found from a ledger
of published URLs before any page is parsed, so repeats cost no parsing and the
stream keeps no state. Pages are extracted where they are read; only narrow
records are shuffled. A batch that is done again after a failure replaces its own
output and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import urls
from coursemill.operators import content
from coursemill.operators.sieve import sieve
from coursemill.sources.staging import Scratch
from coursemill.streaming.ledger import Ledger, query_id

PAGES = "page_id BIGINT, url STRING, html STRING"
#: Bits of the bitmap that lets a batch's new pages through: 4 MB, whatever the batch.
FILTER_BITS = 1 << 25


@dataclass(frozen=True)
class NewUnits:
    """What is to be extracted: a stream of pages, and URLs that an earlier run stored."""

    pages: DataFrame
    site: str
    published: DataFrame | None


def read_page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of page rows from parquet files."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_units(pages: DataFrame, site: str = urls.SITE, published: DataFrame | None = None) -> NewUnits:
    """Extracted units of pages not seen before.

    ``published`` holds the ``url`` of units that an earlier run stored. Of several
    pages of one URL the first batch's counts, and in a batch that with the least
    md5 of its html, then the least page_id. Pages without html or URL are left out.
    """
    return NewUnits(pages, site, published)


def winners(pages: DataFrame) -> DataFrame:
    """``(url, digest, page_id)``: the page that counts for each URL of a batch."""
    found = pages.where("html IS NOT NULL AND url IS NOT NULL").groupBy("url").agg(
        F.min(F.struct(F.md5("html").alias("digest"), "page_id")).alias("w"))
    return found.select("url", "w.*")


def extracted(pages: DataFrame, wanted: DataFrame, site: str) -> DataFrame:
    """Units of the pages ``wanted(url, digest, page_id)``: others are not parsed, html is not shuffled."""
    key = "url, digest, coalesce(page_id, -1)"
    arrived = sieve(pages.where("html IS NOT NULL").withColumn("digest", F.md5("html")), wanted, key, FILTER_BITS)
    # the id carries the digest through the parse
    parsed = content.unit_content(arrived.selectExpr("struct(page_id, digest) AS page_id", "url", "html"), site)
    ours = wanted.selectExpr("url", "struct(page_id, digest) AS page_id")
    # one page of each URL is left, perhaps repeated; by both keys the rows lie where the join has put them
    units = parsed.join(ours, ["url", "page_id"], "left_semi").dropDuplicates(["url", "page_id"])
    return units.withColumn("page_id", F.col("page_id.page_id"))


def start_ingest(units: NewUnits, out: str, checkpoint: str, ledger: str | None = None, expected: int = 10_000_000):
    """Process everything available and append it to ``out``; returns the query.

    ``ledger`` is the folder of the published URLs, beside the checkpoint if not
    given; streams that share it take each URL once, one after the other.
    ``expected`` is the number of URLs its filter is laid out for.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = query_id(spark, checkpoint)
        work = f"{run}-{batch_id}"
        taken = Ledger(spark, ledger or f"{checkpoint.rstrip('/')}-ledger", "STRING", expected)
        with Scratch(spark, "ingest") as tables:
            found = winners(batch)
            if units.published is not None:
                found = found.join(units.published.select("url"), "url", "left_anti")
            arrived = tables.stage(found, "winners")
            fresh = taken.unseen(arrived.selectExpr("url AS key"), work, tables)
            wanted = tables.stage(arrived.join(fresh, F.col("url") == F.col("key"), "left_semi"), "wanted")
            extracted(batch, wanted, units.site).write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")
            taken.record(wanted.selectExpr("url AS key"), work)

    return (
        units.pages.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .start()
    )
