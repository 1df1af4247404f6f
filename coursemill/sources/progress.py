"""Saved progress: one row per attempt, replaced and deleted by key.

The table lies in buckets by attempt. A save or a deletion rewrites the buckets
of its attempts and leaves the others alone; Spark swaps a written bucket in when
the whole job is committed. A deleted attempt stays as a row without progress
until it is saved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.sources.staging import Scratch, names_in

FIELDS = "attempt_id BIGINT, seed BIGINT, current_index BIGINT, score BIGINT, total BIGINT, saved_at STRING"


class ProgressStore:
    """Progress under ``path``; the number of ``buckets`` must stay the same for a path. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = f"{FIELDS}, deleted BOOLEAN, bucket INT"

    def _rows(self) -> DataFrame:
        if not names_in(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _put(self, rows: DataFrame) -> None:
        with Scratch(self.spark, "progress") as tables:
            placed = rows.withColumn("bucket", F.expr(f"CAST(pmod(xxhash64(attempt_id), {self.buckets}) AS INT)"))
            new = tables.stage(placed.to(self._rows().schema), "new")
            # of the stored rows only those in the buckets of the new ones are read
            stored = self._rows().join(new.select("bucket").distinct(), "bucket", "left_semi").alias("s")
            kept = stored.join(new.alias("n"), F.expr("s.bucket = n.bucket AND s.attempt_id <=> n.attempt_id"), "left_anti")
            both = tables.stage(kept.select(*new.columns).unionByName(new), "both")
            both.hint("rebalance", "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode(
                "overwrite").parquet(self.path)

    def save(self, progress: DataFrame) -> None:
        """Store ``progress``, one row per attempt, in place of what its attempts have; other columns are left out."""
        names = [f.split()[0] for f in FIELDS.split(", ")]
        self._put(progress.select(*names).withColumn("deleted", F.lit(False)))

    def clear(self, attempts: DataFrame) -> None:
        """Delete the progress of ``attempts(attempt_id)``; repeats and unknown ones do no harm."""
        self._put(attempts.select("attempt_id").distinct().selectExpr(
            "attempt_id", "NULL AS seed", "NULL AS current_index", "NULL AS score", "NULL AS total", "NULL AS saved_at", "true AS deleted"))

    def load(self) -> DataFrame:
        """Progress of all attempts that have some; empty if nothing was saved."""
        return self._rows().where("NOT deleted").drop("deleted", "bucket")
