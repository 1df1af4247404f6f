"""Keys that a stream has taken: a table beside the stream instead of operator state that grows for ever.

Keys are appended with the piece of work that took them, in slices by digest. A
Bloom filter of them, one small bitmap for each of a fixed number of parts, is a
table of its own. A batch meets the filter first: keys it does not know are new,
and only for the others are their slices of the key table read, which decides
exactly. Both meet by plain joins, so nothing is held in memory.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import bits
from coursemill.sources.staging import Scratch, Versions, names_in

SLICES = 16
PROBES = 3
#: Bits of the filter for each expected key; some four in a hundred new keys are then looked up in vain.
BITS_A_KEY = 8


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the stream that owns a checkpoint; a new checkpoint is another stream."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


class Ledger:
    """Taken keys under ``path``. ``key_type`` is their SQL type, ``expected`` their number.

    More keys than expected only make the filter weaker. The number must stay the
    same for a path: another one starts another filter, from the stored keys.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "STRING", expected: int = 10_000_000):
        self.spark, self.keys = spark, f"{path.rstrip('/')}/keys"
        self.parts = max(1, -(-expected * BITS_A_KEY // bits.BITMAP_BITS))
        self.schema = f"key {key_type}, work STRING, slice INT"
        self.filter = Versions(spark, f"{path.rstrip('/')}/filter-{self.parts}", "part BIGINT, bits BINARY")

    def _taken(self) -> DataFrame:
        if not names_in(self.spark, self.keys):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.keys)

    def _placed(self, keys: DataFrame) -> DataFrame:
        digest = "xxhash64(key)"
        return keys.selectExpr("key", f"pmod({digest}, {SLICES * self.parts}L) DIV {SLICES} AS part",
                               f"CAST(pmod({digest}, {SLICES}) AS INT) AS slice")

    def _bitmaps(self, keys: DataFrame) -> DataFrame:
        places = ", ".join(_place(i) for i in range(PROBES))
        return self._placed(keys).selectExpr("part", f"explode(array({places})) AS place").groupBy("part").agg(
            F.expr("bitmap_construct_agg(place)").alias("bits"))

    def _filter(self, work: str) -> DataFrame:
        made = self.filter.read(work)
        return made if made.inputFiles() else self._bitmaps(self._taken().where(F.col("work") != work))

    def unseen(self, keys: DataFrame, work: str, tables: Scratch) -> DataFrame:
        """The rows of ``keys(key)`` that no other piece of work has taken; nulls are unseen."""
        known = " AND ".join(bits.is_set("bits", _place(i)) for i in range(PROBES))
        asked = tables.stage(
            self._placed(keys).join(self._filter(work), "part", "left")
            .selectExpr("key", "slice", f"coalesce(bits IS NOT NULL AND {known}, false) AS maybe"), "asked")
        looked_up = asked.where("maybe").select("slice", "key").distinct()
        seen = self._taken().where(F.col("work") != work).join(looked_up, ["slice", "key"]).select("key").distinct()
        return asked.select("key").join(seen, "key", "left_anti")

    def record(self, keys: DataFrame, work: str) -> None:
        """Take ``keys(key)``. Done again by the same work it changes nothing."""
        rows = self._placed(keys.where("key IS NOT NULL")).select("key", F.lit(work).alias("work"), "slice")
        rows.hint("rebalance", "slice").write.partitionBy("slice").mode("append").parquet(self.keys)
        both = self._filter(work).unionByName(self._bitmaps(keys.where("key IS NOT NULL")))
        self.filter.replace(both.groupBy("part").agg(F.expr("bitmap_or_agg(bits)").alias("bits")), work)


def _place(probe: int) -> str:
    return f"CAST(pmod(xxhash64(key, {probe + 1}), {bits.BITMAP_BITS}) AS BIGINT)"
