"""Rows whose key may be wanted, found without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions import bits


def sieve(rows: DataFrame, wanted: DataFrame, key: str, size: int) -> DataFrame:
    """The ``rows`` whose ``key`` (an expression over both) has a bit in a broadcast bitmap of ``size`` bits made from ``wanted``.

    No wanted row is lost; others pass with the share of set bits, so a join on the key follows.
    """
    place = _place(key, size)
    return (
        rows.join(F.broadcast(_bitmap(wanted, place)), F.expr(f"bitmap_bucket_number({place})") == F.col("_bucket"))
        .where(bits.is_set("_bits", f"bitmap_bit_position({place})"))
        .select(*rows.columns)
    )


def marked(rows: DataFrame, wanted: DataFrame, key: str, size: int, mark: str) -> DataFrame:
    """All ``rows``, with a BOOLEAN ``mark`` that is true where ``sieve`` lets a row through.

    Rows without the mark have no equal key in ``wanted`` for certain, and need no join.
    """
    place = _place(key, size)
    found = f"coalesce({bits.is_set('_bits', f'bitmap_bit_position({place})')}, false)"
    return rows.join(
        F.broadcast(_bitmap(wanted, place)), F.expr(f"bitmap_bucket_number({place})") == F.col("_bucket"), "left"
    ).select(*rows.columns, F.expr(found).alias(mark))


def _place(key: str, size: int) -> str:
    return f"pmod(xxhash64({key}), {size}L) + 1"


def _bitmap(wanted: DataFrame, place: str) -> DataFrame:
    return wanted.selectExpr(f"{place} AS _place").groupBy(F.expr("bitmap_bucket_number(_place)").alias("_bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_place))").alias("_bits"))
