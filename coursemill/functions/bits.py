"""Bits of the bitmaps that ``bitmap_construct_agg`` makes."""

from __future__ import annotations

#: Bits of one such bitmap, a fixed value of Spark's.
BITMAP_BITS = 32768


def is_set(bits: str, position: str) -> str:
    """BOOLEAN: bit ``position`` (from 0) of the BINARY ``bits`` is set."""
    byte = f"CAST(conv(hex(substr({bits}, CAST({position} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return f"getbit({byte}, CAST({position} % 8 AS INT)) = 1"
