"""Bit tables of one size, whatever the input: what is in a table is always found, a little else is too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26  # 8 MB


def bit_table(df: DataFrame, hash_col: str) -> np.ndarray:
    """A table in which the first BITS bits of every 64-bit hash of a column are set. It alone comes to the driver."""
    place = F.shiftrightunsigned(hash_col, 64 - BITS) + 1
    parts = df.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts.collect():  # at most 2^BITS / 32768 rows of 4 KB
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["part"] - 1) * 4096
        table[at : at + len(part)] = part
    return table


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each (unsigned) hash has its bit set."""
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
