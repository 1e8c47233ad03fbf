"""A bit table of 64-bit hashes: of bounded size, so that it can go to every task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About 64 bits for each hash, within these bounds; a full table only lets more rows pass.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def bit_table(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """Bits set at the values of the only column (bigint), and the shift that makes a hash a bit number."""
    distinct = hashes.toDF("h").distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(64 * distinct.count() + 1))))
    shift = 64 - int(math.log2(bits))
    slot = F.shiftrightunsigned("h", shift)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(31).cast("int"))
    rows = distinct.groupBy(F.shiftright(slot, 5).cast("int").alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return table, shift


def may_hold(table: np.ndarray, shift: int, h: np.ndarray) -> np.ndarray:
    """Whether each of the uint64 hashes may be in the table; False is sure."""
    slot = h >> np.uint64(shift)
    return ((table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1).astype(bool)
