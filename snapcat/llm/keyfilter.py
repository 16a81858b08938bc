"""A Bloom filter of 64-bit keys, of bounded size, to skip most rows that a later join would drop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits: 16 for each key, between these bounds (the filter is 16 MB at most; beyond that it lets more rows through)
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 27


class KeyFilter:
    """The filter; lives in a broadcast variable."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, len(table) * 64

    def __contains__(self, key: int) -> bool:
        u = key & (2**64 - 1)
        return all(int(self.table[s >> 6]) >> (s & 63) & 1 for s in (u & (self.bits - 1), (u >> 32) & (self.bits - 1)))


def key_filter(keys: DataFrame):
    """Broadcast filter of the column `key` (long): every such key is in it, and few others."""
    spark, bits, count = keys.sparkSession, FEWEST_BITS, keys.count()
    while bits < min(MOST_BITS, 16 * count):
        bits *= 2
    slots = F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))).alias("s")
    words = keys.select(slots).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(KeyFilter(table))
