"""A bitmap of fixed size that tells tasks which values may be of interest.

Its size is a parameter and does not follow the data, so it may travel to every task. A value
that was put in is always found; others are found now and then, more often the fuller it is.
Users must stay right under such false alarms, which only cost work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

LOG2_BITS = 26


class Bitmap:
    """Filled by an aggregation: at most 2 ** (bits - 6) rows reach the driver."""

    def __init__(self, values: DataFrame, column: str, log2_bits: int = LOG2_BITS):
        slot = F.col(column).bitwiseAND((1 << log2_bits) - 1)
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))
        rows = (
            values.select(F.shiftright(slot, 6).alias("word"), one.alias("bit"))
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
        words = np.zeros(1 << (log2_bits - 6), np.uint64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        self.mask = np.uint64((1 << log2_bits) - 1)
        self.shared = values.sparkSession.sparkContext.broadcast(words)

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Which of the unsigned 64-bit values may have been put in."""
        slot = values & self.mask
        word = self.shared.value[(slot >> np.uint64(6)).astype(np.int64)]
        return (word >> (slot & np.uint64(63))) & np.uint64(1) != 0

    def test(self, column: Column) -> Column:
        """The same for a column of signed longs; null is not held."""

        def run(values: pa.Array) -> pa.Array:
            known = values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            return pa.array(self.holds(known) & values.is_valid().to_numpy(zero_copy_only=False))

        return arrow_udf(run, "boolean").asNondeterministic()(column)
