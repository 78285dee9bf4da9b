"""Sliding time-to-live deduplication of a stream as a live table.

Late and disordered messages count like any other: each micro-batch is reduced to sessions (runs of
a hash whose gaps stay below the TTL) and sessions of all batches join. A message that comes late
and turns out to be the first of its run takes the place of the one that was shown before it, or
bridges two runs; no message is refused, and no state is held by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetide.operators.dedup import joined_sessions, seen_sessions
from tonetide.schemas import SEEN_TTL_SECONDS
from tonetide.streaming.rollup import PART, RollUp


def first_seen(
    ttl_seconds: int = SEEN_TTL_SECONDS, tie: str = "source_id", buckets: int = 64
) -> RollUp:
    """Messages that are no repeats; state is partitioned into hash buckets."""
    bucket = F.pmod(F.xxhash64("content_hash"), F.lit(buckets)).cast("int")

    def merge(rows: DataFrame) -> DataFrame:
        whole = joined_sessions(rows.drop(PART), ttl_seconds, tie)
        return whole.withColumn(PART, bucket).select(*rows.columns)

    return RollUp(
        lambda rows: seen_sessions(rows, ttl_seconds, tie),
        merge,
        lambda rows: rows.select("row.*"),
        bucket,
        F.col("timestamp"),
        "0 seconds",
        ("content_hash",),
    )
