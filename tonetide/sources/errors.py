"""The error summary as a stored table that micro-batches of error rows extend.

Each batch writes its partial summary only, numbered after the counts of the batches before it, so
a batch that is written again gives the same rows. ``fold`` merges partials (see ``BatchTable``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetide.operators.errors import KEYS, error_partials
from tonetide.sources.batches import BatchTable

BUCKET, DELTA = "bucket", "delta"
COLUMNS = ["component", "error_type", "error_count", "first_occurrence", "last_occurrence", "sample_message"]
LAYOUT = (
    "component string, error_type string, error_count bigint, first_occurrence timestamp_ntz, "
    "last_occurrence timestamp_ntz, sample_message string, delta bigint, bucket int"
)


def _merged(partials: DataFrame) -> DataFrame:
    """Counts add up; the sample is that of the last partial that has one."""
    with_sample = F.when(F.col("sample_message").isNotNull(), F.col(DELTA))
    return partials.groupBy(BUCKET, *KEYS).agg(
        F.sum("error_count").alias("error_count"),
        F.min("first_occurrence").alias("first_occurrence"),
        F.max("last_occurrence").alias("last_occurrence"),
        F.max_by("sample_message", with_sample).alias("sample_message"),
        F.max(DELTA).alias(DELTA),
    )


class ErrorTable:
    """Summary rows per (component, error_type) at ``path``, in ``buckets`` partitions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4):
        self.buckets = buckets
        self.table = BatchTable(spark, path, T.StructType.fromDDL(LAYOUT), BUCKET, _merged)

    def add(self, errors: DataFrame, batch_id: int) -> None:
        """One micro-batch of error rows; adding it again replaces it."""
        prior = self.table.read(before=batch_id).select(*COLUMNS)
        fresh = error_partials(errors, prior)
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")
        self.table.write(
            fresh.select(*COLUMNS, F.lit(batch_id).cast("long").alias(DELTA), bucket.alias(BUCKET)), batch_id
        )

    def read(self) -> DataFrame:
        return self.table.read().select(*COLUMNS)

    def fold(self, before: int, least: int = 2) -> list[int]:
        """Merge the partials of batches below ``before``; returns the folded buckets."""
        return sorted(self.table.fold(before, least))
