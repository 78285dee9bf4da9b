"""A table of vectors that upserts extend by delta files.

An upsert writes the incoming rows only, dealt into hash buckets; readers take the newest version
of each id. ``compact`` folds the deltas of a bucket into one (see ``BatchTable``: a compaction
that dies changes nothing). The number of buckets belongs to the table and is stored with it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetide.operators.ordering import newest
from tonetide.sources.batches import BATCH, BatchTable
from tonetide.sources.files import stored

BUCKET, DELTA = "bucket", "delta"


def _latest(rows: DataFrame) -> DataFrame:
    """The newest ``created_at`` of each id, of equal ones the later delta."""
    return newest(rows, ["vec_id"], [F.col("created_at"), F.col(DELTA)])


class EmbeddingTable:
    """Vectors by ``vec_id`` with ``created_at``; open a stored one with ``EmbeddingTable(spark, path)``."""

    def __init__(self, spark: SparkSession, path: str):
        layout = stored(spark, f"{path}/layout")
        if layout is None:
            raise FileNotFoundError(f"no embedding table at {path}")
        row = layout.first()
        self.spark, self.buckets = spark, row["buckets"]
        schema = T.StructType.fromJson(json.loads(row["layout"]))
        self.columns = schema.names
        added = [T.StructField(DELTA, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
        whole = T.StructType([*schema, *added])
        self.table = BatchTable(spark, path, whole, BUCKET, _latest)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64):
        row = [(buckets, schema.json())]
        spark.createDataFrame(row, "buckets int, layout string").coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(self.buckets)).cast("int")

    def _next(self) -> int:
        """The number of the next delta."""
        found = [-1]
        open_ = stored(self.spark, f"{self.table.path}/open", self.table.open_schema)
        if open_ is not None:
            found.append(open_.agg(F.max(BATCH)).first()[0])
        found.append(self.table._commits().agg(F.max("upto")).first()[0])
        return 1 + max(n for n in found if n is not None)

    def upsert(self, incoming: DataFrame, delta: int | None = None) -> int:
        """Store or replace vectors. The same ``delta`` written again replaces itself."""
        number = self._next() if delta is None else delta
        rows = incoming.select(
            *self.columns, F.lit(number).cast("long").alias(DELTA), self._bucket().alias(BUCKET)
        )
        self.table.write(_latest(rows), number)
        return number

    def read(self) -> DataFrame:
        return self.table.read().select(*self.columns)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Vectors of the wanted ids; only their buckets are read."""
        wanted = ids.select("vec_id").distinct()
        met = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most all buckets
        rows = self.table.read().where(F.col(BUCKET).isin(met))
        return rows.join(wanted, "vec_id", "left_semi").select(*self.columns)

    def compact(self, least: int = 2) -> list[int]:
        """Fold buckets with ``least`` or more deltas; returns them."""
        return sorted(self.table.fold(self._next(), least))
