"""A stored inverted index: postings in term buckets, extended by appends.

An append writes the postings of its documents only, dealt into hash buckets of their term, so a
search reads the buckets of the terms it asks for and no others. A document that is appended again
replaces its earlier version: the append notes it as replaced, readers pass over its older
postings, and ``compact`` leaves them out for good. An append that dies between its steps leaves
old postings readable; writing it again under its number puts everything right.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetide.operators import search
from tonetide.sources.batches import BATCH, BatchTable
from tonetide.sources.files import stored

BUCKET, DELTA = "bucket", "delta"


def _last(rows: DataFrame) -> DataFrame:
    """The latest delta of each document."""
    return rows.groupBy(BUCKET, "key").agg(F.max(DELTA).alias(DELTA))


class TermIndex:
    """Postings of documents by ``key``; open a stored index with ``TermIndex(spark, path)``.

    Rows without a key cannot be found or replaced and are left out. Repeated keys in one append
    count as one document with all their texts.
    """

    def __init__(self, spark: SparkSession, path: str):
        layout = stored(spark, f"{path}/layout")
        if layout is None:
            raise FileNotFoundError(f"no term index at {path}")
        row = layout.first()
        self.spark, self.buckets, self.key = spark, row["buckets"], row["key"]
        self.fields = tuple(row["fields"])
        key = T.StructField("key", T.StructType.fromJson(json.loads(row["layout"]))[0].dataType)
        delta, bucket = T.StructField(DELTA, T.LongType()), T.StructField(BUCKET, T.IntegerType())
        posting = [T.StructField("term", T.StringType()), key, T.StructField("tf", T.LongType())]
        # documents by key bucket; postings by term bucket
        self.documents = BatchTable(
            spark, f"{path}/documents", T.StructType([key, delta, bucket]), BUCKET, _last
        )
        self.replaced = BatchTable(
            spark, f"{path}/replaced", T.StructType([key, delta, bucket]), BUCKET, _last
        )
        self.postings = BatchTable(
            spark, f"{path}/postings", T.StructType([*posting, delta, bucket]), BUCKET, self._live
        )

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        key: T.StructField,
        fields: tuple[str, ...] = ("text",),
        buckets: int = 256,
    ) -> TermIndex:
        row = [(buckets, key.name, list(fields), T.StructType([key]).json())]
        layout = spark.createDataFrame(row, "buckets int, key string, fields array<string>, layout string")
        layout.coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path)

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Postings whose document has no later version."""
        gone = self.replaced.read().select(F.col("key").alias("__key"), F.col(DELTA).alias("__delta"))
        older = (F.col("key") == F.col("__key")) & (F.col(DELTA) < F.col("__delta"))
        return rows.join(gone, older, "left_anti")

    def _next(self) -> int:
        """The number of the next append."""
        found = [-1]
        open_ = stored(self.spark, f"{self.documents.path}/open", self.documents.open_schema)
        if open_ is not None:
            found.append(open_.agg(F.max(BATCH)).first()[0])
        found.append(self.documents._commits().agg(F.max("upto")).first()[0])
        return 1 + max(n for n in found if n is not None)

    def append(self, documents: DataFrame, delta: int | None = None) -> int:
        """Index documents, new ones or new versions. The same ``delta`` replaces itself."""
        number = self._next() if delta is None else delta
        mark = F.lit(number).cast("long").alias(DELTA)
        given = documents.where(F.col(self.key).isNotNull())
        keys = given.select(F.col(self.key).alias("key")).distinct().withColumn(BUCKET, self._bucket("key"))
        counts = search.build_term_index(given, self.fields, self.key)
        self.postings.write(
            counts.select(
                "term", F.col(self.key).alias("key"), "tf", mark, self._bucket("term").alias(BUCKET)
            ),
            number,
        )
        known = self.documents.read(before=number).select("key")
        again = keys.join(known, "key", "left_semi")
        self.replaced.write(again.select("key", mark, BUCKET), number)
        self.documents.write(keys.select("key", mark, BUCKET), number)
        return number

    def lookup(self, queries: DataFrame) -> DataFrame:
        """Postings (term, key, tf) of the queries' terms; only their buckets are read."""
        terms = queries.select(F.lower("term").alias("term")).distinct()
        met = [r[0] for r in terms.select(self._bucket("term")).distinct().collect()]  # at most all buckets
        rows = self.postings.read(
            chosen=lambda all_: all_.where(F.col(BUCKET).isin(met)).join(terms, "term", "left_semi")
        )
        return rows.select("term", F.col("key").alias(self.key), "tf")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``search.term_search`` over the stored postings."""
        return search.term_search(self.lookup(queries), queries, k, self.key)

    def compact(self, least: int = 2) -> list[int]:
        """Fold buckets of postings with ``least`` or more appends; returns them.

        What is replaced stays noted: other buckets may still hold older postings.
        """
        upto = self._next()
        self.documents.fold(upto, least)
        self.replaced.fold(upto, least)
        return sorted(self.postings.fold(upto, least))
