"""Exact copies, found without moving texts that have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetide.llm.bitmap import Bitmap
from tonetide.session import cut_lineage


def marks(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text: together its identity."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


class Copies:
    """Documents (``id``, ``text``) with ``mark`` and ``mark2``, and what is known of copies.

    ``groups``: (mark, mark2, first, copies) of the texts that several rows have, ``first``
    their least id. ``documents`` is the input with its marks; ``rest`` holds all other columns.
    """

    def __init__(self, docs: DataFrame, id_col: str, text: str):
        mark, mark2 = marks(F.col("text"))
        others = [docs[f"`{c}`"] for c in docs.columns if c != text]
        self.documents = docs.select(
            docs[id_col].alias("id"),
            F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
            F.struct(*others).alias("rest"),
        ).select("rest", "id", "text", mark.alias("mark"), mark2.alias("mark2"))
        groups = (
            self.documents.groupBy("mark", "mark2")
            .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
            .where("copies > 1")
        )
        self.groups = cut_lineage(groups, "copies")
        self.bitmap = Bitmap(self.groups, "mark")

    def firsts(self) -> DataFrame:
        """One row for each text and least id (id, text, mark).

        Rows that share both are told apart by nothing, so one of them stands for all. A text
        whose rows all lack an id has no first and no row here.
        """
        copied = self.bitmap.test(F.col("mark"))
        single = self.documents.where(~copied).withColumn("copies", F.lit(1).cast("bigint"))
        # only suspected copies are moved, and of a group only the first goes on
        some = self.documents.where(copied).join(self.groups, ["mark", "mark2"], "left")
        some = some.where(F.col("first").isNull() | (F.col("id") == F.col("first")))
        some = some.dropDuplicates(["id", "mark", "mark2"])
        columns = ["id", "text", "mark", F.coalesce("copies", F.lit(1)).alias("copies")]
        return single.select(columns).union(some.select(columns)).where("id is not null")

    def later(self) -> DataFrame:
        """(id, mark, first) of the rows whose text has a smaller id elsewhere."""
        narrow = self.documents.where(self.bitmap.test(F.col("mark"))).select("id", "mark", "mark2")
        return narrow.join(self.groups, ["mark", "mark2"]).where("id > first").drop("mark2")

    def distinct_texts(self) -> DataFrame:
        """One row for each text, with or without id (text, mark, mark2)."""
        copied = self.bitmap.test(F.col("mark"))
        columns = ["text", "mark", "mark2"]
        # copies are dropped inside the tasks before the rest is moved
        some = self.documents.where(copied).select(columns).dropDuplicates(["mark", "mark2"])
        return self.documents.where(~copied).select(columns).union(some)
