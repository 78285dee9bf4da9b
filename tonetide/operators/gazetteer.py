"""Entity linking through a table of aliases of any size.

Aliases are read as a trie by first word: of all places in the texts only those whose word starts
an alias are kept, by a join with the table of first words; each of them yields one phrase per
alias length that its first word knows, and phrases meet the aliases in an equi-join. Nothing of
the table is part of the plan; whether a side is broadcast is Spark's choice by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetide.functions.stage import with_once
from tonetide.functions.text import tokens

ENTITY = ["entity_type", "entity_value", "asset_class"]
ENTITIES = "array<struct<entity_type:string,entity_value:string,asset_class:string>>"


class Gazetteer:
    """Aliases (``alias``: lower-case words with one blank between them) of entities.

    Entries may share an alias; NULL and empty aliases name nothing. ``longest`` (words in the
    longest alias) is measured unless it is given.
    """

    def __init__(self, table: DataFrame, longest: int | None = None):
        named = table.select("alias", *ENTITY).where("alias <> ''")
        words = F.split("alias", " ")
        self.table = named.withColumn("__size", F.size(words))
        self.starts = (
            self.table.groupBy(F.element_at(words, 1).alias("__word"))
            .agg(F.sort_array(F.collect_set("__size")).alias("__sizes"))
        )
        if longest is None:
            longest = self.table.agg(F.max("__size")).first()[0] or 1
        self.longest = longest

    def phrases(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, phrase) at each place whose word starts an alias."""
        words = with_once(df.select(key, text), {"__words": tokens(F.col(text))}).drop(text)
        # the words from each place on: the array beside itself, moved by one, two, …
        moved = [F.col("__words")] + [
            F.slice("__words", step + 1, F.greatest(F.size("__words"), F.lit(1)))
            for step in range(1, self.longest)
        ]
        places = words.select(key, F.explode(F.arrays_zip(*[m.alias(f"w{i}") for i, m in enumerate(moved)])).alias("p"))
        fields = [F.col("p")[f] for f in places.schema["p"].dataType.names]
        flat = places.select(key, *[f.alias(f"__w{i}") for i, f in enumerate(fields)])
        started = flat.join(self.starts, flat["__w0"] == self.starts["__word"])
        sized = started.select(
            key, *[f"__w{i}" for i in range(self.longest)], F.explode("__sizes").alias("__size")
        )
        return sized.select(key, self._phrase().alias("alias"))

    def _phrase(self) -> Column:
        """The first ``__size`` words of a place (fewer at the end of the text)."""
        words = [
            F.when(F.col("__size") > i, F.col(f"__w{i}")) for i in range(self.longest)
        ]
        return F.when(F.col("__size") == 1, F.col("__w0")).otherwise(F.concat_ws(" ", *words))

    def link(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """One row per (key, entity) that the text mentions."""
        found = self.phrases(df, key, text).join(self.table, "alias")
        return found.select(key, *ENTITY).distinct()

    def with_entities(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """Add ``entities``, sorted. ``key`` identifies the rows of ``df``; texts are not moved
        unless they are used later."""
        entity = F.struct(*ENTITY)
        lists = self.link(df, key, text).groupBy(F.col(key).alias("__key")).agg(
            F.sort_array(F.collect_list(entity)).alias("__entities")
        )
        joined = df.join(lists, F.col(key) == F.col("__key"), "left")
        return joined.withColumn(
            "entities", F.coalesce("__entities", F.array()).cast(ENTITIES)
        ).drop("__key", "__entities")
