"""Term search over an inverted index table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonetide.functions.stage import with_once
from tonetide.functions.text import tokens


def build_term_index(
    documents: DataFrame, fields: tuple[str, ...] = ("text",), key: str = "doc_id"
) -> DataFrame:
    """(term, key, tf) over one or more text fields. Counts combine before the shuffle."""
    return _terms(documents, fields, key).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def _terms(documents: DataFrame, fields: tuple[str, ...], key: str) -> DataFrame:
    words = tokens(F.concat_ws(" ", *fields))
    staged = with_once(documents.select(key, *fields), {"__words": words})
    return staged.select(key, F.explode("__words").alias("term"))


def term_search(
    index: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id"
) -> DataFrame:
    """Top ``k`` documents per query that hold all of its terms, by number of hits.

    ``queries``: query_id, term (one row per term, any case). Ties go to the
    smaller key. Per-partition limits apply before the ranking shuffle.
    """
    wanted = queries.select("query_id", F.lower("term").alias("term")).distinct()
    needed = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    hits = (
        index.join(wanted, "term")
        .groupBy("query_id", key)
        .agg(F.sum("tf").alias("hits"), F.count(F.lit(1)).alias("found"))
        .join(needed, "query_id")
        .filter(F.col("found") == F.col("terms"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), key)
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", key, "hits", "rank")
    )


def term_search_scan(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 10,
    fields: tuple[str, ...] = ("text",),
    key: str = "doc_id",
) -> DataFrame:
    """``term_search`` straight over texts, without a stored index.

    Tokens are matched with the query terms before they are counted, so only
    matching tokens are aggregated.
    """
    words = _terms(documents, fields, key)
    terms = queries.select(F.lower("term").alias("term")).distinct()
    index = words.join(terms, "term", "left_semi").groupBy("term", key).agg(
        F.count(F.lit(1)).alias("tf")
    )
    return term_search(index, queries, k, key)
