"""Per-key order operations that stay parallel when one key holds most rows.

A window over a hot key sorts that key in one task. The helpers here split each
key into chunks (a time bucket, a value bucket), do the row-level work inside
``(key, chunk)`` and carry only one aggregate row per chunk across chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetide.session import cut_lineage


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: Sequence[str],
    chunk: Column,
    output: str,
) -> DataFrame:
    """Add ``output``: the ``value`` of the row before this one within ``keys``.

    ``chunk`` must grow with ``value``; keys and ``value`` are not NULL. The
    first row of a key gets NULL.
    """
    split = df.withColumn("__chunk", chunk)
    across = Window.partitionBy(*keys).orderBy("__chunk")
    carried = (
        split.groupBy(*keys, "__chunk")
        .agg(F.max(value).alias("__high"))
        .withColumn("__carried", F.lag("__high").over(across))
        .drop("__high")
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(value, *tie)
    joined = split.join(carried, [*keys, "__chunk"], "left")
    return joined.withColumn(
        output, F.coalesce(F.lag(value).over(inside), F.col("__carried"))
    ).drop("__chunk", "__carried")


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column, output: str
) -> DataFrame:
    """Add ``output``: the greatest non-NULL ``value`` up to this row within ``keys``.

    ``chunk`` must grow with the first column of ``order``.
    """
    split = df.withColumn("__chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        split.groupBy(*keys, "__chunk")
        .agg(F.max(value).alias("__high"))
        .withColumn("__carried", F.max("__high").over(before))
        .drop("__high")
    )
    inside = (
        Window.partitionBy(*keys, "__chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        split.join(carried, [*keys, "__chunk"], "left")
        .withColumn(output, F.greatest(F.max(value).over(inside), F.col("__carried")))
        .drop("__chunk", "__carried")
    )


def same_key(keys: Sequence[str], prefix: str) -> Column:
    """Equality of ``keys`` with the columns of that name behind ``prefix``; NULL equals NULL."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def behind(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with ``prefix`` before its key columns."""
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def row_at_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ranks: DataFrame
) -> DataFrame:
    """The row at the 1-based ``rank`` that ``ranks`` (keys, rank: one row a key) asks for.

    Rows are dealt by ranges of (keys, order), so that a key that holds most rows fills many
    tasks; counts per (key, range) locate the range of the rank, and only its rows are sorted.
    Keys without a wanted rank, or with one beyond their rows, give none. ``df`` is staged twice.
    """
    wanted = cut_lineage(behind(ranks, keys, "__"), "ranks")
    among = df.join(wanted.drop("rank"), same_key(keys, "__"), "left_semi")
    # ranges are sampled from the stored rows, not from what made them
    dealt = cut_lineage(among, "ranked").repartitionByRange(*keys, *order)
    parts = cut_lineage(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy(*keys).orderBy("__part")
    counts = parts.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    found = (
        counts.withColumn("__upto", F.sum("__n").over(upto))
        .join(wanted, same_key(keys, "__"))
        .where((F.col("rank") <= F.col("__upto")) & (F.col("rank") > F.col("__upto") - F.col("__n")))
        .select(
            *[F.col(k).alias(f"__{k}") for k in keys],
            F.col("__part").alias("__at"),
            (F.col("rank") - F.col("__upto") + F.col("__n")).alias("__place"),
        )
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        parts.join(found, same_key(keys, "__") & (F.col("__part") == F.col("__at")))
        .withColumn("__row", F.row_number().over(inside))
        .where(F.col("__row") == F.col("__place"))
        .select(*df.columns)
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, by map-side combined aggregation."""
    return _extreme(df, keys, order, F.max_by)


def oldest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the smallest ``order`` per key, by map-side combined aggregation."""
    return _extreme(df, keys, order, F.min_by)


def _extreme(df, keys, order, pick):
    row = F.struct(*[F.col(c) for c in df.columns])
    marks = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return (
        df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        .agg(pick(row, marks).alias("__row"))
        .select("__row.*")
    )
