"""Staging helpers: evaluate once, literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions run exactly once per row.

    A plain projection is merged into every filter that uses it, also into the
    one the planner adds below an ``explode``, so a parsed payload would be
    parsed again per predicate. A one-row ``inline`` is a step predicates do not
    pass, and it stays inside generated code.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of constants, built inside the JVM (no Python rows, size known to the planner)."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))
