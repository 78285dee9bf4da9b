"""Error roll-ups over a log table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonetide.operators.ordering import behind, row_at_rank, same_key
from tonetide.session import cut_lineage

SAMPLE_EVERY = 100
KEYS = ["component", "error_type"]


def error_summary(errors: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Count, first, last and sample message per (component, error_type).

    ``errors``: id, component, error_type, message, timestamp. Occurrences are
    numbered in time order, continuing after the prior count; the sample is the
    message of the last occurrence numbered 1, 101, 201, … A prior state keeps
    its sample when no such number falls into the new rows.
    """
    fresh = error_partials(errors, prior)
    return fresh if prior is None else merge_error_summaries(prior, fresh)


def error_partials(errors: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The summary of the new rows alone, numbered after the counts of ``prior``.

    New rows are read twice: once for counts per second, which give the totals and the second
    that holds the sample, and once for the rows of those seconds.
    """
    second = F.date_trunc("second", "timestamp").cast("timestamp_ntz")
    counted = errors.groupBy(*KEYS, second.alias("second")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )
    counts = cut_lineage(counted, "error-counts")
    totals = counts.groupBy(*KEYS).agg(
        F.sum("n").alias("error_count"),
        F.min("first").alias("first_occurrence"),
        F.max("last").alias("last_occurrence"),
    )
    offset = F.lit(0).cast("long")
    numbered = totals
    if prior is not None:
        known = behind(prior.select(*KEYS, F.col("error_count").alias("before")), KEYS, "__")
        numbered = totals.join(known, same_key(KEYS, "__"), "left")
        offset = F.coalesce("before", F.lit(0))
    # the last number n with n % 100 == 1 up to offset + error_count, as a rank among the new rows
    last = F.floor((F.col("error_count") + offset - 1) / SAMPLE_EVERY) * SAMPLE_EVERY + 1 - offset
    ranks = numbered.select(*KEYS, last.cast("long").alias("rank")).where("rank > 0")
    place = _located(counts, ranks)
    rows = errors.select(*KEYS, "id", "timestamp", "message", second.alias("second"))
    samples = behind(
        row_at_rank(rows, [*KEYS, "second"], ["timestamp", "id"], place).select(
            *KEYS, F.col("message").alias("sample_message")
        ),
        KEYS,
        "__",
    )
    return totals.join(samples, same_key(KEYS, "__"), "left").select(*totals.columns, "sample_message")


def _located(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each key's rank as (second, rank inside it): by hours first, then by seconds of one hour."""
    hour = counts.withColumn("hour", F.date_trunc("hour", "second").cast("timestamp_ntz"))
    hours = hour.groupBy(*KEYS, "hour").agg(F.sum("n").alias("n"))
    in_hour = behind(_holding(hours, "hour", KEYS, behind(ranks, KEYS, "__")), [*KEYS, "hour"], "__")
    return _holding(hour, "second", [*KEYS, "hour"], in_hour).select(*KEYS, "second", "rank")


def _holding(counts: DataFrame, unit: str, keys: list[str], ranks: DataFrame) -> DataFrame:
    """The unit that holds each key's rank, with the rank inside it."""
    upto = Window.partitionBy(*keys).orderBy(unit)
    mine = counts.join(ranks, same_key(keys, "__")).withColumn("upto", F.sum("n").over(upto))
    inside = F.col("rank") - F.col("upto") + F.col("n")
    return mine.where((inside > 0) & (inside <= F.col("n"))).select(
        *dict.fromkeys([*KEYS, *keys, unit]), inside.alias("rank")
    )


def merge_error_summaries(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keyed upsert: counts add up, the fresh sample wins where it exists."""
    both = prior.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))
    return both.groupBy(*KEYS).agg(
        F.sum("error_count").alias("error_count"),
        F.min("first_occurrence").alias("first_occurrence"),
        F.max("last_occurrence").alias("last_occurrence"),
        F.max_by(
            F.col("sample_message"),
            F.when(F.col("sample_message").isNotNull(), F.col("part")),
        ).alias("sample_message"),
    )


def recent_errors(summary: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Errors whose last occurrence is strictly within ``hours`` of ``as_of``, newest first."""
    now = F.lit(as_of).cast("timestamp_ntz")
    age = (
        F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_occurrence").cast("timestamp"))
    ) / F.lit(3_600_000_000.0)
    return (
        summary.filter(F.col("last_occurrence") > F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz"))
        .select(
            "component",
            "error_type",
            "error_count",
            "last_occurrence",
            "sample_message",
            F.round(age, 6).alias("hours_since_last"),
        )
        .orderBy(F.desc("last_occurrence"), "component", "error_type")
    )
