"""Sentiment roll-ups: hourly, daily, per source, per entity, per window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetide.functions.measure import as_double, exact_mean, rounded_stddev


def hourly_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        exact_mean("sentiment_score").alias("avg_score"),
        exact_mean("confidence_score").alias("avg_confidence"),
        as_double(F.min("sentiment_score")).alias("min_score"),
        as_double(F.max("sentiment_score")).alias("max_score"),
    ]


def hourly_sentiment_summary(results: DataFrame) -> DataFrame:
    return results.groupBy(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"),
        "source_type",
        "sentiment_label",
    ).agg(*hourly_measures())


def daily_sentiment_summary(results: DataFrame) -> DataFrame:
    return results.groupBy(
        F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day"),
        "source_type",
        "sentiment_label",
    ).agg(
        F.count(F.lit(1)).alias("count"),
        exact_mean("sentiment_score").alias("avg_score"),
        exact_mean("confidence_score").alias("avg_confidence"),
        rounded_stddev("sentiment_score").alias("score_stddev"),
    )


def source_volume_metrics(results: DataFrame) -> DataFrame:
    """Volume per hour and source with the exact number of distinct senders.

    Rows are first folded per sender, so the distinct count works on one row per
    (hour, source, sender) and a hot source does not gather in one task.
    """
    per_sender = results.groupBy(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"),
        "source_type",
        "source_id",
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence_score").alias("confidence"),
        F.count("confidence_score").alias("n_confidence"),
    )
    return per_sender.groupBy("hour", "source_type").agg(
        F.sum("n").alias("message_count"),
        F.count("source_id").alias("unique_sources"),
        (F.sum("confidence").cast("double") / F.sum("n_confidence")).alias(
            "avg_confidence"
        ),
    )


SUMMARY_VIEWS = {
    "hourly": (hourly_sentiment_summary, "hour"),
    "daily": (daily_sentiment_summary, "day"),
    "volume": (source_volume_metrics, "hour"),
}


def refresh_summary(
    view: str, current: DataFrame, results: DataFrame, changed: DataFrame
) -> DataFrame:
    """``current`` with every bucket touched by ``changed`` recomputed from ``results``.

    Buckets are found from the changed rows alone, first their span: it goes to the scan of
    ``results`` as a time filter. Untouched buckets are carried over.
    """
    summarise, unit = SUMMARY_VIEWS[view]
    bucket = F.date_trunc(unit, "timestamp").cast("timestamp_ntz")
    touched = changed.select(bucket.alias(unit)).distinct()
    first, last = touched.agg(F.min(unit), F.max(unit)).first()
    if first is None:
        return current
    end = last + dt.timedelta(**{f"{unit}s": 1})
    inside = (F.col("timestamp") >= F.lit(first).cast("timestamp_ntz")) & (
        F.col("timestamp") < F.lit(end).cast("timestamp_ntz")
    )
    rows = (
        results.filter(inside)
        .withColumn("__bucket", bucket)
        .join(touched.withColumnRenamed(unit, "__bucket"), "__bucket", "left_semi")
    )
    fresh = summarise(rows.drop("__bucket"))
    kept = current.join(touched, unit, "left_anti")
    return kept.unionByName(fresh)


def _sums(name: str, value: Column) -> list[Column]:
    """Sum and number of the values that are there."""
    return [F.sum(value).alias(name), F.count(value).alias(f"{name}_n")]


def _mean(total: Column, n: Column) -> Column:
    """NULL where no row has a value."""
    return F.try_divide(total.cast("double"), n)


def sentiment_stats(
    results: DataFrame,
    source: str | None = None,
    time_from: dt.datetime | None = None,
    time_to: dt.datetime | None = None,
) -> DataFrame:
    """Counts and means per label plus a ``(total)`` row; both time bounds inclusive.

    The total means are weighted by row count, i.e. means over all rows; with no
    rows the total row holds zeros.
    """
    rows = results
    if source:
        rows = rows.filter(F.col("source_type") == source)
    if time_from:
        rows = rows.filter(F.col("timestamp") >= F.lit(time_from).cast("timestamp_ntz"))
    if time_to:
        rows = rows.filter(F.col("timestamp") <= F.lit(time_to).cast("timestamp_ntz"))
    per_label = rows.groupBy(F.col("sentiment_label").alias("sentiment")).agg(
        F.count(F.lit(1)).alias("n"),
        *_sums("score", F.col("sentiment_score")),
        *_sums("confidence", F.col("confidence_score")),
    )

    def line(name: Column, n: Column, fold=lambda column: column) -> Column:
        score, scores, confidence, confidences = (
            fold(F.col(c)) for c in ("score", "score_n", "confidence", "confidence_n")
        )
        return F.struct(
            name.alias("sentiment"),
            F.coalesce(n, F.lit(0)).alias("count"),
            F.coalesce(_mean(score, scores), F.lit(0.0)).alias("avg_score"),
            F.coalesce(_mean(confidence, confidences), F.lit(0.0)).alias("avg_confidence"),
        )

    # a handful of label rows folded into one, so that one scan gives labels and total
    labels = F.collect_list(line(F.col("sentiment"), F.col("n")))
    total = line(F.lit("(total)"), F.sum("n"), F.sum)
    folded = per_label.agg(labels.alias("labels"), total.alias("total"))
    return folded.select(F.inline(F.concat("labels", F.array("total"))))


def recent_window_summary(
    results: DataFrame, as_of: dt.datetime, hours: int = 1
) -> DataFrame:
    """Per source and label over the rows strictly newer than ``as_of - hours``."""
    since = as_of - dt.timedelta(hours=hours)
    return (
        results.filter(F.col("timestamp") > F.lit(since).cast("timestamp_ntz"))
        .groupBy("source_type", "sentiment_label")
        .agg(
            F.count(F.lit(1)).alias("count"),
            exact_mean("sentiment_score").alias("avg_score"),
            exact_mean("confidence_score").alias("avg_confidence"),
        )
        .orderBy(F.desc("count"), "source_type", "sentiment_label")
    )


def bucket_sentiment(results: DataFrame, width: str = "1 hour") -> DataFrame:
    """Time bucket × source × label with the merged, sorted set of entity values.

    ``results`` carries ``entities array<struct<entity_type, entity_value>>``.
    """
    keys = ["time_bucket", "source", "sentiment"]
    # one row per entity; the first of a result row also stands for the row itself
    rows = results.select(
        F.window("timestamp", width)["start"].cast("timestamp_ntz").alias("time_bucket"),
        F.col("source_type").alias("source"),
        F.col("sentiment_label").alias("sentiment"),
        "sentiment_score",
        "confidence_score",
        F.posexplode_outer(F.transform("entities", lambda e: e["entity_value"])).alias("at", "value"),
    )
    own = F.coalesce(F.col("at"), F.lit(0)) == 0
    cells = rows.groupBy(*keys, "value").agg(
        F.sum(F.when(own, 1).otherwise(0)).alias("n"),
        *_sums("score", F.when(own, F.col("sentiment_score"))),
        *_sums("confidence", F.when(own, F.col("confidence_score"))),
    )
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        _mean(F.sum("score"), F.sum("score_n")).alias("avg_score"),
        _mean(F.sum("confidence"), F.sum("confidence_n")).alias("avg_confidence"),
        F.array_sort(F.collect_list("value")).alias("entities"),
    )


ENTITY_KEYS = ["entity_type", "entity_value", "sentiment_label"]


def entity_partials(results: DataFrame) -> DataFrame:
    """Mergeable per-entity state: occurrences, score sum, first and last time."""
    return (
        results.select(
            F.explode("entities").alias("e"), "sentiment_label", "sentiment_score", "timestamp"
        )
        .select("e.entity_type", "e.entity_value", "sentiment_label", "sentiment_score", "timestamp")
        .groupBy(*ENTITY_KEYS)
        .agg(
            F.count(F.lit(1)).alias("occurrence_count"),
            F.sum("sentiment_score").cast("decimal(28,4)").alias("score_sum"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )


def merge_entity_partials(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*ENTITY_KEYS).agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        F.sum("score_sum").cast("decimal(28,4)").alias("score_sum"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def entity_summary(results: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Entity table: one row per (type, value, label), merged with a prior state."""
    state = entity_partials(results)
    if prior is not None:
        state = merge_entity_partials(prior, state)
    return state.select(
        *ENTITY_KEYS,
        "occurrence_count",
        (F.col("score_sum").cast("double") / F.col("occurrence_count")).alias(
            "avg_sentiment_score"
        ),
        "first_seen",
        "last_seen",
    )


def top_sources(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` (source, label) groups with the most rows."""
    return (
        results.groupBy("source_type", "sentiment_label")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "source_type", "sentiment_label")
        .limit(n)
    )


def sentiment_trend(
    results: DataFrame, dimension: Column, periods: int = 24, unit: str = "hour"
) -> DataFrame:
    """Mean score and volume per period and their rolling forms over ``periods`` rows.

    ``dimension`` is the source or the asset class. The window runs over
    pre-aggregated periods, so its size is the number of periods, not of rows.
    """
    per_period = results.groupBy(
        dimension.alias("dimension"),
        F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("period"),
    ).agg(
        F.count(F.lit(1)).alias("volume"),
        F.sum("sentiment_score").cast("decimal(28,4)").alias("score_sum"),
        F.count("sentiment_score").alias("scores"),
    )
    rolling = (
        Window.partitionBy("dimension").orderBy("period").rowsBetween(-(periods - 1), 0)
    )
    rolling_volume = F.sum("volume").over(rolling)
    return per_period.select(
        "dimension",
        "period",
        "volume",
        _mean(F.col("score_sum"), F.col("scores")).alias("avg_score"),
        rolling_volume.alias("rolling_volume"),
        _mean(F.sum("score_sum").over(rolling), F.sum("scores").over(rolling)).alias(
            "rolling_score"
        ),
    )
