"""Live roll-ups and alerts. Input streams carry ``timestamp`` of type TIMESTAMP.

In append mode a window is emitted once it is closed. To see open windows too, run the
one-aggregate streams (``stream_hourly_summary``, ``sender_counts``, ``minute_counts``,
``hourly_means``) in update mode and keep the latest row of each key
(``sinks.latest_of``); the ``…_of`` functions turn such tables into the wanted form.

These forms refuse rows behind the watermark (``sinks.late_rows`` counts them). The roll-ups at
the end (``hourly``, ``volume``, ``error_rates``, ``shifts``) are for ``rollup.LiveTable``, which
folds late rows back in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetide.operators import alerts
from tonetide.operators.summaries import hourly_measures
from tonetide.schemas import ALERT_RULES, ERROR_SHARE_LIMIT, AlertRule
from tonetide.streaming.rollup import RollUp, windowed
from tonetide.streaming.state import compare_hours

LATE = "1 hour"
HOUR = "1 hour"


def stream_hourly_summary(results: DataFrame, late: str = LATE) -> DataFrame:
    """Hourly summary; in append mode an hour is emitted once it is closed."""
    hours = results.withWatermark("timestamp", late).groupBy(
        F.window("timestamp", HOUR).alias("w"), "source_type", "sentiment_label"
    )
    return hours.agg(*hourly_measures()).select(
        F.col("w.start").alias("hour"),
        "source_type",
        "sentiment_label",
        "count",
        "avg_score",
        "avg_confidence",
        "min_score",
        "max_score",
    )


def stream_source_volume(results: DataFrame, late: str = LATE) -> DataFrame:
    """Volume and exact number of senders per hour and source.

    Two chained window aggregates: first one state row per sender, then the
    count over senders, so no set of senders is ever held in a state row.
    """
    per_sender = results.withWatermark("timestamp", late).groupBy(
        F.window("timestamp", HOUR).alias("w"), "source_type", "source_id"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence_score").alias("confidence"),
        F.count("confidence_score").alias("known"),
    )
    hours = per_sender.groupBy(F.window(F.window_time("w"), HOUR).alias("h"), "source_type").agg(
        F.sum("n").alias("message_count"),
        F.count("source_id").alias("unique_sources"),
        F.try_divide(F.sum("confidence").cast("double"), F.sum("known")).alias("avg_confidence"),
    )
    return hours.select(
        F.col("h.start").alias("hour"), "source_type", "message_count", "unique_sources", "avg_confidence"
    )


def sender_counts(results: DataFrame, late: str = LATE) -> DataFrame:
    """Rows and confidence per hour, source and sender: one row of state each."""
    hours = results.withWatermark("timestamp", late).groupBy(
        F.window("timestamp", HOUR).alias("w"), "source_type", "source_id"
    )
    return hours.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence_score").alias("confidence"),
        F.count("confidence_score").alias("known"),
    ).select(F.col("w.start").alias("hour"), "source_type", "source_id", "n", "confidence", "known")


def volume_of(senders: DataFrame) -> DataFrame:
    """Volume and number of senders per hour and source from ``sender_counts``."""
    return senders.groupBy("hour", "source_type").agg(
        F.sum("n").alias("message_count"),
        F.count("source_id").alias("unique_sources"),
        F.try_divide(F.sum("confidence").cast("double"), F.sum("known")).alias("avg_confidence"),
    )


def minute_counts(logs: DataFrame, late: str = LATE) -> DataFrame:
    return alerts.minute_counts(logs.withWatermark("timestamp", late))


def hourly_means(results: DataFrame, late: str = LATE) -> DataFrame:
    return alerts.hourly_means(results.withWatermark("timestamp", late))


def stream_source_volume_approx(results: DataFrame, late: str = LATE) -> DataFrame:
    """One-step form with a fixed-size sketch of the senders."""
    hours = results.withWatermark("timestamp", late).groupBy(
        F.window("timestamp", HOUR).alias("w"), "source_type"
    ).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.approx_count_distinct("source_id", 0.02).alias("unique_sources"),
    )
    return hours.select(F.col("w.start").alias("hour"), "source_type", "message_count", "unique_sources")


def stream_error_rate_alerts(
    logs: DataFrame, limit: float = ERROR_SHARE_LIMIT, late: str = LATE
) -> DataFrame:
    """Closed five-minute windows whose error share exceeds ``limit``."""
    return alerts.error_rate_alerts(logs.withWatermark("timestamp", late), limit)


def stream_threshold_alerts(
    measures: DataFrame, fields: Sequence[str], rules: Sequence[AlertRule] = ALERT_RULES
) -> DataFrame:
    """Rows that break a rule, as they arrive (stateless stream–static join)."""
    return alerts.threshold_alerts(measures, fields, rules)


def stream_shift_alerts(results: DataFrame, delta: float = 0.5, late: str = LATE) -> DataFrame:
    """Live form of ``sentiment_shift_alerts``: closed hours against the hour before."""
    return compare_hours(alerts.hourly_means(results.withWatermark("timestamp", late)), delta)


# ---- mergeable forms ---------------------------------------------------------------------------


def _hour():
    return F.date_trunc("hour", "timestamp")


def _sums(*columns: str) -> dict:
    """Exact sum and number of known values of each column."""
    out = {}
    for c in columns:
        out[f"{c}_sum"] = (F.sum(c), F.sum)
        out[f"{c}_known"] = (F.count(c), F.sum)
    return out


def _mean(column: str):
    return F.try_divide(F.col(f"{column}_sum").cast("double"), F.col(f"{column}_known"))


def hourly() -> RollUp:
    """``hourly_sentiment_summary``."""
    return windowed(
        {"hour": _hour(), **{c: F.col(c) for c in ("source_type", "sentiment_label")}},
        {
            "count": (F.count(F.lit(1)), F.sum),
            **_sums("sentiment_score", "confidence_score"),
            "low": (F.min("sentiment_score"), F.min),
            "high": (F.max("sentiment_score"), F.max),
        },
        lambda rows: rows.select(
            "hour",
            "source_type",
            "sentiment_label",
            "count",
            _mean("sentiment_score").alias("avg_score"),
            _mean("confidence_score").alias("avg_confidence"),
            F.col("low").cast("double").alias("min_score"),
            F.col("high").cast("double").alias("max_score"),
        ),
    )


def volume() -> RollUp:
    """``source_volume_metrics``; partial rows by sender keep the number of senders exact."""
    return windowed(
        {"hour": _hour(), **{c: F.col(c) for c in ("source_type", "source_id")}},
        {
            "n": (F.count(F.lit(1)), F.sum),
            "confidence": (F.sum("confidence_score"), F.sum),
            "known": (F.count("confidence_score"), F.sum),
        },
        volume_of,
    )


def error_rates(limit: float = ERROR_SHARE_LIMIT) -> RollUp:
    """``error_rate_alerts``; sliding windows are added up from minutes."""
    return windowed(
        {"minute": F.date_trunc("minute", "timestamp"), "component": F.col("component")},
        {
            "lines": (F.count(F.lit(1)), F.sum),
            "errors": (F.count(F.when(F.col("level").isin("ERROR", "FATAL"), 1)), F.sum),
        },
        lambda rows: alerts.error_rates_of(rows, limit),
        "5 minutes",
    )


def shifts(delta: float = 0.5) -> RollUp:
    """``sentiment_shift_alerts``."""
    return windowed(
        {"hour": _hour(), "source_type": F.col("source_type")},
        _sums("sentiment_score"),
        lambda rows: alerts.shifts_of(
            rows.select("source_type", "hour", _mean("sentiment_score").alias("avg_score")), delta
        ),
    )
