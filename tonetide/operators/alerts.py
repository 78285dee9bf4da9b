"""Alert rules as tables: sudden shifts, error share, thresholds.

The same functions serve batch frames and streams; only
``sentiment_shift_alerts`` needs a batch (its live form keeps state).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonetide.functions.measure import exact_mean, share
from tonetide.functions.stage import literal_table
from tonetide.schemas import ALERT_RULES, ERROR_SHARE_LIMIT, AlertRule

ALERT_RULE_SCHEMA = (
    "rule_id string, rule_source string, field string, operator string, "
    "threshold double, severity string"
)


def hourly_means(results: DataFrame) -> DataFrame:
    return results.groupBy(
        "source_type", F.window("timestamp", "1 hour").alias("w")
    ).agg(
        F.count(F.lit(1)).alias("count"),
        exact_mean("sentiment_score").alias("avg_score"),
    ).select(
        "source_type",
        F.col("w.start").alias("hour"),
        "count",
        "avg_score",
    )


def sentiment_shift_alerts(results: DataFrame, delta: float = 0.5) -> DataFrame:
    """Sources whose hourly mean moved by more than ``delta`` since the hour before."""
    return shifts_of(hourly_means(results), delta)


def shifts_of(means: DataFrame, delta: float = 0.5) -> DataFrame:
    """The same from hourly means (source_type, hour, avg_score)."""
    order = Window.partitionBy("source_type").orderBy("hour")
    return (
        means.withColumn("previous_hour", F.lag("hour").over(order))
        .withColumn("previous_score", F.lag("avg_score").over(order))
        .filter(F.col("previous_hour") == F.col("hour") - F.expr("INTERVAL 1 HOUR"))
        .withColumn("change", F.col("avg_score") - F.col("previous_score"))
        .filter(F.abs("change") > delta)
        .select("source_type", "hour", "avg_score", "previous_score", "change")
    )


def error_rate_alerts(
    logs: DataFrame,
    limit: float = ERROR_SHARE_LIMIT,
    width: str = "5 minutes",
    slide: str = "1 minute",
) -> DataFrame:
    """Sliding windows in which errors are more than ``limit`` of a component's lines."""
    errors = F.sum(F.when(F.col("level").isin("ERROR", "FATAL"), 1).otherwise(0))
    return (
        logs.groupBy("component", F.window("timestamp", width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("lines"), errors.alias("errors"))
        .withColumn("error_share", share(F.col("errors"), F.col("lines")))
        .filter(F.col("error_share") > limit)
        .select(
            "component",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "lines",
            "errors",
            "error_share",
        )
    )


def minute_counts(logs: DataFrame) -> DataFrame:
    """Lines and errors per component and minute: what sliding windows are added up from."""
    errors = F.sum(F.when(F.col("level").isin("ERROR", "FATAL"), 1).otherwise(0))
    minutes = logs.groupBy("component", F.window("timestamp", "1 minute").alias("w"))
    return minutes.agg(F.count(F.lit(1)).alias("lines"), errors.alias("errors")).select(
        "component", F.col("w.start").alias("minute"), "lines", "errors"
    )


def error_rates_of(
    minutes: DataFrame, limit: float = ERROR_SHARE_LIMIT, width: int = 5
) -> DataFrame:
    """``error_rate_alerts`` with one-minute steps, from minute counts: each minute, not each
    line, goes to the ``width`` windows it belongs to."""
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda back: F.col("minute") - F.make_dt_interval(mins=back),
    )
    return (
        minutes.select("component", F.explode(starts).alias("window_start"), "lines", "errors")
        .groupBy("component", "window_start")
        .agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"))
        .withColumn("error_share", share(F.col("errors"), F.col("lines")))
        .filter(F.col("error_share") > limit)
        .select(
            "component",
            "window_start",
            (F.col("window_start") + F.make_dt_interval(mins=F.lit(width))).alias("window_end"),
            "lines",
            "errors",
            "error_share",
        )
    )


def alert_rule_table(
    spark: SparkSession, rules: Sequence[AlertRule] = ALERT_RULES
) -> DataFrame:
    rows = [
        (r.rule_id, r.source, r.field, r.operator, float(r.threshold), r.severity)
        for r in rules
    ]
    return literal_table(spark, rows, ALERT_RULE_SCHEMA)


def threshold_alerts(
    measures: DataFrame, fields: Sequence[str], rules: Sequence[AlertRule] = ALERT_RULES
) -> DataFrame:
    """One row per measure that breaks a rule.

    ``measures`` holds ``id, source_type, timestamp`` and the numeric ``fields``.
    The fields are turned into (field, value) rows and joined with the rule
    table, which is broadcast: it is configuration handed over by the caller.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"))
                for f in fields
            ]
        )
    )
    long = measures.select("id", "source_type", "timestamp", pairs.alias("m")).select(
        "id", "source_type", "timestamp", "m.field", "m.value"
    )
    broken = (
        F.when(F.col("operator") == ">", F.col("value") > F.col("threshold"))
        .when(F.col("operator") == ">=", F.col("value") >= F.col("threshold"))
        .when(F.col("operator") == "<", F.col("value") < F.col("threshold"))
        .when(F.col("operator") == "<=", F.col("value") <= F.col("threshold"))
    )
    table = alert_rule_table(measures.sparkSession, rules)
    return (
        long.join(F.broadcast(table), "field")
        .filter(F.col("rule_source").isin("*") | (F.col("rule_source") == F.col("source_type")))
        .filter(broken)
        .select("rule_id", "severity", "id", "source_type", "timestamp", "field", "value")
    )
