"""Pipeline counters, latency histograms and performance roll-ups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonetide.schemas import LATENCY_BOUNDS


def pipeline_counters(outcomes: DataFrame) -> DataFrame:
    """Messages per source, errors per source and type, writes per operation and status.

    ``outcomes``: source, outcome ('processed' | 'error'), error_type, operation,
    write_status. Each row can feed all three counters, so the counters are
    emitted as narrow (counter, label_1, label_2) rows and counted in one pass;
    totals per counter come from the same aggregate by grouping sets.
    """
    counter = F.array_compact(
        F.array(
            F.when(
                F.col("outcome") == "processed",
                F.struct(
                    F.lit("messages_processed").alias("counter"),
                    F.col("source").alias("label_1"),
                    F.lit("").alias("label_2"),
                ),
            ),
            F.when(
                F.col("outcome") == "error",
                F.struct(
                    F.lit("errors").alias("counter"),
                    F.col("source").alias("label_1"),
                    F.col("error_type").alias("label_2"),
                ),
            ),
            F.when(
                F.col("operation").isNotNull(),
                F.struct(
                    F.lit("database_operations").alias("counter"),
                    F.col("operation").alias("label_1"),
                    F.col("write_status").alias("label_2"),
                ),
            ),
        )
    )
    narrow = outcomes.select(F.explode(counter).alias("c")).select("c.*")
    cells = narrow.groupBy("counter", "label_1", "label_2").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupingSets(
        [["counter", "label_1", "label_2"], ["counter"]], "counter", "label_1", "label_2"
    ).agg(F.sum("n").alias("value")).select(
        "counter",
        F.coalesce("label_1", F.lit("(all)")).alias("label_1"),
        F.coalesce("label_2", F.lit("(all)")).alias("label_2"),
        "value",
    )


def latency_histogram(
    latencies: DataFrame, key: str = "source", bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Cumulative histogram rows per ``key``: le, observations ≤ le, sum and count.

    All buckets are conditional sums of one aggregation; rows are unfolded after it.
    """
    sums = [
        F.sum(F.when(F.col("latency_seconds") <= b, 1).otherwise(0)).alias(f"b{i}")
        for i, b in enumerate(bounds)
    ]
    wide = latencies.groupBy(key).agg(
        *sums,
        F.count("latency_seconds").alias("observations"),
        F.sum(F.col("latency_seconds").cast("decimal(20,6)")).cast("double").alias("latency_sum"),
    )
    cells = [
        F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("cumulative_count"))
        for i, b in enumerate(bounds)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("cumulative_count"))]
    return wide.select(key, F.explode(F.array(*cells)).alias("c"), "latency_sum", "observations").select(
        key, "c.le", "c.cumulative_count", "latency_sum", "observations"
    )


PERCENTILES = {"p50": 0.50, "p95": 0.95}


def performance_rollup(metrics: DataFrame) -> DataFrame:
    """Mean, exact p50 and p95, and maximum per component, metric, unit and hour.

    Rows are first counted per distinct value, so a value that most rows share is one row;
    percentiles interpolate between the two nearest ranks of the running count. NULL units
    form groups of their own; NULL values count as samples only.
    """
    keys = ["component", "metric_name", "metric_unit", "hour"]
    values = (
        metrics.withColumn("hour", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
        .groupBy(*keys, "metric_value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("known", F.when(F.col("metric_value").isNotNull(), F.col("n")).otherwise(0))
    )
    whole = Window.partitionBy(*keys)
    rising = whole.orderBy("metric_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumns(
        {"upto": F.sum("known").over(rising), "size": F.sum("known").over(whole)}
    )
    columns = []
    for name, share in PERCENTILES.items():
        at = (F.col("size") - 1) * F.lit(share) + 1
        low, high = (
            F.min(F.when(F.col("upto") >= f(at), F.col("metric_value"))).cast("double")
            for f in (F.floor, F.ceil)
        )
        weight = F.max(at - F.floor(at))
        columns.append(F.round(low + (high - low) * weight, 6).alias(f"{name}_value"))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        F.try_divide(
            F.sum(F.col("metric_value") * F.col("known")).cast("double"), F.sum("known")
        ).alias("avg_value"),
        F.max("metric_value").cast("double").alias("max_value"),
        *columns,
    )


def access_log_summary(access: DataFrame) -> DataFrame:
    """Requests total, successful and failed, and mean response time per path."""
    success = F.col("status_code").between(200, 399)
    return access.groupBy("path").agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.sum(F.when(success, 1).otherwise(0)).alias("requests_success"),
        F.sum(F.when(success, 0).otherwise(1)).alias("requests_error"),
        F.round(
            F.sum(F.col("duration_ms").cast("decimal(20,6)")).cast("double")
            / F.count("duration_ms"),
            6,
        ).alias("mean_response_ms"),
    )


def processing_stats(
    seen: DataFrame,
    embeddings: DataFrame,
    cached_scores: DataFrame,
    outcomes: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """One row: live seen-hash entries, embeddings, live cached scores, remaining TTL,
    processed and failed messages."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def remaining():
        seconds = F.unix_seconds(F.col("expires_at").cast("timestamp")) - F.unix_seconds(
            now.cast("timestamp")
        )
        return F.greatest(seconds, F.lit(0))

    live = F.when(F.col("expires_at") > now, 1).otherwise(0)
    tally = [
        ("seen", seen.select(live.alias("n"), remaining().alias("ttl"))),
        ("embedding", embeddings.select(F.lit(1).alias("n"), F.lit(0).cast("long").alias("ttl"))),
        ("cached", cached_scores.select(live.alias("n"), remaining().alias("ttl"))),
        (
            "processed",
            outcomes.filter("outcome = 'processed'").select(
                F.lit(1).alias("n"), F.lit(0).cast("long").alias("ttl")
            ),
        ),
        (
            "error",
            outcomes.filter("outcome = 'error'").select(
                F.lit(1).alias("n"), F.lit(0).cast("long").alias("ttl")
            ),
        ),
    ]
    parts = None
    for kind, frame in tally:
        part = frame.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
            F.coalesce(F.sum("ttl"), F.lit(0)).cast("long").alias("ttl"),
        ).withColumn("kind", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)

    def pick(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("n")))

    return parts.agg(
        pick("seen").alias("processed_items"),
        pick("embedding").alias("stored_embeddings"),
        pick("cached").alias("cached_sentiments"),
        F.sum("ttl").alias("total_ttl"),
        pick("processed").alias("processed_count"),
        pick("error").alias("error_count"),
    )
