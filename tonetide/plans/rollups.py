"""Queries: roll-ups, alerts, errors, metrics, retention, logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.operators import alerts, errors, logs, metrics, retention, summaries
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources import tables
from tonetide.sources.errors import ErrorTable
from tonetide.sources.summaries import DAY, SummaryTable, touched_days, with_day_of

MIDDLE = dt.datetime(2024, 1, 15)
MIDDLE_SQL = "TIMESTAMP '2024-01-15 00:00:00'"


def _at(moment: dt.datetime):
    return F.lit(moment).cast("timestamp_ntz")


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows before the middle of the month (those without a time too) and the others."""
    late = F.coalesce(F.col("timestamp") >= _at(MIDDLE), F.lit(False))
    return rows.filter(~late), rows.filter(late)


def hourly_sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.hourly_sentiment_summary(fx.v_sentiment(spark, sf_dir))


def daily_sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.daily_sentiment_summary(fx.v_sentiment(spark, sf_dir))


def source_volume_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.source_volume_metrics(fx.v_sentiment(spark, sf_dir))


def refresh_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three views as of mid-month, stored by day, refreshed with the rows that came after."""
    results = with_day_of(fx.v_sentiment(spark, sf_dir))
    before, after = _halves(results)
    path = fresh_path(spark, "results")
    tables.write_partitioned(before.hint("rebalance", F.col(DAY)), path, [DAY])

    def stored_results():
        return spark.read.schema(results.schema).parquet(path)

    views = {
        name: SummaryTable(spark, fresh_path(spark, f"view-{name}"), name, stored_results)
        for name in summaries.SUMMARY_VIEWS
    }
    days = touched_days(before)
    for table in views.values():
        table.refresh_days(days)
    tables.write_partitioned(after.hint("rebalance", F.col(DAY)), path, [DAY])
    days = touched_days(after)
    for table in views.values():
        table.refresh_days(days)
    parts = []
    for view, (_, unit) in summaries.SUMMARY_VIEWS.items():
        fresh = views[view].read()
        count = "message_count" if view == "volume" else "count"
        label = F.lit("") if view == "volume" else F.col("sentiment_label")
        parts.append(
            fresh.select(
                F.lit(view).alias("view"),
                F.col(unit).alias("bucket"),
                "source_type",
                label.alias("sentiment_label"),
                F.col(count).alias("count"),
                "avg_confidence",
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sentiment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fx.v_sentiment(spark, sf_dir)
    whole = summaries.sentiment_stats(results).select(F.lit("all").alias("scope"), "*")
    bounded = summaries.sentiment_stats(
        results, "purchase", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
    ).select(F.lit("purchase").alias("scope"), "*")
    empty = summaries.sentiment_stats(results, "no-such-source").select(
        F.lit("none").alias("scope"), "*"
    )
    return whole.unionByName(bounded).unionByName(empty)


def recent_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.recent_window_summary(fx.v_sentiment(spark, sf_dir), dt.datetime(2024, 1, 30, 12))


def bucket_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = summaries.bucket_sentiment(fx.v_scored(spark, sf_dir))
    return buckets.withColumn("entities", F.array_join("entities", ","))


def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior state from the first eight hours, merged with the rest."""
    scored = fx.v_scored(spark, sf_dir)
    cut = _at(dt.datetime(2024, 1, 1, 8))
    prior = summaries.entity_partials(scored.filter(F.col("timestamp") < cut))
    return summaries.entity_summary(scored.filter(F.col("timestamp") >= cut), prior)


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored summary of the first half of the month, extended by the second half."""
    failed = fx.v_logs(spark, sf_dir).filter("level = 'ERROR'")
    table = ErrorTable(spark, fresh_path(spark, "errors"))
    for batch, rows in enumerate(_halves(failed)):
        table.add(rows, batch)
    return table.read()


def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from the stored summary."""
    table = ErrorTable(spark, fresh_path(spark, "errors"))
    table.add(fx.v_logs(spark, sf_dir).filter("level = 'ERROR'"), 0)
    return errors.recent_errors(table.read(), fx.AS_OF)


def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pipeline_counters(fx.v_outcomes(spark, sf_dir))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_histogram(fx.v_latencies(spark, sf_dir), "source_type")


def performance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.performance_rollup(fx.v_metrics(spark, sf_dir))


def parse_access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_access_logs(fx.v_access_lines(spark, sf_dir))
    return parsed.select(
        "id", "timestamp", "level", "method", "path",
        F.col("status_code").cast("long").alias("status_code"), "duration_ms", "client_ip", "error",
        "parsed",
    )


def access_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_access_logs(fx.v_access_lines(spark, sf_dir)).filter("parsed")
    return metrics.access_log_summary(parsed)


def processing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.processing_stats(
        fx.v_seen(spark, sf_dir),
        fx.v_emb(spark, sf_dir),
        fx.v_cache(spark, sf_dir),
        fx.v_outcomes(spark, sf_dir),
        fx.AS_OF,
    )


def sentiment_shift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.sentiment_shift_alerts(fx.v_sentiment(spark, sf_dir), 0.5)


def sentiment_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends by source (events) and by asset class (documents)."""
    by_source = summaries.sentiment_trend(fx.v_sentiment(spark, sf_dir), F.col("source_type"), 24)
    classes = fx.v_scored(spark, sf_dir).select(
        "timestamp",
        "sentiment_score",
        F.explode(F.array_distinct(F.transform("entities", lambda e: e["asset_class"]))).alias("asset_class"),
    )
    by_class = summaries.sentiment_trend(classes, F.col("asset_class"), 3)
    return by_source.select(F.lit("source").alias("kind"), "*").unionByName(
        by_class.select(F.lit("asset_class").alias("kind"), "*")
    )


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top_sources(fx.v_sentiment(spark, sf_dir), 5)


def purge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "raw-monthly")
    raw = fx.v_raw(spark, sf_dir)
    tables.write_monthly(raw, path)
    tables.purge_raw_table(spark, path, dt.datetime(2024, 1, 8, 8))
    # with a schema, as a table without any files left has none
    return spark.read.schema(raw.schema).parquet(path).select("id", "source", "created_at")


def purge_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retention.purge_processed(
        fx.v_raw(spark, sf_dir), dt.datetime(2024, 1, 1, 12), dt.timedelta(hours=4)
    )
    return kept.select("id", "processed_at")


def purge_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept_logs, kept_metrics = retention.purge_logs(
        fx.v_logs(spark, sf_dir), fx.v_metrics(spark, sf_dir), dt.datetime(2024, 1, 31, 6), 14
    )
    return kept_logs.select(F.lit("log").alias("kind"), "id", "timestamp").unionByName(
        kept_metrics.select(F.lit("metric").alias("kind"), "id", "timestamp")
    )


def expire_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.expire_state(fx.v_seen(spark, sf_dir), fx.AS_OF)


def parse_app_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_app_logs(fx.v_log_lines(spark, sf_dir)).drop("value")


def log_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_volume(fx.v_logs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        hourly_sentiment_summary, daily_sentiment_summary, source_volume_metrics, refresh_summaries,
        sentiment_stats, recent_window_summary, bucket_sentiment, entity_summary, error_summary,
        recent_errors, pipeline_counters, latency_histogram, performance_rollup, access_log_summary,
        processing_stats, sentiment_shift_alerts, sentiment_trend, top_sources, purge_raw,
        purge_processed, purge_logs, expire_state, parse_app_logs, parse_access_logs, log_volume,
    )
}

_MEANS = (
    "sum(sentiment_score)::double / count(*) AS avg_score, "
    "sum(confidence_score)::double / count(*) AS avg_confidence"
)
_ERRORS = """
errors AS (SELECT *, row_number() OVER (PARTITION BY component, error_type ORDER BY "timestamp", id) AS rn
  FROM v_logs WHERE level = 'ERROR'),
summary AS (SELECT component, error_type, count(*) AS error_count, min("timestamp") AS first_occurrence,
  max("timestamp") AS last_occurrence, arg_max(message, rn) FILTER (WHERE (rn - 1) % 100 = 0) AS sample_message
  FROM errors GROUP BY 1, 2)"""

ORACLES = {
    "hourly_sentiment_summary": f"""
SELECT date_trunc('hour', "timestamp")::timestamp AS hour, source_type, sentiment_label, count(*) AS count, {_MEANS},
  min(sentiment_score)::double AS min_score, max(sentiment_score)::double AS max_score
FROM v_sentiment GROUP BY 1, 2, 3""",
    "daily_sentiment_summary": f"""
SELECT date_trunc('day', "timestamp")::timestamp AS day, source_type, sentiment_label, count(*) AS count, {_MEANS},
  round(stddev_samp(sentiment_score::double), 6) AS score_stddev
FROM v_sentiment GROUP BY 1, 2, 3""",
    "source_volume_metrics": """
SELECT date_trunc('hour', "timestamp")::timestamp AS hour, source_type, count(*) AS message_count,
  count(DISTINCT source_id) AS unique_sources, sum(confidence_score)::double / count(*) AS avg_confidence
FROM v_sentiment GROUP BY 1, 2""",
    "refresh_summaries": """
SELECT 'hourly' AS view, date_trunc('hour', "timestamp")::timestamp AS bucket, source_type, sentiment_label,
  count(*) AS count, sum(confidence_score)::double / count(*) AS avg_confidence FROM v_sentiment GROUP BY 2, 3, 4
UNION ALL SELECT 'daily', date_trunc('day', "timestamp")::timestamp, source_type, sentiment_label,
  count(*), sum(confidence_score)::double / count(*) FROM v_sentiment GROUP BY 2, 3, 4
UNION ALL SELECT 'volume', date_trunc('hour', "timestamp")::timestamp, source_type, '',
  count(*), sum(confidence_score)::double / count(*) FROM v_sentiment GROUP BY 2, 3""",
    "sentiment_stats": f"""
WITH scoped AS (SELECT 'all' AS scope, * FROM v_sentiment UNION ALL
  SELECT 'purchase', * FROM v_sentiment WHERE source_type = 'purchase'
    AND "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')
SELECT scope, sentiment_label AS sentiment, count(*) AS count, {_MEANS} FROM scoped GROUP BY 1, 2
UNION ALL SELECT scope, '(total)', count(*), {_MEANS} FROM scoped GROUP BY 1
UNION ALL SELECT 'none', '(total)', 0, 0.0::double, 0.0::double""",
    "recent_window_summary": f"""
SELECT source_type, sentiment_label, count(*) AS count, {_MEANS} FROM v_sentiment
WHERE "timestamp" > TIMESTAMP '2024-01-30 11:00:00' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2""",
    "bucket_sentiment": f"""
WITH cells AS (SELECT date_trunc('hour', "timestamp")::timestamp AS time_bucket, source_type AS source,
    sentiment_label AS sentiment, count(*) AS count, {_MEANS} FROM v_scored GROUP BY 1, 2, 3),
named AS (SELECT DISTINCT date_trunc('hour', "timestamp")::timestamp AS time_bucket, source_type AS source,
    sentiment_label AS sentiment, entity_value FROM v_scored JOIN v_entities USING (id)),
lists AS (SELECT time_bucket, source, sentiment, string_agg(entity_value, ',' ORDER BY entity_value) AS entities
    FROM named GROUP BY 1, 2, 3)
SELECT cells.*, coalesce(entities, '') AS entities FROM cells LEFT JOIN lists USING (time_bucket, source, sentiment)""",
    "entity_summary": """
SELECT entity_type, entity_value, sentiment_label, count(*) AS occurrence_count,
  sum(sentiment_score)::double / count(*) AS avg_sentiment_score,
  min("timestamp") AS first_seen, max("timestamp") AS last_seen
FROM v_scored JOIN v_entities USING (id) GROUP BY 1, 2, 3""",
    "error_summary": f"WITH {_ERRORS.strip()} SELECT * FROM summary",
    "recent_errors": f"""WITH {_ERRORS.strip()}
SELECT component, error_type, error_count, last_occurrence, sample_message,
  round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_occurrence)) / 3600000000.0::double, 6) AS hours_since_last
FROM summary WHERE last_occurrence > TIMESTAMP '2024-01-30 00:00:00'""",
    "pipeline_counters": """
WITH cells AS (
  SELECT 'messages_processed' AS counter, source AS label_1, '' AS label_2 FROM v_outcomes WHERE outcome = 'processed'
  UNION ALL SELECT 'errors', source, error_type FROM v_outcomes WHERE outcome = 'error'
  UNION ALL SELECT 'database_operations', operation, write_status FROM v_outcomes WHERE operation IS NOT NULL)
SELECT counter, label_1, label_2, count(*) AS value FROM cells GROUP BY 1, 2, 3
UNION ALL SELECT counter, '(all)', '(all)', count(*) FROM cells GROUP BY 1""",
    "latency_histogram": """
SELECT source_type, le, count(*) FILTER (WHERE latency_seconds <= bound) AS cumulative_count,
  sum(latency_seconds::decimal(20,6))::double AS latency_sum, count(*) AS observations
FROM v_latencies, (VALUES ('0.1', 0.1), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('5', 5), ('10', 10), ('30', 30),
  ('60', 60), ('+Inf', 1e9)) b(le, bound) GROUP BY 1, 2""",
    "performance_rollup": """
SELECT component, metric_name, metric_unit, date_trunc('hour', "timestamp")::timestamp AS hour, count(*) AS samples,
  sum(metric_value)::double / count(*) AS avg_value, max(metric_value)::double AS max_value,
  round(quantile_cont(metric_value::double, 0.5), 6) AS p50_value,
  round(quantile_cont(metric_value::double, 0.95), 6) AS p95_value
FROM v_metrics GROUP BY 1, 2, 3, 4""",
    "access_log_summary": """
SELECT path, count(*) AS requests_total, count(*) FILTER (WHERE status_code < 400) AS requests_success,
  count(*) FILTER (WHERE status_code >= 400) AS requests_error,
  round(sum(duration_ms::decimal(20,6))::double / count(*), 6) AS mean_response_ms
FROM v_access GROUP BY 1""",
    "processing_stats": """
SELECT (SELECT count(*) FROM v_seen WHERE expires_at > TIMESTAMP '2024-01-31') AS processed_items,
  (SELECT count(*) FROM embeddings) AS stored_embeddings,
  (SELECT count(*) FROM v_cache WHERE expires_at > TIMESTAMP '2024-01-31') AS cached_sentiments,
  ((SELECT count(*) FROM v_seen WHERE expires_at > TIMESTAMP '2024-01-31')
   + (SELECT count(*) FROM v_cache WHERE expires_at > TIMESTAMP '2024-01-31')) * 1800 AS total_ttl,
  (SELECT count(*) FROM v_outcomes WHERE outcome = 'processed') AS processed_count,
  (SELECT count(*) FROM v_outcomes WHERE outcome = 'error') AS error_count""",
    "sentiment_shift_alerts": """
WITH means AS (SELECT source_type, date_trunc('hour', "timestamp")::timestamp AS hour,
    sum(sentiment_score)::double / count(*) AS avg_score FROM v_sentiment GROUP BY 1, 2)
SELECT a.source_type, a.hour, a.avg_score, b.avg_score AS previous_score, a.avg_score - b.avg_score AS change
FROM means a JOIN means b ON a.source_type = b.source_type AND b.hour = a.hour - INTERVAL 1 HOUR
WHERE abs(a.avg_score - b.avg_score) > 0.5""",
    "sentiment_trend": """
WITH cells AS (
  SELECT 'source' AS kind, source_type AS dimension, date_trunc('hour', "timestamp")::timestamp AS period,
    count(*) AS volume, sum(sentiment_score)::decimal(28,4) AS s FROM v_sentiment GROUP BY 1, 2, 3
  UNION ALL SELECT 'asset_class', asset_class, date_trunc('hour', "timestamp")::timestamp, count(*),
    sum(sentiment_score)::decimal(28,4)
  FROM v_scored JOIN (SELECT DISTINCT id, asset_class FROM v_entities) USING (id) GROUP BY 1, 2, 3),
rolled AS (
  SELECT *, sum(volume) OVER w AS rv, sum(s) OVER w AS rs FROM cells WHERE kind = 'source'
    WINDOW w AS (PARTITION BY dimension ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
  UNION ALL SELECT *, sum(volume) OVER w AS rv, sum(s) OVER w AS rs FROM cells WHERE kind = 'asset_class'
    WINDOW w AS (PARTITION BY dimension ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT kind, dimension, period, volume, s::double / volume AS avg_score, rv::bigint AS rolling_volume,
  rs::double / rv AS rolling_score FROM rolled""",
    "top_sources": """
SELECT source_type, sentiment_label, count(*) AS count FROM v_sentiment GROUP BY 1, 2
ORDER BY 3 DESC, 1, 2 LIMIT 5""",
    "purge_raw": "SELECT id, source, created_at FROM v_raw WHERE created_at >= TIMESTAMP '2024-01-01 08:00:00'",
    "purge_processed": """
SELECT id, processed_at FROM v_raw WHERE processed_at IS NULL OR processed_at >= TIMESTAMP '2024-01-01 08:00:00'""",
    "purge_logs": """
SELECT 'log' AS kind, id, "timestamp" FROM v_logs WHERE "timestamp" >= TIMESTAMP '2024-01-17 00:00:00'
UNION ALL SELECT 'metric', id, "timestamp" FROM v_metrics WHERE "timestamp" >= TIMESTAMP '2024-01-17 06:00:00'""",
    "expire_state": "SELECT content_hash, expires_at FROM v_seen WHERE expires_at > TIMESTAMP '2024-01-31'",
    "parse_app_logs": """
SELECT id, CASE WHEN ok THEN date_trunc('millisecond', "timestamp") END AS "timestamp",
  CASE WHEN ok THEN component END AS component, CASE WHEN ok THEN level END AS level,
  CASE WHEN ok THEN message END AS message, ok AS parsed
FROM (SELECT *, instr('0123456789abcdef', substr(md5(id::varchar), 1, 1)) <> 8 AS ok FROM v_logs)""",
    "parse_access_logs": """
SELECT event_id AS id, "timestamp", level, method, path, status_code, duration_ms, client_ip, error,
  id IS NOT NULL AS parsed FROM events LEFT JOIN v_access ON id = event_id""",
    "log_volume": """
SELECT date_trunc('day', "timestamp")::timestamp AS day, component, count(*) AS lines,
  count(*) FILTER (WHERE level = 'DEBUG') AS debug, count(*) FILTER (WHERE level = 'INFO') AS info,
  count(*) FILTER (WHERE level = 'WARN') AS warn, count(*) FILTER (WHERE level = 'ERROR') AS error,
  count(*) FILTER (WHERE level = 'FATAL') AS fatal
FROM v_logs GROUP BY 1, 2""",
}
