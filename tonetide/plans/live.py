"""Queries: streams over the given tables, drained into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.operators import ingest
from tonetide.operators.gazetteer import Gazetteer
from tonetide.operators.responses import financial_outlook
from tonetide.operators.scoring import lexicon_scorer
from tonetide.operators.texts import gazetteer_table
from tonetide.plans.views import TOKENS, gazetteer_values, weigh
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources import topics
from tonetide.streaming import live, pipeline, rollup, seen, sinks


def _ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


def _sentiment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.events_stream(spark, sf_dir).select(*fx.sentiment_of_event())


def _topic(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` published to a topic folder and read back as a stream of messages."""
    path = fresh_path(spark, "topic")
    published = ingest.to_message_rows(rows, published_at=F.col("timestamp"))
    topics.write_topic_files(published, path)
    return topics.read_sentiment_topic(spark, "parquet", {"path": path})


def read_sentiment_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sinks.drain_to_table(_topic(spark, fx.v_raw(spark, sf_dir)), "messages")
    return stored.select(
        "source", "source_id", "content_hash", F.sha2("content", 256).alias("content_sha"), _ntz("timestamp")
    )


def write_results_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sinks.drain_by_day(_sentiment_stream(spark, sf_dir), "results")
    return stored.select(
        "id", "source_id", "source_type", "sentiment_label", _ntz("timestamp"),
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        F.col("confidence_score").cast("double").alias("confidence_score"),
    )


def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _topic(spark, fx.v_pipeline(spark, sf_dir))
    aliases = Gazetteer(gazetteer_table(spark, fx.GAZETTEER))
    outcomes = pipeline.drain_pipeline(
        messages,
        lexicon_scorer(fx.LEXICON),
        stages=(lambda df: aliases.with_entities(df, "content_hash"), financial_outlook),
    )
    financial = F.col("financial_sentiment")
    return outcomes.select(
        "kind", "source", "source_id", "content_hash", _ntz("timestamp"), "sentiment_label",
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        F.col("confidence_score").cast("double").alias("confidence_score"),
        "error_type",
        F.array_join(F.col("entities")["entity_value"], ",").alias("entities"),
        financial["market_sentiment"].alias("market_sentiment"),
        financial["risk_level"].alias("risk_level"),
        financial["trading_signal"].alias("trading_signal"),
        (F.col("processed_at").isNotNull()).alias("stamped"),
        (F.col("processing_time_ms") >= 0).alias("timed"),
    )


def _live(spark: SparkSession, name: str, stream: DataFrame, form: rollup.RollUp) -> DataFrame:
    return rollup.drain(stream, fresh_path(spark, name), form).current()


def stream_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fx.messages_from(fx.events_stream(spark, sf_dir)).withColumn(
        "source_id", F.lpad(F.col("id").cast("string"), 12, "0")
    )
    passed = _live(spark, "first-seen", messages, seen.first_seen(12 * 3600, buckets=16))
    return passed.select("id", "source", "content_hash")


def stream_hourly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _live(spark, "hourly", _sentiment_stream(spark, sf_dir), live.hourly())
    return hours.withColumn("hour", _ntz("hour"))


def stream_source_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _live(spark, "volume", _sentiment_stream(spark, sf_dir), live.volume())
    return hours.withColumn("hour", _ntz("hour"))


def stream_error_rate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = fx.logs_from(fx.events_stream(spark, sf_dir))
    found = _live(spark, "error-rate", logs, live.error_rates())
    return found.withColumn("window_start", _ntz("window_start")).withColumn(
        "window_end", _ntz("window_end")
    )


def stream_threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = (F.col("value").cast("decimal(12,2)") * F.lit("0.1").cast("decimal(2,1)")).alias(
        "latency_seconds"
    )
    measures = fx.events_stream(spark, sf_dir).select(*fx.sentiment_of_event(), latency)
    alerts = live.stream_threshold_alerts(measures, ["sentiment_score", "latency_seconds"])
    return sinks.drain_to_table(alerts, "threshold").withColumn("timestamp", _ntz("timestamp"))


def stream_shift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _live(spark, "shifts", _sentiment_stream(spark, sf_dir), live.shifts(0.5))
    return found.withColumn("hour", _ntz("hour"))


QUERIES = {
    f.__name__: f
    for f in (
        read_sentiment_topic, write_results_batch, stream_pipeline, stream_dedup_ttl,
        stream_hourly_summary, stream_source_volume, stream_error_rate_alerts,
        stream_threshold_alerts, stream_shift_alerts,
    )
}


def _pipeline_sql() -> str:
    net = weigh("words", fx.LEXICON)
    hits = weigh("words", {t: 1 for t in fx.LEXICON})
    return f"""
WITH winners AS (SELECT *, {TOKENS.format(text='text')} AS words FROM v_pipeline
    WHERE content_hash <> '' AND text IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY "timestamp", source_id) = 1),
scored AS (SELECT *, (greatest(least({net}, 10), -10)::decimal(10,0) * 0.1::decimal(2,1))::decimal(5,4) AS score,
    {hits} AS hits FROM winners),
labelled AS (SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
    ' ' || array_to_string(words, '  ') || ' ' AS spaced FROM scored),
named AS (SELECT content_hash, string_agg(entity_value, ',' ORDER BY entity_type, entity_value, asset_class) AS names FROM (
    SELECT DISTINCT content_hash, entity_type, entity_value, asset_class FROM labelled
    JOIN (VALUES {gazetteer_values()}) z(alias, entity_type, entity_value, asset_class)
      ON contains(spaced, ' ' || replace(alias, ' ', '  ') || ' ')) GROUP BY 1)
SELECT 'result' AS kind, source, source_id, content_hash, "timestamp", label AS sentiment_label,
  score::double AS sentiment_score,
  (CASE WHEN hits = 0 THEN 0.5 ELSE ((hits * 10000) // len(words)) * 0.0001::decimal(5,4) END)::decimal(5,4)::double AS confidence_score,
  NULL::varchar AS error_type, coalesce(names, '') AS entities,
  CASE label WHEN 'positive' THEN 'bullish' WHEN 'negative' THEN 'bearish' ELSE 'neutral' END AS market_sentiment,
  CASE WHEN abs(score) >= 0.7 THEN 'high' WHEN abs(score) >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN abs(score) < 0.7 THEN 'hold' WHEN score > 0 THEN 'buy' ELSE 'sell' END AS trading_signal,
  true AS stamped, true AS timed
FROM labelled LEFT JOIN named USING (content_hash)
UNION ALL SELECT 'reject', source, source_id, content_hash, "timestamp", NULL, NULL, NULL,
  CASE WHEN content_hash = '' THEN 'missing_hash' ELSE 'no_text' END, NULL, NULL, NULL, NULL, true, NULL
FROM v_pipeline WHERE content_hash = '' OR text IS NULL"""


ORACLES = {
    "read_sentiment_topic": """
SELECT source, source_id, content_hash, sha256(content) AS content_sha, "timestamp" FROM v_raw""",
    "write_results_batch": """
SELECT id, source_id, source_type, sentiment_label, "timestamp", sentiment_score::double AS sentiment_score,
  confidence_score::double AS confidence_score FROM v_sentiment""",
    "stream_pipeline": _pipeline_sql(),
    "stream_dedup_ttl": """
WITH ordered AS (SELECT *, lag("timestamp") OVER (PARTITION BY content_hash ORDER BY "timestamp", id) AS before FROM v_messages)
SELECT id, source, content_hash FROM ordered WHERE before IS NULL OR "timestamp" >= before + INTERVAL 12 HOUR""",
    "stream_hourly_summary": """
SELECT date_trunc('hour', "timestamp")::timestamp AS hour, source_type, sentiment_label, count(*) AS count,
  sum(sentiment_score)::double / count(*) AS avg_score, sum(confidence_score)::double / count(*) AS avg_confidence,
  min(sentiment_score)::double AS min_score, max(sentiment_score)::double AS max_score
FROM v_sentiment GROUP BY 1, 2, 3""",
    "stream_source_volume": """
SELECT date_trunc('hour', "timestamp")::timestamp AS hour, source_type, count(*) AS message_count,
  count(DISTINCT source_id) AS unique_sources, sum(confidence_score)::double / count(*) AS avg_confidence
FROM v_sentiment GROUP BY 1, 2""",
    "stream_error_rate_alerts": """
WITH spread AS (SELECT component, level, date_trunc('minute', "timestamp")::timestamp - to_minutes(m) AS window_start
  FROM v_logs, (VALUES (0), (1), (2), (3), (4)) s(m)),
rated AS (SELECT component, window_start, count(*) AS lines, count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS errors
  FROM spread GROUP BY 1, 2)
SELECT component, window_start, window_start + INTERVAL 5 MINUTE AS window_end, lines, errors,
  errors::double / lines AS error_share
FROM rated WHERE errors::double / lines > 0.05""",
    "stream_threshold_alerts": """
WITH pairs AS (
  SELECT id, source_type, "timestamp", 'sentiment_score' AS field, sentiment_score::double AS value FROM v_sentiment
  UNION ALL SELECT id, source_type, "timestamp", 'latency_seconds', latency_seconds::double FROM v_latencies)
SELECT 'score-low' AS rule_id, 'warning' AS severity, * FROM pairs WHERE field = 'sentiment_score' AND value <= -0.9
UNION ALL SELECT 'score-high', 'info', * FROM pairs WHERE field = 'sentiment_score' AND value >= 0.9
UNION ALL SELECT 'error-negative', 'critical', * FROM pairs
  WHERE field = 'sentiment_score' AND value < -0.95 AND source_type = 'error'
UNION ALL SELECT 'slow-scoring', 'warning', * FROM pairs WHERE field = 'latency_seconds' AND value > 10""",
    "stream_shift_alerts": """
WITH means AS (SELECT source_type, date_trunc('hour', "timestamp")::timestamp AS hour,
    sum(sentiment_score)::double / count(*) AS avg_score FROM v_sentiment GROUP BY 1, 2)
SELECT a.source_type, a.hour, a.avg_score, b.avg_score AS previous_score, a.avg_score - b.avg_score AS change
FROM means a JOIN means b ON a.source_type = b.source_type AND b.hour = a.hour - INTERVAL 1 HOUR
WHERE abs(a.avg_score - b.avg_score) > 0.5""",
}
