"""Table layouts, enumerations and rule tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: names other systems read and write -----------------------
SOURCES = ("truedata", "news", "twitter", "reddit", "economic")
SENTIMENT_LABELS = ("positive", "negative", "neutral")
LOG_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
TEXT_FIELDS = ("text", "content", "body", "message", "description", "title", "headline")
LATENCY_BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
TOPICS = {
    "raw_data": "sentiment_analysis_topic",
    "aggregation_data": "aggregation_topic",
    "alert": "alert_topic",
}
MESSAGE_ORIGIN = "ingestion-service"
SEEN_TTL_SECONDS = 3600
RAW_RETENTION_DAYS = 7
LOG_RETENTION_DAYS = 30
WRITER_BATCH_ROWS = 100
WRITER_INTERVAL_SECONDS = 10
RATE_PER_SECOND = 100
RATE_BURST = 200
DUPLICATE_SIMILARITY = 0.95
SLOW_SCORING_SECONDS = 10.0
ERROR_SHARE_LIMIT = 0.05
# ----------------------------------------------------------------------------

RAW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("processed_at", T.TimestampNTZType()),
    ]
)

SENTIMENT_RESULTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("sentiment_score", T.DecimalType(5, 4)),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("confidence_score", T.DecimalType(5, 4)),
    ]
)

MESSAGE_VALUE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("content", T.VariantType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

ACCESS_ENTRY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("duration", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("request_size", T.LongType()),
        T.StructField("response_size", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class PayloadRule:
    """One field rule of a typed payload."""

    source: str
    field: str
    kind: str  # string | number | integer | url | time
    required: bool = True


PAYLOAD_RULES = (
    PayloadRule("truedata", "id", "string"),
    PayloadRule("truedata", "symbol", "string"),
    PayloadRule("truedata", "price", "number"),
    PayloadRule("truedata", "volume", "integer"),
    PayloadRule("truedata", "timestamp", "time"),
    PayloadRule("news", "id", "string"),
    PayloadRule("news", "source", "string"),
    PayloadRule("news", "headline", "string"),
    PayloadRule("news", "summary", "string", required=False),
    PayloadRule("news", "url", "url"),
    PayloadRule("news", "timestamp", "time"),
    PayloadRule("twitter", "id", "string"),
    PayloadRule("twitter", "user", "string"),
    PayloadRule("twitter", "text", "string"),
    PayloadRule("twitter", "likes", "integer", required=False),
    PayloadRule("twitter", "retweets", "integer", required=False),
    PayloadRule("twitter", "timestamp", "time"),
)


@dataclass(frozen=True)
class AlertRule:
    """A configurable threshold: ``field operator threshold`` for one source or '*'."""

    rule_id: str
    source: str
    field: str
    operator: str  # > >= < <=
    threshold: float
    severity: str


ALERT_RULES = (
    AlertRule("score-low", "*", "sentiment_score", "<=", -0.9, "warning"),
    AlertRule("score-high", "*", "sentiment_score", ">=", 0.9, "info"),
    AlertRule("error-negative", "error", "sentiment_score", "<", -0.95, "critical"),
    AlertRule("slow-scoring", "*", "latency_seconds", ">", SLOW_SCORING_SECONDS, "warning"),
)
