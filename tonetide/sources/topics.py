"""Message topics as streams: Kafka, or a folder of Parquet files in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.functions import payload
from tonetide.functions.stage import with_once
from tonetide.schemas import TOPICS, WRITER_BATCH_ROWS, WRITER_INTERVAL_SECONDS

FILE_SCHEMA = (
    "topic string, key string, value string, "
    "headers array<struct<key string, value binary>>, timestamp timestamp"
)


def read_topic(
    spark: SparkSession,
    kind: str = "raw_data",
    format: str = "kafka",
    options: dict[str, str] | None = None,
    batch_rows: int = WRITER_BATCH_ROWS,
    batch_seconds: int = WRITER_INTERVAL_SECONDS,
) -> DataFrame:
    """A topic from its earliest message: key, value and a ``message_key`` unique per message.

    ``format='kafka'`` needs ``kafka.bootstrap.servers`` in ``options``. A micro-batch
    starts once ``batch_rows`` messages wait or ``batch_seconds`` have passed, and takes all
    there are; set ``maxOffsetsPerTrigger`` in ``options`` to limit it. Any file format
    needs ``path``.
    """
    reader = spark.readStream.format(format)
    if format == "kafka":
        reader = (
            reader.option("subscribe", TOPICS[kind])
            .option("startingOffsets", "earliest")
            .option("minOffsetsPerTrigger", batch_rows)
            .option("maxTriggerDelay", f"{batch_seconds}s")
            .options(**(options or {}))
        )
        unique = F.concat_ws("-", "topic", "partition", "offset")
        return reader.load().select(
            F.col("key").cast("string"), F.col("value").cast("string"), unique.alias("message_key")
        )
    stream = reader.schema(FILE_SCHEMA).options(**(options or {})).load()
    unique = F.concat_ws("-", "_metadata.file_name", "_metadata.row_index")
    return stream.filter(F.col("topic") == TOPICS[kind]).select(
        "key", "value", unique.alias("message_key")
    )


def read_sentiment_topic(
    spark: SparkSession,
    format: str = "kafka",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Messages of the sentiment topic as rows: source, source_id, content, content_hash,
    timestamp. Values that are no JSON object give NULL content and hash."""
    return parse_messages(read_topic(spark, "raw_data", format, options))


def parse_messages(messages: DataFrame) -> DataFrame:
    parsed = with_once(messages, {"__value": payload.parse(F.col("value"))})

    def text(name: str) -> Column:
        return F.try_variant_get("__value", f"$.{name}", "string")

    content = F.to_json(F.try_variant_get("__value", "$.content", "variant"))
    seconds = F.try_variant_get("__value", "$.timestamp", "long")
    return parsed.select(
        "message_key",
        F.coalesce(text("source"), F.lit("unknown")).alias("source"),
        F.coalesce(text("source_id"), F.lit("")).alias("source_id"),
        content.alias("content"),
        text("content_hash").alias("content_hash"),
        F.timestamp_seconds(seconds).alias("timestamp"),
    )


def write_topic_files(messages: DataFrame, path: str) -> None:
    """Sink rows (see ``to_message_rows``) into the folder that stands for a topic."""
    messages.withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.mode(
        "append"
    ).parquet(path)


def write_topic_kafka(messages: DataFrame, servers: str) -> None:
    """Sink rows to Kafka, with full acknowledgement, snappy and an idempotent producer."""
    (
        messages.select("topic", "key", "value", "headers")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("includeHeaders", "true")
        .option("kafka.acks", "all")
        .option("kafka.compression.type", "snappy")
        .option("kafka.enable.idempotence", "true")
        .save()
    )
