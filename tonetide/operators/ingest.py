"""Payload in: parse, tag, hash, store once, page, mark, publish."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetide.functions import payload
from tonetide.operators.ordering import oldest
from tonetide.operators.validate import reject_malformed
from tonetide.schemas import MESSAGE_ORIGIN, TOPICS


def ingest_payloads(
    lines: DataFrame, source: str | Column, received_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """JSON lines (``value``) of one source → (raw rows, rejects).

    ``source_id`` is taken from ``id`` only if that is a string, else ''. The
    timestamp is the arrival time. Other input columns are kept.
    """
    tag = F.lit(source) if isinstance(source, str) else source
    accepted, rejects = reject_malformed(lines)
    arrival = received_at if received_at is not None else F.current_timestamp()
    canonical = F.to_json("payload")
    carried = [c for c in lines.columns if c not in ("value", "source", "timestamp")]
    raw = accepted.select(
        *carried,
        tag.alias("source"),
        F.coalesce(payload.string_field(F.col("payload"), "id"), F.lit("")).alias("source_id"),
        canonical.alias("content"),
        F.coalesce(arrival, F.current_timestamp()).cast("timestamp_ntz").alias("timestamp"),
    ).withColumn("content_hash", F.sha2("content", 256))
    return raw, rejects.withColumn("source", tag)


def union_sources(*raws: DataFrame) -> DataFrame:
    """One raw table from the endpoints' tables; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), raws)


def content_hash(messages: DataFrame) -> DataFrame:
    """Fill ``content_hash``: a supplied non-empty hash is kept, else SHA-256 of the
    canonical JSON of ``content``."""
    supplied = (
        F.nullif(F.col("content_hash"), F.lit(""))
        if "content_hash" in messages.columns
        else F.lit(None).cast("string")
    )
    return messages.withColumn(
        "content_hash", F.coalesce(supplied, payload.sha256_of_json(F.col("content")))
    )


def drop_missing_hash(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with a hash, and the rest as rejects of type 'missing_hash'."""
    has_hash = F.coalesce(F.col("content_hash") != "", F.lit(False))
    rejects = messages.filter(~has_hash).withColumn("error_type", F.lit("missing_hash"))
    return messages.filter(has_hash), rejects


def append_new_raw(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` to append: unseen hashes only, one row per hash.

    A missing hash is filled from the content first; rows that have neither are left out
    (``drop_missing_hash`` names them). Equal hashes inside the batch are folded
    (earliest timestamp, then source_id), so a hash that fills a third of the batch
    shrinks before the shuffle; the anti join then reuses the partitioning by hash.
    """
    order = [F.col(c) for c in ("timestamp", "source_id", "id") if c in batch.columns]
    hashed = content_hash(batch) if "content" in batch.columns else batch
    fresh = oldest(drop_missing_hash(hashed)[0], ["content_hash"], order)
    return fresh.join(existing.select("content_hash"), "content_hash", "left_anti").select(
        *batch.columns
    )


def first_by_hash(raw: DataFrame) -> DataFrame:
    """The first record of each hash."""
    return oldest(raw, ["content_hash"], [F.col("timestamp"), F.col("id")])


def unprocessed_page(raw: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows not yet processed, oldest first; ``id`` breaks ties."""
    return (
        raw.filter(F.col("processed_at").isNull())
        .orderBy("created_at", "id")
        .offset(offset)
        .limit(limit)
    )


def unprocessed_after(
    raw: DataFrame, limit: int, after: tuple[dt.datetime | None, int] | None = None
) -> DataFrame:
    """The next page behind a token (created_at, id), the last row of the page before it.

    Each page is a filter and a top ``limit``, whatever its number: no earlier page is read or
    sorted. Rows without ``created_at`` come first, as in ``unprocessed_page``.
    """
    waiting = raw.filter(F.col("processed_at").isNull())
    if after is not None:
        time, number = after
        if time is None:
            behind = F.col("created_at").isNotNull() | (F.col("id") > number)
        else:
            moment = F.lit(time).cast(raw.schema["created_at"].dataType)
            same = (F.col("created_at") == moment) & (F.col("id") > number)
            behind = (F.col("created_at") > moment) | same
        waiting = waiting.filter(behind)
    return waiting.orderBy("created_at", "id").limit(limit)


def page_token(page: DataFrame) -> tuple[dt.datetime | None, int] | None:
    """The token of a page; None for an empty one."""
    last = page.orderBy(F.desc("created_at"), F.desc("id")).select("created_at", "id").first()
    return (last["created_at"], last["id"]) if last else None


def lookup_by_hash(raw: DataFrame, hashes: DataFrame) -> DataFrame:
    """Raw rows whose hash occurs in ``hashes``; unknown and empty hashes find nothing."""
    return raw.join(hashes.select("content_hash"), "content_hash", "left_semi").select(
        *raw.columns
    )


def mark_processed(
    raw: DataFrame, finished: DataFrame, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """(raw with ``processed_at`` set for finished ids, finished ids that do not exist)."""
    ids = finished.select("id").distinct()
    now = F.lit(as_of).cast("timestamp_ntz")
    marked = (
        raw.join(ids.withColumn("__done", F.lit(True)), "id", "left")
        .withColumn(
            "processed_at", F.when(F.col("__done"), now).otherwise(F.col("processed_at"))
        )
        .select(*raw.columns)
    )
    return marked, ids.join(raw.select("id"), "id", "left_anti")


def to_message_rows(
    rows: DataFrame,
    kind: str = "raw_data",
    published_at: Column | None = None,
    duplicates: DataFrame | None = None,
) -> DataFrame:
    """Sink rows (topic, key, value, headers, timestamp) for a message kind.

    ``rows`` are the newly stored raw rows; pass ``duplicates`` to publish
    repeated payloads as well. Raw-data messages are keyed by content hash, the
    other kinds have no key. The frame fits the Kafka sink as it is.
    """
    if duplicates is not None:
        rows = rows.unionByName(duplicates, allowMissingColumns=True)
    if kind == "raw_data":
        value = F.to_json(
            F.struct(
                "source",
                "source_id",
                payload.parse(F.col("content")).alias("content"),
                "content_hash",
                F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("timestamp"),
            )
        )
        key = F.nullif(F.col("content_hash"), F.lit(""))
    else:
        value = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
        key = F.lit(None).cast("string")
    headers = F.array(
        F.struct(F.lit("source").alias("key"), F.lit(MESSAGE_ORIGIN).cast("binary").alias("value")),
        F.struct(F.lit("message_type").alias("key"), F.lit(kind).cast("binary").alias("value")),
    )
    sent = published_at if published_at is not None else F.current_timestamp()
    return rows.select(
        F.lit(TOPICS[kind]).alias("topic"),
        key.alias("key"),
        value.alias("value"),
        headers.alias("headers"),
        sent.alias("timestamp"),
    )
