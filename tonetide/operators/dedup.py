"""Exact-content deduplication against batches, live state and stored results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetide.operators.ordering import newest, previous_value
from tonetide.schemas import SEEN_TTL_SECONDS


def _instant(value: dt.datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def _plus_seconds(column: Column, seconds: int) -> Column:
    return column + F.expr(f"INTERVAL {int(seconds)} SECONDS")


def flag_recent_duplicates(
    messages: DataFrame, seen: DataFrame, ttl_seconds: int = SEEN_TTL_SECONDS
) -> DataFrame:
    """Add ``is_duplicate`` under a sliding time-to-live per content hash.

    ``messages``: id, content_hash, timestamp, …; ``seen``: content_hash,
    expires_at. A hash stays known for ``ttl_seconds`` after its latest
    occurrence, duplicate or not, so a row is a duplicate when the occurrence
    before it is less than the TTL away, or, for the first one, when the stored
    entry is still live. Hot hashes are split by hour (see ``ordering``).
    """
    ordered = previous_value(
        messages,
        ["content_hash"],
        "timestamp",
        ["id"],
        F.date_trunc("hour", "timestamp"),
        "__previous",
    )
    known = seen.groupBy(F.col("content_hash").alias("__hash")).agg(
        F.max("expires_at").alias("__expires")
    )
    # only the first row of a hash asks the state; the others are spread by id
    first = F.col("__previous").isNull()
    ordered = ordered.withColumn(
        "__key", F.when(first, F.col("content_hash")).otherwise(F.col("id").cast("string"))
    ).withColumn("__first", first)
    known = known.withColumn("__known", F.lit(True))
    joined = ordered.join(
        known,
        (ordered["__key"] == known["__hash"]) & (ordered["__first"] == known["__known"]),
        "left",
    )
    by_gap = F.col("timestamp") < _plus_seconds(F.col("__previous"), ttl_seconds)
    by_state = F.col("__expires") > F.col("timestamp")
    return joined.withColumn(
        "is_duplicate",
        F.when(F.col("__previous").isNotNull(), by_gap).otherwise(
            F.coalesce(by_state, F.lit(False))
        ),
    ).drop("__previous", "__hash", "__expires", "__key", "__first", "__known")


def seen_sessions(messages: DataFrame, ttl_seconds: int, tie: str = "id") -> DataFrame:
    """Runs of equal hashes whose gaps stay below the time-to-live: (content_hash, start, end, row).

    ``row`` is the earliest message of the run, the one that is no duplicate. Messages of one
    hash within the same slot of TTL length belong together whatever their order, so slots are
    combined before the shuffle and a hash that fills an hour is no burden to one task.
    """
    if ttl_seconds <= 0:
        raise ValueError("the time-to-live must be positive")
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    slot = (micros - F.pmod(micros, F.lit(ttl_seconds * 1_000_000))).alias("__slot")
    row = F.struct(*[F.col(f"`{c}`") for c in messages.columns])
    slots = messages.groupBy("content_hash", slot).agg(
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.min_by(row, F.struct("timestamp", tie)).alias("row"),
    )
    return joined_sessions(slots.drop("__slot"), ttl_seconds, tie)


def joined_sessions(sessions: DataFrame, ttl_seconds: int, tie: str = "id") -> DataFrame:
    """Sessions of any number of batches as whole ones, in whatever order they were found."""
    order = Window.partitionBy("content_hash").orderBy("start", "end", f"row.{tie}")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("end").over(before)
    starts = latest.isNull() | (F.col("start") >= _plus_seconds(latest, ttl_seconds))
    numbered = sessions.withColumn("__new", F.when(starts, 1).otherwise(0)).withColumn(
        "__number", F.sum("__new").over(order)
    )
    return (
        numbered.groupBy("content_hash", "__number")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min_by("row", F.struct("row.timestamp", f"row.{tie}")).alias("row"),
        )
        .drop("__number")
    )


def skip_recent_duplicates(
    messages: DataFrame, seen: DataFrame, ttl_seconds: int = SEEN_TTL_SECONDS
) -> DataFrame:
    """Messages that are not duplicates under the sliding time-to-live."""
    if ttl_seconds <= 0:
        flagged = flag_recent_duplicates(messages, seen, ttl_seconds)
        return flagged.filter(~F.col("is_duplicate")).drop("is_duplicate")
    sessions = seen_sessions(messages, ttl_seconds)
    known = seen.groupBy("content_hash").agg(F.max("expires_at").alias("__expires"))
    first = F.min("start").over(Window.partitionBy("content_hash"))
    # only the first session of a hash asks the state; an unknown time compares as null
    asked = sessions.withColumn("__first", F.col("start").eqNullSafe(first) | F.col("start").isNull())
    return (
        asked.join(known, "content_hash", "left")
        .filter(~F.coalesce(F.col("__first") & (F.col("__expires") > F.col("start")), F.lit(False)))
        .select("row.*")
    )


def renew_seen(
    seen: DataFrame, messages: DataFrame, ttl_seconds: int = SEEN_TTL_SECONDS
) -> DataFrame:
    """State after a batch: each hash expires ``ttl_seconds`` after its latest occurrence."""
    renewed = messages.groupBy("content_hash").agg(
        _plus_seconds(F.max("timestamp"), ttl_seconds).alias("expires_at")
    )
    untouched = seen.join(renewed, "content_hash", "left_anti")
    return untouched.select("content_hash", "expires_at").unionByName(renewed)


def skip_already_scored(
    messages: DataFrame, results: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(messages whose hash has no result yet, hashes to mark seen as 'existing')."""
    scored = results.select("content_hash")
    fresh = messages.join(scored, "content_hash", "left_anti").select(*messages.columns)
    existing = (
        messages.select("content_hash")
        .distinct()
        .join(scored, "content_hash", "left_semi")
        .withColumn("status", F.lit("existing"))
    )
    return fresh, existing


def hydrate_cached_scores(
    duplicates: DataFrame, cache: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Attach the newest live cached score to repeated messages (NULL without one).

    ``cache``: content_hash, sentiment, score, confidence, cached_at, expires_at.
    """
    live = cache.filter(F.col("expires_at") > _instant(as_of))
    latest = newest(
        live, ["content_hash"], [F.col("cached_at"), F.col("score"), F.col("sentiment")]
    ).select("content_hash", "sentiment", "score", "confidence", "cached_at")
    return duplicates.join(latest, "content_hash", "left")


def latest_by_hash(results: DataFrame) -> DataFrame:
    """The newest record of each hash; the smallest ``id`` among equal times."""
    return newest(results, ["content_hash"], [F.col("processed_at"), -F.col("id")])


def dedup_exact_text(documents: DataFrame, text: str = "text") -> DataFrame:
    """Distinct contents by hash: first id and number of copies."""
    hashed = documents.select("doc_id", F.sha2(text, 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
    )


def reconcile_pipeline(raw: DataFrame, results: DataFrame) -> DataFrame:
    """Per hash: 'processed', 'pending' (no result) or 'orphan' (result without raw row),
    with the delay from the first raw row to the first result in seconds."""
    stored = raw.groupBy("content_hash").agg(
        F.min("timestamp").alias("stored_at"), F.count(F.lit(1)).alias("raw_rows")
    )
    scored = results.groupBy("content_hash").agg(F.min("processed_at").alias("scored_at"))
    status = (
        F.when(F.col("stored_at").isNull(), "orphan")
        .when(F.col("scored_at").isNull(), "pending")
        .otherwise("processed")
    )
    delay = (
        F.unix_micros(F.col("scored_at").cast("timestamp"))
        - F.unix_micros(F.col("stored_at").cast("timestamp"))
    ) / F.lit(1_000_000.0)
    return stored.join(scored, "content_hash", "full_outer").select(
        "content_hash",
        status.alias("status"),
        F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"),
        delay.alias("delay_seconds"),
    )


def reconcile_delays(reconciled: DataFrame) -> DataFrame:
    """Row count and delay spread per status (bounded-memory quantile sketch)."""
    return reconciled.groupBy("status").agg(
        F.count(F.lit(1)).alias("hashes"),
        F.percentile_approx("delay_seconds", 0.5, 10_000).alias("p50_delay_seconds"),
        F.percentile_approx("delay_seconds", 0.95, 10_000).alias("p95_delay_seconds"),
        F.max("delay_seconds").alias("max_delay_seconds"),
    )
