"""Topic → text → dedup → score → entities → one outcome table, as a single streaming query.

The source is read once: each message becomes one tagged row. A micro-batch folds equal hashes,
drops those whose result is stored already by an anti-join with the table of scored hashes, of
which only the hash buckets met are read, and scores the rest. Nothing is kept as state of the
stream; both tables are written by batch and folded, so a replay or a restart repeats nothing.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonetide.functions import payload
from tonetide.functions.stage import with_once
from tonetide.operators.gazetteer import ENTITIES
from tonetide.operators.responses import FINANCIAL_DEFAULTS
from tonetide.operators.scoring import RESULT_FIELDS, Scorer, score_sentiment
from tonetide.operators.texts import text_of
from tonetide.session import fresh_path
from tonetide.sources.batches import BatchTable
from tonetide.streaming import sinks

ROW_FIELDS = ["kind", "source", "source_id", "content_hash", "timestamp", "text", "error_type"]
FINANCIAL = f"struct<{','.join(f'{n}:string' for n in FINANCIAL_DEFAULTS)},financial_entities:array<string>>"
#: What stages may add to a scored row, and what it is without them.
ADDED = {"entities": ENTITIES, "financial_sentiment": FINANCIAL}
STAMPS = ["processed_at", "processing_time_ms"]
OUTCOME_COLUMNS = [*ROW_FIELDS, *[f.name for f in RESULT_FIELDS], *ADDED, *STAMPS]
BUCKETS = 32
DAY = "outcome_date"

Stage = Callable[[DataFrame], DataFrame]


def tagged(messages: DataFrame) -> DataFrame:
    """One row per message: a result to be, or a reject with its reason.

    Rejects keep a key of their own: messages without hash or text are never remembered, each one
    is an error of its own.
    """
    parsed = with_once(messages, {"__payload": payload.parse(F.col("content"))})
    with_text = with_once(
        parsed, {"text": text_of(F.col("source"), F.col("content"), F.col("__payload"))}
    ).drop("__payload")
    has_hash = F.coalesce(F.col("content_hash") != "", F.lit(False))
    error = F.when(~has_hash, "missing_hash").when(F.col("text").isNull(), "no_text")
    kind = F.when(error.isNull(), "result").otherwise("reject")
    key = F.when(error.isNull(), F.col("content_hash")).otherwise(F.col("message_key"))
    fields = {"kind": kind, "error_type": error}
    row = F.struct(*[fields.get(c, F.col(c)).alias(c) for c in ROW_FIELDS])
    return with_text.select(F.concat_ws(":", kind, key).alias("outcome_key"), row.alias("row"))


def fold_candidates(candidates: DataFrame) -> DataFrame:
    """One row per reject and per hash: the earliest message (timestamp, then source_id)."""
    order = F.struct("row.timestamp", "row.source_id")
    return (
        candidates.groupBy("outcome_key").agg(F.min_by("row", order).alias("row")).select("row.*")
    )


class Outcomes:
    """The outcome table and the scored hashes at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        text = {c: T.StringType() for c in ROW_FIELDS} | {"timestamp": T.TimestampType()}
        ddl = [T.StructField(n, T._parse_datatype_string(kind)) for n, kind in ADDED.items()]
        self.schema = T.StructType(
            [
                *(T.StructField(c, kind) for c, kind in text.items()),
                *RESULT_FIELDS,
                *ddl,
                T.StructField("processed_at", T.TimestampType()),
                T.StructField("processing_time_ms", T.LongType()),
            ]
        )
        by_day = T.StructType([*self.schema, T.StructField(DAY, T.DateType())])
        hashes = T.StructType.fromDDL("content_hash string, bucket int")
        self.spark = spark
        self.rows = BatchTable(spark, f"{path}/outcomes", by_day, DAY)
        self.scored = BatchTable(spark, f"{path}/scored", hashes, "bucket", lambda df: df.distinct())

    def read(self) -> DataFrame:
        return self.rows.read().drop(DAY)

    def remember(self, hashes: DataFrame, batch_id: int) -> None:
        self.scored.write(hashes.select("content_hash", _bucket().alias("bucket")), batch_id)

    def unscored(self, folded: DataFrame, batch_id: int) -> DataFrame:
        """Rows without results of hashes that batches before this one have scored."""
        met = folded.where("kind = 'result'").select(_bucket().alias("bucket")).distinct()
        buckets = [r.bucket for r in met.collect()]  # at most BUCKETS
        known = self.scored.read(batch_id).where(F.col("bucket").isin(buckets))
        is_result = folded["kind"] == "result"
        known = known.select(F.col("content_hash").alias("__known"))
        return folded.join(known, is_result & (folded["content_hash"] == F.col("__known")), "left_anti")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("content_hash"), F.lit(BUCKETS)).cast("int")


def outcomes_of(
    folded: DataFrame, scorer: Scorer | None = None, stages: tuple[Stage, ...] = ()
) -> DataFrame:
    """Folded rows with scores and what ``stages`` add. Only rows to score reach the models."""
    results = score_sentiment(folded.filter("kind = 'result'"), scorer)
    for stage in stages:
        results = stage(results)
    missing = {
        c: (F.array() if c == "entities" else F.lit(None)).cast(kind)
        for c, kind in ADDED.items()
        if c not in results.columns
    }
    results = results.withColumns(missing) if missing else results
    rejects = folded.filter("kind = 'reject'")
    wanted = [c for c in OUTCOME_COLUMNS if c not in STAMPS]
    return results.select(*wanted).unionByName(rejects, allowMissingColumns=True).select(*wanted)


def stream_pipeline(
    messages: DataFrame,
    path: str,
    scorer: Scorer | None = None,
    already_scored: DataFrame | None = None,
    checkpoint: str | None = None,
    interval_seconds: int | None = 10,
    stages: tuple[Stage, ...] = (),
    fold_every: int = 64,
) -> StreamingQuery:
    """Score a message stream into the outcome table at ``path`` (see ``Outcomes``).

    ``stages`` map scored rows to rows with ``entities`` or ``financial_sentiment``.
    ``already_scored`` (content_hash) starts a new stream over an existing results table.
    ``processing_time_ms`` is a batch's time up to its stored scores, shared out evenly over
    its results. ``interval_seconds=None`` drains what is available.
    """
    spark = messages.sparkSession
    table = Outcomes(spark, path)
    if already_scored is not None:
        table.remember(already_scored.select("content_hash").distinct(), -1)

    def write(batch: DataFrame, batch_id: int) -> None:
        began = time.monotonic()
        folded = fold_candidates(batch).persist()
        try:
            fresh = table.unscored(folded, batch_id)
            outcomes = outcomes_of(fresh, scorer, stages).persist()
            try:
                results = outcomes.where("kind = 'result'")
                n = results.count()
                table.remember(results, batch_id)
                elapsed = int(1000 * (time.monotonic() - began))
                now = F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")
                each = F.when(F.col("kind") == "result", F.lit(-(-elapsed // max(n, 1))))
                stamped = outcomes.withColumns(
                    {
                        "processed_at": now,
                        "processing_time_ms": each.cast("long"),
                        DAY: F.to_date("timestamp"),
                    }
                )
                table.rows.write(stamped, batch_id)
            finally:
                outcomes.unpersist()
        finally:
            folded.unpersist()
        if batch_id and batch_id % fold_every == 0:
            table.scored.fold(batch_id, 8)
            table.rows.fold(batch_id, 8)

    return sinks.start(tagged(messages), write, checkpoint, interval_seconds)


def drain_pipeline(
    messages: DataFrame, scorer: Scorer | None = None, path: str | None = None, **options
) -> DataFrame:
    """Run the pipeline over what is available and return the outcome table."""
    spark = messages.sparkSession
    path = path or fresh_path(spark, "outcomes")
    stream_pipeline(messages, path, scorer, interval_seconds=None, **options).awaitTermination()
    return Outcomes(spark, path).read()


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """Stored outcomes as input of ``pipeline_counters``."""
    is_result = F.col("kind") == "result"
    return outcomes.select(
        "source",
        F.when(is_result, "processed").otherwise("error").alias("outcome"),
        "error_type",
        F.when(is_result, "insert_batch").alias("operation"),
        F.when(is_result, "success").alias("write_status"),
    )
