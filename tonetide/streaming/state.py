"""Keyed state: sliding time-to-live deduplication and hour-to-hour comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tonetide.schemas import SEEN_TTL_SECONDS


class FirstSeen(StatefulProcessor):
    """Lets a message pass when its hash was not seen within ``ttl_seconds`` before it.

    State maps each hash of a hash bucket to its latest time. Every occurrence
    renews the entry; a timer per bucket sweeps entries the watermark has outlived.
    """

    def __init__(self, ttl_seconds: int, columns: list[str]):
        self.ttl = pd.Timedelta(seconds=ttl_seconds)
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last_seen", "content_hash string", "seen timestamp")
        self.sweep = handle.getValueState("next_sweep", "at_millis long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # one bucket of one micro-batch, whose size the source's rate option bounds
        batch = pd.concat(list(rows)).sort_values(
            ["content_hash", "timestamp", "source_id"], kind="stable", ignore_index=True
        )
        before = batch.groupby("content_hash")["timestamp"].shift(1)
        latest = batch.groupby("content_hash")["timestamp"].max()
        for at in batch.index[~batch["content_hash"].duplicated()]:
            content_hash = batch.at[at, "content_hash"]
            stored = self.last.getValue((content_hash,))
            newest = latest[content_hash]
            if stored is not None:
                before.at[at] = pd.Timestamp(stored[0])
                newest = max(newest, before.at[at])
            self.last.updateValue((content_hash,), (newest.to_pydatetime(),))
        if not self.sweep.exists():
            self._sweep_at(latest.max())
        yield batch[before.isna() | (batch["timestamp"] - before >= self.ttl)][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        expired, newest = [], None  # of a bucket's entries only the keys that go are held
        for hash_key, entry in self.last.iterator():
            seen = pd.Timestamp(entry[0])
            if seen + self.ttl <= now:
                expired.append(hash_key)
            elif newest is None or seen > newest:
                newest = seen
        for hash_key in expired:
            self.last.removeKey(hash_key)
        self.sweep.clear()
        if newest is not None:
            self._sweep_at(newest)
        yield pd.DataFrame()

    def _sweep_at(self, newest: pd.Timestamp) -> None:
        due = int((newest + self.ttl).timestamp() * 1000) + 1
        self.handle.registerTimer(due)
        self.sweep.update((due,))

    def close(self) -> None:
        pass


def stream_dedup_ttl(
    messages: DataFrame,
    ttl_seconds: int = SEEN_TTL_SECONDS,
    late: str = "1 hour",
    buckets: int = 1024,
) -> DataFrame:
    """Sliding-TTL deduplication of a stream by ``content_hash`` in event time.

    ``messages`` needs ``timestamp`` and ``source_id``. A micro-batch looks up
    its own hashes in RocksDB, once each. State is grouped by hash bucket because
    a Python call per hash would cost more than the lookup. Decides at once and refuses
    messages behind the watermark; ``seen.first_seen`` keeps a whole table instead.
    """
    processor = FirstSeen(ttl_seconds, messages.columns)
    keyed = messages.withWatermark("timestamp", late).withColumn(
        "__bucket", F.pmod(F.xxhash64("content_hash"), F.lit(buckets))
    )
    return keyed.groupBy("__bucket").transformWithStateInPandas(
        processor, messages.schema, "Append", "EventTime"
    )


def stream_dedup_sessions(
    messages: DataFrame, ttl_seconds: int = SEEN_TTL_SECONDS, late: str = "1 hour"
) -> DataFrame:
    """The same rule as session windows, entirely in the JVM, for streams that can wait.

    Messages of a hash whose gaps stay below the TTL form one session and its
    earliest message passes, once the session is closed (TTL plus ``late`` after
    its last message). Tolerates out-of-order input; sessions combine map-side.
    """
    row = F.struct(*[F.col(c) for c in messages.columns])
    order = F.struct("timestamp", "source_id")
    sessions = messages.withWatermark("timestamp", late).groupBy(
        "content_hash", F.session_window("timestamp", f"{ttl_seconds} seconds")
    )
    return sessions.agg(F.min_by(row, order).alias("row")).select("row.*")


def stream_dedup_within(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Fixed-delay form, entirely in the JVM: repeats within ``delay`` of the first are dropped."""
    return messages.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        ["content_hash"]
    )


class HourShift(StatefulProcessor):
    """Compares each closed hour's mean with the hour before, per source."""

    def __init__(self, delta: float):
        self.delta = delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_hour", "hour timestamp, mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # one row per closed hour of one source
        hours = pd.concat(list(rows)).sort_values("hour")
        previous_hour, previous_mean = self.last.get() or (None, None)
        found = []
        for row in hours.itertuples():
            if previous_hour is not None:
                follows = row.hour - pd.Timestamp(previous_hour) == pd.Timedelta(hours=1)
                change = row.avg_score - previous_mean
                if follows and abs(change) > self.delta:
                    found.append((key[0], row.hour, row.avg_score, previous_mean, change))
            previous_hour, previous_mean = row.hour, row.avg_score
        self.last.update((previous_hour.to_pydatetime(), float(previous_mean)))
        yield pd.DataFrame(
            found, columns=["source_type", "hour", "avg_score", "previous_score", "change"]
        ).astype({"hour": "datetime64[us]"})

    def close(self) -> None:
        pass


SHIFT_SCHEMA = (
    "source_type string, hour timestamp, avg_score double, previous_score double, change double"
)


def compare_hours(means: DataFrame, delta: float) -> DataFrame:
    """``means``: source_type, hour, avg_score of closed hours, at most one row each."""
    slim = means.select("source_type", F.col("hour").cast("timestamp").alias("hour"), "avg_score")
    return slim.groupBy("source_type").transformWithStateInPandas(
        HourShift(delta), SHIFT_SCHEMA, "Append", "None"
    )
