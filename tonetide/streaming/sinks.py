"""Streaming sinks and triggers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonetide.operators.ordering import newest
from tonetide.schemas import WRITER_INTERVAL_SECONDS
from tonetide.session import fresh_path
from tonetide.sources import tables
from tonetide.sources.batches import BatchTable


def start(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    interval_seconds: int | None = WRITER_INTERVAL_SECONDS,
    mode: str = "append",
) -> StreamingQuery:
    """Run ``each_batch`` per micro-batch, every ``interval_seconds`` or, with None, over
    what is available now and then stop."""
    checkpoint = checkpoint or fresh_path(stream.sparkSession, "checkpoint")
    writer = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
    )
    if interval_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_seconds} seconds").start()


def results_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: each micro-batch replaces its own ``batch_id`` partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.write_results_batch(batch, path, batch_id)

    return write


def late_rows(query: StreamingQuery) -> int:
    """Rows a query's stateful steps refused because they came after the watermark.

    Counted over the progress reports the query still holds
    (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )


def latest_of(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key of a table that an update-mode stream has written."""
    return newest(stored, keys, [F.col("batch_id")])


def drain_latest(
    stream: DataFrame, name: str, keys: Sequence[str], checkpoint: str | None = None
) -> DataFrame:
    """Process all available input in update mode; the latest row of each key, open windows
    included."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = start(stream, results_writer(path), checkpoint, None, "update")
    query.awaitTermination()
    if not any(progress.numInputRows for progress in query.recentProgress):
        return spark.createDataFrame([], stream.schema)
    return latest_of(spark.read.parquet(path), keys).select(*stream.columns)


def drain_to_table(
    stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append"
) -> DataFrame:
    """Process all available input into a fresh table and return the table."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = start(stream, results_writer(path), checkpoint, None, mode)
    query.awaitTermination()
    if not any(progress.numInputRows for progress in query.recentProgress):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


DAY = "result_date"


def results_table(spark: SparkSession, path: str, layout: T.StructType) -> BatchTable:
    """Results by day and micro-batch."""
    return BatchTable(spark, path, T.StructType([*layout, T.StructField(DAY, T.DateType())]), DAY)


def daily_writer(table: BatchTable, time: str = "timestamp", fold_every: int = 64):
    """foreachBatch body: rows by day; the batches of a day are folded every so often."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.withColumn(DAY, F.to_date(time)), batch_id)
        if batch_id and batch_id % fold_every == 0:
            table.fold(batch_id)

    return write


def drain_by_day(stream: DataFrame, name: str, fold_every: int = 64) -> DataFrame:
    """Process all available input into a fresh table by day; returns its rows."""
    table = results_table(stream.sparkSession, fresh_path(stream.sparkSession, name), stream.schema)
    start(stream, daily_writer(table, fold_every=fold_every), None, None).awaitTermination()
    return table.read().drop(DAY)
