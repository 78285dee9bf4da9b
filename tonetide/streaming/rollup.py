"""Live tables that stay whole when rows come late or out of order.

Spark's stateful operators refuse rows behind the watermark. Here each micro-batch is reduced to
partial rows that merge with those of any other batch, so a late row corrects its window whenever
it comes, and no state grows in the stream. What the watermark would do is still tracked: the
border of a batch is the newest time of the batches before it less ``late``; rows of windows that
end at or before it are late, kept as they came in a side table, and counted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonetide.sources.batches import BATCH, BatchTable
from tonetide.sources.files import stored
from tonetide.streaming import sinks

PART = "part"
BORDERS = f"high timestamp, border timestamp, rows long, late long, {BATCH} long"


@dataclass(frozen=True)
class RollUp:
    """Partial rows of a table of events, and how they come together.

    ``partial`` reduces rows to partial rows, ``merge`` brings partial rows together and
    ``finish`` makes the result. ``window`` is the start of a row's window, ``width`` its length
    (None: rows have no window and are never late; "0 seconds": each row is its own). ``part`` is the partition of a partial row.
    """

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    part: Column
    window: Column | None = None
    width: str = "1 hour"
    keys: tuple[str, ...] = ()


def windowed(
    keys: Mapping[str, Column],
    measures: Mapping[str, tuple[Column, Callable]],
    finish: Callable[[DataFrame], DataFrame],
    width: str = "1 hour",
) -> RollUp:
    """A roll-up by ``keys``, the first of which is the window's start.

    ``measures``: name -> (aggregate over rows, aggregate that merges its values).
    """
    first = next(iter(keys))

    def partial(rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(*[c.alias(n) for n, c in keys.items()])
        return grouped.agg(*[c.alias(n) for n, (c, _) in measures.items()])

    def merge(rows: DataFrame) -> DataFrame:
        again = [f(n).cast(rows.schema[n].dataType).alias(n) for n, (_, f) in measures.items()]
        return rows.groupBy(PART, *keys).agg(*again).select(*rows.columns)

    return RollUp(
        partial, merge, finish, F.to_date(first), keys[first], width, tuple(keys)
    )


class LiveTable:
    """A roll-up of a stream of rows with ``timestamp``, stored at ``path``.

    ``fold_every``: after so many micro-batches the partial rows stored before are merged.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        rollup: RollUp,
        layout: T.StructType,
        late: str = "1 hour",
        fold_every: int = 32,
    ):
        self.spark, self.path, self.rollup, self.late = spark, path, rollup, late
        self.fold_every = fold_every
        self._seen: tuple[int, object] | None = None  # the last batch written here, newest time
        shape = self._partial(spark.createDataFrame([], layout)).schema
        self.partials = BatchTable(spark, f"{path}/partials", shape, PART, rollup.merge)
        self.side = BatchTable(
            spark, f"{path}/late", T.StructType([*layout, T.StructField(PART, T.DateType())]), PART
        )

    def _partial(self, rows: DataFrame) -> DataFrame:
        return self.rollup.partial(rows).withColumn(PART, self.rollup.part)

    # ---- writing ------------------------------------------------------------------------------

    def border(self, batch_id: int) -> Column:
        """What the batches before this one have seen, less the allowed delay."""
        return self._less(self._high(batch_id))

    def _high(self, batch_id: int):
        """The newest time of the batches before this one."""
        if self._seen and self._seen[0] == batch_id - 1:
            return self._seen[1]
        borders = self._borders()
        if borders is None:
            return None
        return borders.where(F.col(BATCH) < batch_id).agg(F.max("high")).first()[0]

    def _less(self, high) -> Column:
        return F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {self.late}")

    def _borders(self) -> DataFrame | None:
        return stored(self.spark, f"{self.path}/borders", T.StructType.fromDDL(BORDERS))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch body. All parts of a batch replace themselves when it is replayed; the
        border's row comes last."""
        self.partials.write(self._partial(batch), batch_id)
        before = self._high(batch_id)
        border = self._less(before)
        is_late = self._is_late(border)
        seen = batch.agg(
            F.max("timestamp").cast("timestamp").alias("high"),
            border.alias("border"),
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(is_late, 1)).alias("late"),
            F.lit(batch_id).cast("long").alias(BATCH),
        )
        row = seen.collect()  # one row
        if row[0]["late"]:
            self.side.write(
                batch.where(is_late).withColumn(PART, F.to_date(self.rollup.window)), batch_id
            )
        line = self.spark.createDataFrame(row, seen.schema).drop(BATCH).coalesce(1)
        line.write.mode("overwrite").parquet(f"{self.path}/borders/{BATCH}={batch_id}")
        newest = [t for t in (before, row[0]["high"]) if t is not None]
        self._seen = (batch_id, max(newest, default=None))
        if batch_id and batch_id % self.fold_every == 0:
            self.partials.fold(batch_id, self.fold_every // 2)

    def _is_late(self, border: Column) -> Column:
        if self.rollup.window is None:
            return F.lit(False)
        end = self.rollup.window.cast("timestamp") + F.expr(f"INTERVAL {self.rollup.width}")
        return F.coalesce(end <= border, F.lit(False))

    def start(
        self, stream: DataFrame, checkpoint: str | None = None, interval_seconds: int | None = 30
    ) -> StreamingQuery:
        """Keep the table up to date; ``interval_seconds=None`` drains what is available."""
        return sinks.start(stream, self.write, checkpoint, interval_seconds)

    # ---- reading ------------------------------------------------------------------------------

    def current(self) -> DataFrame:
        """The result over all rows so far, late ones included."""
        return self.rollup.finish(self.partials.read())

    def late_rows(self) -> DataFrame:
        """Rows that came after their window was taken to be closed."""
        return self.side.read().drop(PART)

    def corrected(self, batch_id: int) -> DataFrame:
        """Merged partial rows of the windows that late rows of one batch have changed."""
        late = self.side.of_batch(batch_id)
        touched = self.rollup.partial(late.drop(PART)).select(
            *[F.col(k).alias(f"__{k}") for k in self.rollup.keys]
        )
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.rollup.keys]
        return self.partials.read().join(touched, same, "left_semi")

    def counts(self) -> DataFrame:
        """Per micro-batch: rows, late rows, border."""
        borders = self._borders()
        empty = self.spark.createDataFrame([], BORDERS)
        return (empty if borders is None else borders).select(BATCH, "rows", "late", "border")


def drain(stream: DataFrame, path: str, rollup: RollUp, **options) -> LiveTable:
    """Process all available input."""
    table = LiveTable(stream.sparkSession, path, rollup, stream.schema, **options)
    table.start(stream, interval_seconds=None).awaitTermination()
    return table
