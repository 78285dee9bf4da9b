"""Summary views stored by day and refreshed from results that are stored by day.

A refresh takes the list of days that changed rows fall into. Only those day partitions of the
results are read and only those of the view are overwritten, however far the days lie apart. A
refresh that dies is repeated with the same changed rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.operators.summaries import SUMMARY_VIEWS
from tonetide.sources.files import remove, stored
from tonetide.sources.tables import write_partitioned

DAY = "day_of"


def with_day_of(rows: DataFrame, time: str = "timestamp") -> DataFrame:
    """Add the partition column of results and views; rows without a time share one partition."""
    return rows.withColumn(DAY, F.to_date(time))


def touched_days(changed: DataFrame, time: str = "timestamp") -> list[dt.date | None]:
    """The distinct days of some rows."""
    return [r[0] for r in changed.select(F.to_date(time)).distinct().collect()]


def in_days(days: Sequence[dt.date | None]) -> Column:
    """Rows of some day partitions; partition pruning applies."""
    dated = F.col(DAY).isin([d for d in days if d is not None])
    return dated | F.col(DAY).isNull() if None in days else dated


class SummaryTable:
    """One of ``SUMMARY_VIEWS`` at ``path``. ``results`` opens the results, partitioned by ``DAY``."""

    def __init__(self, spark: SparkSession, path: str, view: str, results: Callable[[], DataFrame]):
        self.spark, self.path, self.results = spark, path.rstrip("/"), results
        self.summarise, self.unit = SUMMARY_VIEWS[view]

    def _summary(self, days: Sequence[dt.date | None]) -> DataFrame:
        rows = self.results().where(in_days(days)).drop(DAY)
        return with_day_of(self.summarise(rows), self.unit)

    def refresh(self, changed: DataFrame) -> list[dt.date | None]:
        """Recompute the days of ``changed`` (rows added, altered or removed); returns them."""
        return self.refresh_days(touched_days(changed))

    def refresh_days(self, days: Sequence[dt.date | None]) -> list[dt.date | None]:
        if not days:
            return []
        there = {r[0] for r in self.results().where(in_days(days)).select(DAY).distinct().collect()}
        fresh = self._summary(list(there))
        if there:
            write_partitioned(fresh.hint("rebalance", F.col(DAY)), self.path, [DAY], "overwrite")
        emptied = [d for d in days if d not in there]
        remove(self.spark, [f"{self.path}/{DAY}={d or '__HIVE_DEFAULT_PARTITION__'}" for d in emptied])
        return list(days)

    def read(self) -> DataFrame:
        """The view, without its partition column."""
        layout = self._summary([]).schema
        rows = stored(self.spark, self.path, layout)
        rows = self.spark.createDataFrame([], layout) if rows is None else rows
        return rows.drop(DAY)
