"""Retention: what survives at a given time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetide.schemas import LOG_RETENTION_DAYS, RAW_RETENTION_DAYS


def _at(moment: dt.datetime):
    return F.lit(moment).cast("timestamp_ntz")


def purge_raw(raw: DataFrame, as_of: dt.datetime, days: int = RAW_RETENTION_DAYS) -> DataFrame:
    """Raw rows created within the last ``days`` days."""
    return raw.filter(F.col("created_at") >= _at(as_of - dt.timedelta(days=days)))


def purge_processed(raw: DataFrame, as_of: dt.datetime, older_than: dt.timedelta) -> DataFrame:
    """Drop processed rows older than a duration; unprocessed rows always survive."""
    cutoff = _at(as_of - older_than)
    return raw.filter(F.col("processed_at").isNull() | (F.col("processed_at") >= cutoff))


def purge_logs(
    logs: DataFrame, metrics: DataFrame, as_of: dt.datetime, days: int = LOG_RETENTION_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(log rows of days not older than the cutoff day, metrics not older than the cutoff)."""
    cutoff = as_of - dt.timedelta(days=days)
    first_day = F.lit(cutoff.date())
    day = F.col("log_date") if "log_date" in logs.columns else F.to_date("timestamp")
    return (
        logs.filter(day >= first_day),
        metrics.filter(F.col("timestamp") >= _at(cutoff)),
    )


def expire_state(state: DataFrame, as_of: dt.datetime) -> DataFrame:
    """State entries that are still alive."""
    return state.filter(F.col("expires_at") > _at(as_of))
