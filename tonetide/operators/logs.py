"""Log lines to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetide.functions.stage import with_once
from tonetide.schemas import ACCESS_ENTRY, LOG_LEVELS

# --- fixed values: line formats ----------------------------------------------
APP_LINE = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (.+?) - ([A-Z]+) - (.*)$"
ACCESS_LINE = r"^(\S+) \[([A-Z]+)\] (\S+) (\S+) (\d{3}) (\S+)(?: (\S+))?\s*$"
DURATION_UNITS_MS = {"h": 3_600_000.0, "m": 60_000.0, "s": 1_000.0, "ms": 1.0, "µs": 0.001, "ns": 0.000001}
# ----------------------------------------------------------------------------


def parse_app_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """``time - logger - LEVEL - message`` lines → columns; others keep ``parsed = false``."""
    text = F.col(line)

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(text, APP_LINE, group), F.lit(""))

    parsed = text.rlike(APP_LINE)
    stamp = F.when(parsed, F.concat_ws(".", part(1), part(2)))
    return lines.select(
        "*",
        F.try_to_timestamp(stamp).cast("timestamp_ntz").alias("timestamp"),
        part(3).alias("component"),
        part(4).alias("level"),
        F.when(parsed, F.regexp_extract(text, APP_LINE, 5)).alias("message"),
        F.coalesce(parsed, F.lit(False)).alias("parsed"),
    )


def duration_ms(text: Column) -> Column:
    """Duration text such as ``1.5ms``, ``250µs`` or ``1m2.5s`` in milliseconds.

    Most durations are one number and one unit; only the others are taken apart.
    """
    one = r"^(\d+(?:\.\d+)?)(h|m|s|ms|µs|ns)$"
    unit = F.regexp_extract(text, one, 2)
    factor = F.lit(None).cast("double")
    for name, value in DURATION_UNITS_MS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    single = F.regexp_extract(text, one, 1).try_cast("double") * factor
    return F.coalesce(single, _compound_ms(text))


def _compound_ms(text: Column) -> Column:
    total = None
    for unit, factor in DURATION_UNITS_MS.items():
        # "m" must not match the start of "ms"
        tail = r"(?![a-z])" if unit == "m" else ""
        number = F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}{tail}", 1)
        part = F.coalesce(number.try_cast("double"), F.lit(0.0)) * F.lit(factor)
        total = part if total is None else total + part
    return F.when(text.rlike(r"\d(h|m|s|ms|µs|ns)$"), total).when(text == "0", F.lit(0.0))


def parse_access_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON or plain access-log lines → columns; the level is ERROR when an error text is set."""
    text = F.col(line)
    entry = F.from_json(text, ACCESS_ENTRY)
    is_json = text.startswith("{")
    plain = text.rlike(ACCESS_LINE)

    def field(name: str, group: int | None, kind: str = "string") -> Column:
        from_json = F.col(f"__entry.{name}")
        if group is None:
            return from_json
        extracted = F.nullif(F.regexp_extract(text, ACCESS_LINE, group), F.lit(""))
        return F.when(is_json, from_json).otherwise(extracted.try_cast(kind))

    parsed = with_once(lines, {"__entry": F.when(is_json, entry)})
    error = F.nullif(F.col("__entry.error"), F.lit(""))
    return parsed.select(
        *lines.columns,
        F.try_to_timestamp(field("timestamp", 1)).cast("timestamp_ntz").alias("timestamp"),
        F.when(error.isNotNull(), "ERROR").otherwise(field("level", 2)).alias("level"),
        field("method", 3).alias("method"),
        field("path", 4).alias("path"),
        field("status_code", 5, "int").alias("status_code"),
        duration_ms(field("duration", 6)).alias("duration_ms"),
        field("client_ip", 7).alias("client_ip"),
        error.alias("error"),
        (
            F.coalesce(F.col("__entry.path").isNotNull(), F.lit(False))
            | F.coalesce(plain & ~is_json, F.lit(False))
        ).alias("parsed"),
    )


def log_volume(logs: DataFrame) -> DataFrame:
    """Lines per day and component, one column per level."""
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day")
    counts = [
        F.sum(F.when(F.col("level") == level, 1).otherwise(0)).alias(level.lower())
        for level in LOG_LEVELS
    ]
    return logs.groupBy(day, "component").agg(F.count(F.lit(1)).alias("lines"), *counts)
