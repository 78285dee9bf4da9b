"""Ingest-side checks: malformed payloads, field rules, constraints, schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetide.functions import payload
from tonetide.functions.stage import literal_table, with_once
from tonetide.schemas import LOG_LEVELS, PAYLOAD_RULES, SENTIMENT_LABELS, PayloadRule

URL_SHAPE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+"


def reject_reason(value: Column, variant: Column) -> Column:
    """Why a raw line cannot be ingested; NULL for a JSON object.

    Valid JSON that opens with a brace is an object, so its type need not be derived.
    """
    return (
        F.when(value.isNull() | (F.trim(value) == ""), F.lit("empty"))
        .when(variant.isNull(), F.lit("malformed_json"))
        .when(~F.regexp_like(value, F.lit(r"^\s*\{")), F.lit("not_an_object"))
    )


def reject_malformed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split lines into (accepted with ``payload`` VARIANT, rejects with ``reason``)."""
    parsed = with_once(lines, {"payload": payload.parse(F.col("value"))}).withColumn(
        "reason", reject_reason(F.col("value"), F.col("payload"))
    )
    accepted = parsed.filter(F.col("reason").isNull()).drop("reason")
    rejects = parsed.filter(F.col("reason").isNotNull()).drop("payload")
    return accepted, rejects


def _violation(rule: PayloadRule, variant: Column) -> Column:
    kind = payload.field_kind(variant, rule.field)
    text = payload.text_field(variant, rule.field)
    absent = kind.isNull() | (kind == "VOID")
    if rule.kind in ("string", "url", "time"):
        wrong_type = kind != "STRING"
    elif rule.kind == "integer":
        wrong_type = kind != "BIGINT"
    else:
        wrong_type = ~(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE"))
    if rule.kind in ("string", "url", "time"):
        empty = text == ""
    else:
        empty = text.cast("string").rlike(r"^-?0+(\.0+)?$")
    outcome = F.when(absent, F.lit("missing") if rule.required else F.lit(None))
    outcome = outcome.when(wrong_type, F.lit("type"))
    if rule.required:
        outcome = outcome.when(empty, F.lit("missing"))
    if rule.kind == "url":
        outcome = outcome.when(~text.rlike(URL_SHAPE), F.lit("url"))
    if rule.kind == "time":
        outcome = outcome.when(F.try_to_timestamp(text).isNull(), F.lit("time"))
    found = F.concat(F.lit(f"{rule.field}:"), outcome)
    return F.when(F.col("source") == rule.source, found)


def validate_required(
    messages: DataFrame, rules: Sequence[PayloadRule] = PAYLOAD_RULES
) -> DataFrame:
    """Add ``violations array<string>`` ('field:problem') to rows with source, content.

    Required numbers must be non-zero, as an unset number and zero are the same
    to the sender's encoding. Sources without rules never have violations.
    """
    parsed = with_once(messages, {"__payload": payload.parse(F.col("content"))})
    checks = F.array(*[_violation(rule, F.col("__payload")) for rule in rules])
    return parsed.withColumn("violations", F.array_compact(checks)).drop("__payload")


def result_constraints() -> dict[str, Column]:
    """Rule name → column that is true when the row breaks the rule."""
    score = F.col("sentiment_score").try_cast("decimal(5,4)")
    confidence = F.col("confidence_score").try_cast("decimal(5,4)")
    return {
        "source_id_null": F.col("source_id").isNull(),
        "source_id_length": F.length("source_id") > 255,
        "content_hash_null": F.col("content_hash").isNull(),
        "content_hash_length": F.length("content_hash") > 64,
        "timestamp_null": F.col("timestamp").isNull(),
        "source_type_null": F.col("source_type").isNull(),
        "source_type_length": F.length("source_type") > 50,
        "label_domain": F.col("sentiment_label").isNull()
        | ~F.col("sentiment_label").isin(*SENTIMENT_LABELS),
        "score_range": score.isNull() | ~score.between(-1, 1),
        "confidence_range": confidence.isNull() | ~confidence.between(0, 1),
    }


def log_constraints() -> dict[str, Column]:
    return {
        "level_domain": ~F.col("level").isin(*LOG_LEVELS),
        "component_null": F.col("component").isNull(),
        "component_length": F.length("component") > 50,
        "message_null": F.col("message").isNull(),
    }


def raw_constraints() -> dict[str, Column]:
    return {
        "source_null": F.col("source").isNull(),
        "source_length": F.length("source") > 100,
        "source_id_length": F.length("source_id") > 255,
        "content_null": F.col("content").isNull(),
        "timestamp_null": F.col("timestamp").isNull(),
        "content_hash_null": F.col("content_hash").isNull(),
        "content_hash_length": F.length("content_hash") > 64,
    }


def check_constraints(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """Violations per rule over the whole table: one scan, one aggregate row, unfolded."""
    counts = [
        F.sum(F.when(broken, 1).otherwise(0)).alias(name)
        for name, broken in constraints.items()
    ]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *counts)
    cells = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(name), F.lit(0)).alias("violations"))
        for name in constraints
    ]
    return wide.select(F.explode(F.array(*cells)).alias("c"), F.col("__rows").alias("rows")).select(
        "c.rule", "c.violations", "rows"
    )


def violating_rows(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """Rows breaking at least one rule, with the names of the broken rules."""
    names = F.array_compact(
        F.array(*[F.when(broken, F.lit(name)) for name, broken in constraints.items()])
    )
    return df.withColumn("broken_rules", names).filter(F.size("broken_rules") > 0)


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Column findings: 'missing', 'type_mismatch' or 'extra'; no rows when the table fits.

    Works on the schemas alone; the table is not read.
    """
    spark = df.sparkSession
    layout = "column_name string, {} string"

    def table(fields, name):
        rows = [(f.name, f.dataType.simpleString()) for f in fields]
        return literal_table(spark, rows, layout.format(name))

    wanted = table(expected.fields, "expected_type")
    found = table(df.schema.fields, "found_type")
    problem = (
        F.when(F.col("found_type").isNull(), "missing")
        .when(F.col("expected_type").isNull(), "extra")
        .when(F.col("found_type") != F.col("expected_type"), "type_mismatch")
    )
    return (
        wanted.join(found, "column_name", "full_outer")
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
    )
