"""Column helpers for JSON payloads: parsing, canonical form, typed access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(json_text: Column) -> Column:
    """VARIANT of a JSON text, NULL when it is not valid JSON."""
    return F.try_parse_json(json_text)


def is_object(variant: Column) -> Column:
    return F.schema_of_variant(variant).startswith("OBJECT")


def canonical_json(json_text: Column) -> Column:
    """Compact JSON with keys sorted at every depth; NULL for invalid JSON."""
    return F.to_json(parse(json_text))


def sha256_of_json(json_text: Column) -> Column:
    return F.sha2(canonical_json(json_text), 256)


def field_kind(variant: Column, name: str) -> Column:
    """Type name of a top-level field ('STRING', 'BIGINT', …), NULL if absent."""
    return F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))


def string_field(variant: Column, name: str) -> Column:
    """A top-level field only if it really is a string (numbers are not turned into text)."""
    return F.when(
        field_kind(variant, name) == "STRING",
        F.try_variant_get(variant, f"$.{name}", "string"),
    )


def text_field(variant: Column, name: str) -> Column:
    """A top-level field as text whatever its type."""
    return F.try_variant_get(variant, f"$.{name}", "string")
