"""Text side: pick the text of a payload, clean it, tell its language, link entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.functions import payload
from tonetide.functions.stage import literal_table, with_once
from tonetide.functions.text import count_tokens, strip_markup, tokens
from tonetide.operators.gazetteer import ENTITIES, Gazetteer
from tonetide.schemas import TEXT_FIELDS

# --- fixed values: most frequent function words per language ----------------
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "nicht"),
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "was", "with", "this", "are"),
    "es": ("el", "los", "del", "las", "por", "con", "su", "una", "es", "para", "al", "lo"),
    "fr": ("le", "et", "les", "des", "du", "une", "pour", "est", "qui", "par", "dans", "sur"),
}
# ----------------------------------------------------------------------------


def text_of(source: Column, content: Column, variant: Column) -> Column:
    """The text to score, by source, from JSON text and its parsed form.

    News joins headline and summary, tweets give their text, market data the
    symbol; other sources give the first field of ``TEXT_FIELDS`` that is a
    string, else the whole JSON. Content that is no object is its own text. A
    payload without any text gives NULL.
    """
    headline = payload.text_field(variant, "headline")
    summary = payload.text_field(variant, "summary")
    news = F.when(
        headline.isNotNull() | summary.isNotNull(),
        F.regexp_replace(
            F.concat(
                F.coalesce(headline, F.lit("")), F.lit(". "), F.coalesce(summary, F.lit(""))
            ),
            r"^\s+|\s+$",
            "",
        ),
    )
    other = F.coalesce(
        *[payload.string_field(variant, name) for name in TEXT_FIELDS], content
    )
    plain = F.coalesce(variant.try_cast("string"), content)
    text = (
        F.when(variant.isNull(), content)
        .when(~F.regexp_like(content, F.lit(r"^\s*\{")), plain)
        .when(source == "news", news)
        .when(source == "twitter", payload.text_field(variant, "text"))
        .when(source == "truedata", payload.text_field(variant, "symbol"))
        .otherwise(other)
    )
    return F.nullif(text, F.lit(""))


def extract_text(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with ``text``, rejects of type 'no_text')."""
    parsed = with_once(messages, {"__payload": payload.parse(F.col("content"))})
    with_text = with_once(
        parsed, {"text": text_of(F.col("source"), F.col("content"), F.col("__payload"))}
    ).drop("__payload")
    rejects = (
        with_text.filter(F.col("text").isNull())
        .drop("text")
        .withColumn("error_type", F.lit("no_text"))
    )
    return with_text.filter(F.col("text").isNotNull()), rejects


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``clean_text``."""
    return df.withColumn("clean_text", strip_markup(F.col(text)))


def detect_language(
    df: DataFrame,
    text: str = "text",
    stop_words: Mapping[str, Sequence[str]] = STOP_WORDS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``language`` and ``language_hits`` by function-word counts.

    The language with most hits wins, the alphabetically first among equals;
    no hit gives 'und'. ``keep`` filters by language. Row-local: the profile is
    part of the expression, so nothing is exploded or shuffled.
    """
    words = with_once(df, {"__words": tokens(F.col(text))})
    counts = [
        F.struct(
            count_tokens(F.col("__words"), list(terms)).cast("long").alias("hits"),
            F.lit(language).alias("language"),
        )
        for language, terms in sorted(stop_words.items())
    ]
    counted = words.withColumn("__counts", F.array(*counts)).drop("__words")
    best = F.reduce(
        "__counts",
        F.struct(F.lit(0).cast("long").alias("hits"), F.lit("und").alias("language")),
        lambda top, item: F.when(item["hits"] > top["hits"], item).otherwise(top),
    )
    found = (
        counted.withColumn("__best", best)
        .withColumn("language", F.col("__best.language"))
        .withColumn("language_hits", F.col("__best.hits"))
        .drop("__counts", "__best")
    )
    return found.filter(F.col("language").isin(*keep)) if keep else found


@dataclass(frozen=True)
class Instrument:
    """A gazetteer entry. An alias is one or more lower-case words; entries may share it."""

    alias: str
    entity_type: str
    entity_value: str
    asset_class: str


def gazetteer_table(spark: SparkSession, gazetteer: Sequence[Instrument]) -> DataFrame:
    rows = [(g.alias, g.entity_type, g.entity_value, g.asset_class) for g in gazetteer]
    return literal_table(
        spark, rows, "alias string, entity_type string, entity_value string, asset_class string"
    )


def entities_of(words: Column, gazetteer: Sequence[Instrument]) -> Column:
    """Sorted distinct ``array<struct<entity_type, entity_value, asset_class>>`` of the tokens of
    a text, given as one string with a blank before and after each token."""
    by_alias: dict[str, list[Column]] = {}
    for g in gazetteer:
        by_alias.setdefault(g.alias, []).append(
            F.struct(
                F.lit(g.entity_type).alias("entity_type"),
                F.lit(g.entity_value).alias("entity_value"),
                F.lit(g.asset_class).alias("asset_class"),
            )
        )
    none = F.array().cast(ENTITIES)
    named = [
        F.when(F.contains(words, F.lit(f" {alias} ")), F.array(*own).cast(ENTITIES)).otherwise(none)
        for alias, own in by_alias.items()
    ]
    return F.array_sort(F.array_distinct(F.concat(none, *named)))


def with_entities(
    df: DataFrame, gazetteer: Sequence[Instrument], text: str = "text"
) -> DataFrame:
    """Add ``entities`` to a text table, row by row, for a list of some dozen aliases.

    Each alias is looked for in each text; ``Gazetteer`` is the form for tables of aliases.
    """
    spaced = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    words = with_once(df, {"__words": spaced})
    linked = with_once(words, {"entities": entities_of(F.col("__words"), gazetteer)})
    return linked.drop("__words")


def link_entities(
    df: DataFrame,
    gazetteer: DataFrame | Sequence[Instrument],
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per (key, instrument) mentioned in the text, with its asset class.

    ``gazetteer`` is a table (alias, entity_type, entity_value, asset_class) of any size, or a
    short list of entries.
    """
    if not isinstance(gazetteer, DataFrame):
        gazetteer = gazetteer_table(df.sparkSession, gazetteer)
    return Gazetteer(gazetteer).link(df, key, text)
