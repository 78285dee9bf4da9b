"""Model requests and answers as tables: offline batch inference in, parsed structs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetide.functions import payload
from tonetide.functions.stage import with_once

# --- fixed values: fields and domains of answers, sampling options, defaults ----
REQUESTS: dict[str, dict[str, str]] = {
    "sentiment": {
        "task": "Judge the sentiment of the text below.",
        "fields": (
            "sentiment (positive | negative | neutral); "
            "score (0 to 1, strength of that sentiment); "
            "confidence (0 to 1, trust in the whole answer); "
            "entities (list of objects with type, name, sentiment); "
            "summary (one or two sentences)"
        ),
    },
    "financial": {
        "task": "Read the financial text below as a trading desk would.",
        "fields": (
            "market_sentiment (bullish | bearish | neutral); "
            "financial_entities (list of names of stocks, currencies, commodities); "
            "risk_level (low | medium | high); "
            "time_horizon (short-term | medium-term | long-term); "
            "trading_signal (buy | sell | hold)"
        ),
    },
    "context": {
        "task": "Judge the sentiment of the text below in the light of the context given.",
        "fields": (
            "sentiment (positive | negative | neutral); "
            "score (0 to 1, strength of that sentiment); "
            "confidence (0 to 1, trust in the whole answer); "
            "entities (list of objects with type, name, sentiment); "
            "summary (one or two sentences); "
            "context_impact (how the context changes the judgement)"
        ),
    },
}
REQUEST_OPTIONS = {"temperature": 0.1, "top_p": 0.9, "max_tokens": 512}
SENTIMENT_DEFAULTS = {"sentiment": "neutral", "score": 0.5, "confidence": 0.5, "summary": ""}
FAILED_CONFIDENCE = 0.1
FAILED_SUMMARY = "Failed to parse response"
FINANCIAL_DEFAULTS = {
    "market_sentiment": "neutral",
    "risk_level": "medium",
    "time_horizon": "medium-term",
    "trading_signal": "hold",
}
# ----------------------------------------------------------------------------

ENTITY_TYPE = "array<struct<type string, name string, sentiment string>>"


def build_prompts(texts: DataFrame, kind: str = "sentiment", key: str = "doc_id") -> DataFrame:
    """Request table (key, kind, prompt and sampling options) for a text table.

    Kind 'context' also needs a ``context`` column: a struct or map, put into
    the prompt as JSON.
    """
    request = REQUESTS[kind]
    parts = [F.lit(request["task"] + "\n\nText: "), F.col("text")]
    if kind == "context":
        parts += [F.lit("\n\nContext: "), F.to_json("context")]
    parts.append(
        F.lit(
            "\n\nAnswer with one JSON object and nothing else. Fields:\n"
            + request["fields"].replace("; ", "\n")
        )
    )
    options = [F.lit(v).alias(k) for k, v in REQUEST_OPTIONS.items()]
    return texts.select(key, F.lit(kind).alias("kind"), F.concat(*parts).alias("prompt"), *options)


def unfence(response: Column) -> Column:
    """Answer without surrounding blanks and json code fence."""
    blank = r"^[\s]+|[\s]+$"
    bare = F.regexp_replace(response, blank, "")
    bare = F.regexp_replace(bare, r"^```json", "")
    bare = F.regexp_replace(bare, r"```$", "")
    return F.regexp_replace(bare, blank, "")


def _answer(responses: DataFrame) -> DataFrame:
    return with_once(responses, {"__v": payload.parse(unfence(F.col("response")))}).withColumn(
        "__ok", F.coalesce(payload.is_object(F.col("__v")), F.lit(False))
    )


def _number(name: str) -> tuple[Column, Column]:
    """(value with default, whether the field is present but no number)."""
    kind = payload.field_kind(F.col("__v"), name)
    value = F.try_variant_get("__v", f"$.{name}", "double")
    broken = kind.isNotNull() & value.isNull()
    return F.coalesce(value, F.lit(SENTIMENT_DEFAULTS[name])), broken


def _text(name: str, default: str) -> Column:
    return F.coalesce(payload.text_field(F.col("__v"), name), F.lit(default))


def parse_model_responses(responses: DataFrame) -> DataFrame:
    """Answers (``response``) → sentiment, score, confidence, entities, summary, parse_failed.

    Absent fields take defaults. Anything that is not a JSON object with numeric
    scores becomes neutral / 0.5 / 0.1 with ``parse_failed``.
    """
    parsed = _answer(responses)
    score, score_broken = _number("score")
    confidence, confidence_broken = _number("confidence")
    parsed = parsed.withColumn(
        "__ok", F.col("__ok") & ~F.coalesce(score_broken | confidence_broken, F.lit(False))
    )
    ok = F.col("__ok")
    entities = F.coalesce(
        F.try_variant_get("__v", "$.entities", ENTITY_TYPE), F.array().cast(ENTITY_TYPE)
    )
    return parsed.select(
        *[c for c in responses.columns if c != "response"],
        F.when(ok, _text("sentiment", "neutral")).otherwise("neutral").alias("sentiment"),
        F.when(ok, score).otherwise(0.5).alias("score"),
        F.when(ok, confidence).otherwise(FAILED_CONFIDENCE).alias("confidence"),
        F.when(ok, entities).otherwise(F.array().cast(ENTITY_TYPE)).alias("entities"),
        F.when(ok, _text("summary", "")).otherwise(FAILED_SUMMARY).alias("summary"),
        (~ok).alias("parse_failed"),
    )


def parse_financial_responses(responses: DataFrame) -> DataFrame:
    """Answers → market_sentiment, financial_entities, risk_level, time_horizon,
    trading_signal, parse_failed; defaults where absent or unreadable."""
    parsed = _answer(responses)
    ok = F.col("__ok")
    names = F.array().cast("array<string>")
    entities = F.coalesce(
        F.try_variant_get("__v", "$.financial_entities", "array<string>"), names
    )
    texts = [
        F.when(ok, _text(name, default)).otherwise(default).alias(name)
        for name, default in FINANCIAL_DEFAULTS.items()
    ]
    return parsed.select(
        *[c for c in responses.columns if c != "response"],
        *texts,
        F.when(ok, entities).otherwise(names).alias("financial_entities"),
        (~ok).alias("parse_failed"),
    )


def signed_score(label: Column, score: Column) -> Column:
    """A 0–1 model score as a signed one: + for positive, - for negative, 0 otherwise."""
    return (
        F.when(label == "positive", score).when(label == "negative", -score).otherwise(F.lit(0.0))
    )


def financial_outlook(results: DataFrame, entities: str = "entities") -> DataFrame:
    """Add ``financial_sentiment`` by rule where no model answers: a stand-in with the same fields.

    The market view follows the label, the risk the strength of the score (0.3 and 0.7), the
    signal both; the horizon is the default. Names are those of the linked entities.
    """
    label, strength = F.col("sentiment_label"), F.abs(F.col("sentiment_score").cast("double"))
    strong = strength >= 0.7
    view = F.when(label == "positive", "bullish").when(label == "negative", "bearish")
    risk = F.when(strong, "high").when(strength >= 0.3, "medium").otherwise("low")
    signal = F.when(strong & (label == "positive"), "buy").when(strong & (label == "negative"), "sell")
    names = (
        F.col(entities)["entity_value"] if entities in results.columns else F.array().cast("array<string>")
    )
    fields = {
        "market_sentiment": F.coalesce(view, F.lit(FINANCIAL_DEFAULTS["market_sentiment"])),
        "risk_level": risk,
        "time_horizon": F.lit(FINANCIAL_DEFAULTS["time_horizon"]),
        "trading_signal": F.coalesce(signal, F.lit(FINANCIAL_DEFAULTS["trading_signal"])),
        "financial_entities": names,
    }
    return results.withColumn(
        "financial_sentiment", F.struct(*[c.alias(n) for n, c in fields.items()])
    )
