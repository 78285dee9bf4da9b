"""Scoring of text tables through a pluggable scorer.

A scorer maps a DataFrame with ``text`` to the same rows plus
``sentiment_label``, ``sentiment_score`` in [-1, 1] and ``confidence_score`` in
[0, 1]. The default is a word lexicon evaluated inside the row;
``pandas_scorer`` adapts a batch model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetide.functions.stage import with_once
from tonetide.functions.text import net_weight, tokens, weigh_tokens, weighted_tokens

Scorer = Callable[[DataFrame], DataFrame]

# --- fixed values: default word weights (finance vocabulary) -----------------
DEFAULT_LEXICON: dict[str, int] = {
    "gain": 1, "gains": 1, "growth": 1, "rise": 1, "rises": 1, "strong": 1, "improved": 1,
    "positive": 1, "profit": 1, "beat": 1, "rally": 2, "surge": 2, "record": 1, "upgrade": 2,
    "bullish": 2, "drop": -1, "drops": -1, "fall": -1, "falls": -1, "loss": -1, "weak": -1,
    "delay": -1, "delays": -1, "concern": -1, "concerns": -1, "negative": -1, "inflation": -1,
    "crash": -2, "plunge": -2, "downgrade": -2, "bearish": -2, "default": -2, "fraud": -2,
}
# ----------------------------------------------------------------------------

SCORE_STEP = 10  # a net weight of ±10 saturates the score
LABEL_MARGIN = "0.1"
RESULT_FIELDS = [
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DecimalType(5, 4)),
    T.StructField("confidence_score", T.DecimalType(5, 4)),
]


def lexicon_scorer(lexicon: Mapping[str, int] = DEFAULT_LEXICON) -> Scorer:
    """Score = net weight / 10 clamped to [-1, 1]; label by a margin of 0.1;
    confidence = share of weighted words, 0.5 for a text without any."""

    def score(df: DataFrame) -> DataFrame:
        words = with_once(df, {"__words": tokens(F.col("text"))})
        weighed = with_once(
            words,
            {
                "__packed": weigh_tokens(F.col("__words"), lexicon),
                "__total": F.size("__words"),
            },
        )
        counted = weighed.withColumn("__net", net_weight(F.col("__packed"))).withColumn(
            "__hits", weighted_tokens(F.col("__packed"))
        )
        clamped = F.greatest(F.least(F.col("__net"), F.lit(SCORE_STEP)), F.lit(-SCORE_STEP))
        signed = (clamped.cast("decimal(10,0)") * F.lit("0.1").cast("decimal(2,1)")).cast(
            "decimal(5,4)"
        )
        margin = F.lit(LABEL_MARGIN).cast("decimal(5,4)")
        label = (
            F.when(F.col("sentiment_score") > margin, "positive")
            .when(F.col("sentiment_score") < -margin, "negative")
            .otherwise("neutral")
        )
        # share of weighted words in ten-thousandths, cut, so that it is exact
        confidence = F.when(F.col("__hits") == 0, F.lit("0.5").cast("decimal(5,4)")).otherwise(
            (
                F.floor(F.col("__hits") * 10_000 / F.col("__total")).cast("decimal(10,0)")
                * F.lit("0.0001").cast("decimal(5,4)")
            ).cast("decimal(5,4)")
        )
        return (
            counted.withColumn("sentiment_score", signed)
            .withColumn("sentiment_label", label)
            .withColumn("confidence_score", confidence)
            .drop("__words", "__packed", "__net", "__hits", "__total")
        )

    return score


def pandas_scorer(predict: Callable) -> Scorer:
    """Adapt ``predict(series of texts) → DataFrame[label, score, confidence]``.

    The model is called per Arrow batch on the executors; put its loading inside
    ``predict`` behind a module-level cache so each worker loads it once.
    """

    def score(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + RESULT_FIELDS)

        def run(batches: Iterator) -> Iterator:
            from decimal import Decimal

            def fixed(values):
                return [Decimal(f"{v:.4f}") for v in values]

            for batch in batches:
                answer = predict(batch["text"])
                batch["sentiment_label"] = answer["label"].to_numpy()
                batch["sentiment_score"] = fixed(answer["score"])
                batch["confidence_score"] = fixed(answer["confidence"])
                yield batch

        return df.mapInPandas(run, schema)

    return score


def score_sentiment(texts: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Label, score and confidence for each row of a text table."""
    return (scorer or lexicon_scorer())(texts)
