from decimal import Decimal

import pandas as pd
import pytest

from tonetide.operators import responses, scoring, texts
from tonetide.sources.fixtures import GAZETTEER

FAILED = ("neutral", 0.5, 0.1, 0, "Failed to parse response", True)


def test_sentiment_answers(spark):
    full = '{"sentiment":"positive","score":0.8,"confidence":0.9,"entities":[{"type":"company","name":"A","sentiment":"positive"}],"summary":"s"}'
    cases = [
        (f"```json\n{full}\n```", ("positive", 0.8, 0.9, 1, "s", False)),
        (full, ("positive", 0.8, 0.9, 1, "s", False)),
        (f"\n\t {full} ", ("positive", 0.8, 0.9, 1, "s", False)),
        ('{"sentiment":"negative"}', ("negative", 0.5, 0.5, 0, "", False)),
        ("{}", ("neutral", 0.5, 0.5, 0, "", False)),
        ('{"sentiment":', FAILED),
        ("", FAILED),
        (None, FAILED),
        ('{"score":"high"}', FAILED),
        ('{"score":null}', FAILED),
        (f"[{full}]", FAILED),
        ('{"score":"0.7"}', ("neutral", 0.7, 0.5, 0, "", False)),
        (f"```\n{full}\n```", FAILED),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "doc_id long, response string")
    found = {
        r.doc_id: (r.sentiment, r.score, r.confidence, len(r.entities), r.summary, r.parse_failed)
        for r in responses.parse_model_responses(df).collect()
    }
    assert found == {i: want for i, (_, want) in enumerate(cases)}


def test_financial_answers(spark):
    df = spark.createDataFrame(
        [(1, '{"market_sentiment":"bullish","financial_entities":["AAPL","USD"],"risk_level":"low"}'), (2, "?")],
        "doc_id long, response string",
    )
    one, two = responses.parse_financial_responses(df).orderBy("doc_id").collect()
    assert (one.market_sentiment, one.risk_level, one.time_horizon, one.trading_signal) == (
        "bullish", "low", "medium-term", "hold",
    )
    assert one.financial_entities == ["AAPL", "USD"] and not one.parse_failed
    assert (two.market_sentiment, two.financial_entities, two.parse_failed) == ("neutral", [], True)


def test_prompts_hold_the_whole_text(spark):
    text = "word " * 5000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for kind in ("sentiment", "financial"):
        row = responses.build_prompts(df, kind).first()
        assert text in row.prompt and row.max_tokens == 512


def test_lexicon_scores(spark):
    df = spark.createDataFrame(
        [(1, "Strong gains, record profit!"), (2, "fraud crash plunge default loss delay"), (3, "the sky"), (4, "")],
        "doc_id long, text string",
    )
    found = {
        r.doc_id: (r.sentiment_label, r.sentiment_score, r.confidence_score)
        for r in scoring.score_sentiment(df).collect()
    }
    assert found == {
        1: ("positive", Decimal("0.4000"), Decimal("1.0000")),
        2: ("negative", Decimal("-1.0000"), Decimal("1.0000")),
        3: ("neutral", Decimal("0.0000"), Decimal("0.5000")),
        4: ("neutral", Decimal("0.0000"), Decimal("0.5000")),
    }


def test_batch_model_as_scorer(spark):
    def predict(series):
        return pd.DataFrame(
            {"label": ["positive"] * len(series), "score": series.str.len() / 100, "confidence": [0.25] * len(series)}
        )

    df = spark.createDataFrame([(1, "abcde")], "doc_id long, text string")
    row = scoring.score_sentiment(df, scoring.pandas_scorer(predict)).first()
    assert (row.sentiment_label, row.sentiment_score, row.confidence_score) == (
        "positive", Decimal("0.0500"), Decimal("0.2500"),
    )


def test_entities(spark):
    df = spark.createDataFrame(
        [(1, "Of the la, LA"), (2, "of; the"), (3, "oft he"), (4, "")], "doc_id long, text string"
    )
    found = {}
    for r in texts.link_entities(df, GAZETTEER).collect():
        found.setdefault(r.doc_id, set()).add(r.entity_value)
    assert found == {
        1: {"Theta Holdings", "OTH 100", "LAC", "LA 50"}, 2: {"Theta Holdings", "OTH 100"}
    }


def test_aliases_of_any_length(spark):
    entries = [
        texts.Instrument("bank of america", "company", "BAC", "equity"),
        texts.Instrument("bank of the far west", "company", "BFW", "equity"),
        texts.Instrument("bank of", "index", "BO", "index"),
    ]
    df = spark.createDataFrame(
        [(1, "Bank of America!"), (2, "the bank of the far, west bank"), (3, "bank")],
        "doc_id long, text string",
    )
    found = {(r.doc_id, r.entity_value) for r in texts.link_entities(df, entries).collect()}
    assert found == {(1, "BAC"), (1, "BO"), (2, "BFW"), (2, "BO")}


def test_clean_and_language(spark):
    df = spark.createDataFrame(
        [(1, "<p>The <b>Sky</b></p>\n https://x.example/a b\t<script>var x='<p>';</script>"), (2, "der und die the"), (3, "xyz")],
        "doc_id long, text string",
    )
    assert texts.clean_text(df).filter("doc_id = 1").first().clean_text == "the sky b"
    found = {r.doc_id: (r.language, r.language_hits) for r in texts.detect_language(df).collect()}
    assert found[2] == ("de", 3) and found[3] == ("und", 0)
    assert texts.detect_language(df, keep=["de"]).count() == 1


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars >= 200")
    found = texts.detect_language(docs)
    right = found.filter("language = lang").count() / found.count()
    assert right > 0.95
