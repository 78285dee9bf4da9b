"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tonetide.operators import ingest, scoring, summaries, texts
from tonetide.plans import catalog
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources import tables

SF = "/root/testdata/sf0.001"
# steps that run Python in batches, by design
PYTHON_STEPS = {"embed_text", "knn_search", "knn_search_grouped"}
# run while the plan is built (they write tables first)
EAGER = {
    "near_duplicate_pairs", "drop_near_duplicates", "write_aggregates", "partition_monthly",
    "partition_daily", "upsert_embeddings", "evict_embeddings", "read_sentiment_topic",
    "write_results_batch", "mark_processed", "purge_raw",
}
QUERIES = catalog.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if n not in EAGER and not n.startswith("stream_"))
)
def test_no_cartesian_and_no_hidden_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    python = re.search(r"Python|MapInPandas|MapInArrow|FlatMapGroups", plan)
    assert bool(python) == (name in PYTHON_STEPS)


def test_scans_are_pruned_and_filtered(spark):
    plan = plan_of(summaries.recent_window_summary(fx.v_sentiment(spark, SF), fx.AS_OF, 24))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>", plan)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(ts,", plan)
    hourly = plan_of(summaries.hourly_sentiment_summary(fx.v_sentiment(spark, SF)))
    assert "props" not in hourly.split("ReadSchema")[1]


def test_row_work_does_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = scoring.score_sentiment(texts.with_entities(docs, fx.GAZETTEER))
    assert "Exchange" not in plan_of(texts.detect_language(texts.clean_text(scored)))


def test_costly_expressions_run_once(spark):
    docs = fx.v_lines(spark, SF)
    raw, _ = ingest.ingest_payloads(docs, "news")
    with_text, _ = texts.extract_text(raw.filter("source_id <> ''"))
    formatted = with_text.filter(F.length("text") > 10)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert formatted.count("parseJson(") <= 2


def test_aggregates_combine_before_the_shuffle(spark):
    plan = plan_of(summaries.source_volume_metrics(fx.v_sentiment(spark, SF)))
    assert plan.count("partial_") >= 2 and plan.count("Exchange") <= 2


def test_partitioned_reads_are_pruned(spark):
    path = fresh_path(spark, "pruned")
    tables.write_daily(fx.v_logs(spark, SF), path)
    one_day = spark.read.parquet(path).filter("log_date = DATE '2024-01-02'")
    assert re.search(r"PartitionFilters: \[.*log_date", plan_of(one_day))
    dropped = tables.drop_log_days(spark, path, fx.AS_OF, 29)
    assert dropped == ["2024-01-01"]
    assert spark.read.parquet(path).filter("log_date < DATE '2024-01-02'").count() == 0
