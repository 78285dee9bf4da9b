"""The stored term index: appends, replacements, replays, folds, pruned reads."""

import pytest

from tonetide.operators import search
from tonetide.session import fresh_path
from tonetide.sources.postings import TermIndex

DOCS = "doc_id long, title string, body string"
FIELDS = ("title", "body")


def index_of(spark, buckets=8):
    path = fresh_path(spark, "terms")
    layout = spark.createDataFrame([], DOCS).schema
    return TermIndex.create(spark, path, layout["doc_id"], FIELDS, buckets), path


def hits(index, queries, **options):
    return sorted((r.query_id, r.doc_id, r.hits, r.rank) for r in index.search(queries, **options).collect())


def scan(docs, queries):
    found = search.term_search_scan(docs, queries, fields=FIELDS)
    return sorted((r.query_id, r.doc_id, r.hits, r.rank) for r in found.collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [(1, "Apple"), (2, "stock"), (2, "MARKET"), (3, "none"), (4, "old")], "query_id long, term string"
    )


def test_appends_replace_earlier_versions(spark, queries):
    index, path = index_of(spark)
    assert hits(index, queries) == []
    first = spark.createDataFrame(
        [(1, "Apple Stock", "stock market market"), (2, "Old", "old old apple"), (3, None, "old"), (None, "apple", "apple")],
        DOCS,
    )
    assert index.append(first) == 0
    known = first.where("doc_id IS NOT NULL")
    assert hits(index, queries) == scan(known, queries)
    second = spark.createDataFrame([(2, "Apple", "market stock"), (4, "apple", ""), (3, None, None)], DOCS)
    assert index.append(second) == 1
    now = known.where("doc_id = 1").unionByName(second)
    assert hits(index, queries) == scan(now, queries)
    # a replay changes nothing, whatever is folded in between
    assert index.append(second, 1) == 1
    assert hits(index, queries) == scan(now, queries)
    assert index.compact() != [] and index.compact() == []
    again = TermIndex(spark, path)
    assert hits(again, queries) == scan(now, queries)
    assert again.append(first) == 2
    latest = known.unionByName(second.where("doc_id = 4"))
    assert hits(again, queries) == scan(latest, queries)
    again.compact()
    assert hits(TermIndex(spark, path), queries) == scan(latest, queries)
    # an empty append counts, and its number may be written again
    assert again.append(first.limit(0)) >= 2
    assert hits(again, queries, k=1)[0][:2] == (1, 1)
    with pytest.raises(FileNotFoundError):
        TermIndex(spark, f"{path}-none")


def test_replaced_postings_leave_the_files(spark, queries):
    index, path = index_of(spark, 1)
    docs = spark.createDataFrame([(n, "apple", f"w{n}") for n in range(100)], DOCS)
    for _ in range(3):
        index.append(docs)
    index.compact()
    assert spark.read.parquet(f"{path}/postings/folded").count() == 200
    assert index.search(queries, 200).count() == 100


def test_a_search_reads_the_buckets_of_its_terms(spark, queries):
    index, path = index_of(spark, 64)
    index.append(spark.createDataFrame([(n, "apple", f"w{n}") for n in range(500)], DOCS))
    one = queries.where("query_id = 1")
    plan = index.lookup(one)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "tf#" in x]
    assert scans and all("bucket#" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    assert {r.term for r in index.lookup(one).collect()} >= {"apple"}
    assert index.lookup(one).count() < index.postings.read().count()


def test_search_does_not_deal_postings_by_bucket(spark):
    """Few buckets would be few tasks that read all postings; terms are picked where they lie."""
    docs = spark.createDataFrame([(i, f"the text {i}") for i in range(50)], "doc_id long, text string")
    index = TermIndex.create(spark, fresh_path(spark, "terms"), docs.schema["doc_id"], buckets=4)
    index.append(docs)
    index.append(docs.where("doc_id < 5"))
    queries = spark.createDataFrame([(1, "the"), (1, "text")], "query_id long, term string")
    found = index.lookup(queries)
    assert "hashpartitioning(coalesce(bucket" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.term for r in found.collect()} == {"the", "text"} and found.count() == 100
    index.compact()
    found = index.lookup(queries)
    assert "hashpartitioning(coalesce(bucket" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.term for r in found.collect()} == {"the", "text"} and found.count() == 100
