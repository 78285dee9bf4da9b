"""The corpus pipeline stage by stage, and every registered corpus query."""

import random
from collections import Counter

import pytest
from test_near_copies import stays_of
from test_text_operators import brute_words

import __spark_entry__ as entry
import corpus_pipeline
from tonetide.llm import mixing, pieces, quality_rules, registry


def rows_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages(spark, make, table, corpus, tmp_path):
    """Each stage's rows from the rows of the one before; only the kept verdicts are taken over."""
    passage = corpus[0][1]
    rows = corpus + [(9000, f"{passage} {corpus[5][1]} and more words of its own")]
    folder = table(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality_rules.op2_quality_rules(spark, folder).where("kept").collect()
    expected = [(i, t) for i, t in rows if i in {r.doc_id for r in judged}]
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "near dedup":
            expected = stays_of(expected)
        if name == "substring dedup":
            texts = dict(expected)
            expected = [
                (i, " ".join(w.decode() for w in kept) if removed else texts[i])
                for i, _, removed, kept in brute_words(expected)
            ]
        if name != "tokens":
            assert docs.columns == columns
            assert rows_of(docs) == sorted(expected, key=str), name
    texts = dict(expected)
    vocabulary = pieces.vocabulary()
    for r in docs.collect():
        ids = vocabulary.encode([texts[r.doc_id]])[0]
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == r.ids
    assert {r.doc_id for r in docs.collect()} == set(texts)


def test_mixed_order_reaches_the_last_rows(spark, tmp_path):
    """Sorted by slot and offset, every prefix of the run's rows holds the target shares."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def text(i):
        rng = random.Random(i)
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300))

    owner = lambda i: "ab"[i % 8 == 0] if i % 2 else "c"
    rows = [(i, text(i), "en", owner(i)) for i in range(1200)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.repartition(7).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).select("doc_id", "source", "slot", "offset").collect()
    sizes = {i: len(t) for i, t, *_ in rows}
    chars = Counter()
    for r in got:
        chars[r.source] += sizes[r.doc_id]
    weight = {s: n**0.5 for s, n in chars.items()}
    total, block, longest = sum(weight.values()), mixing.BLOCK_CHARS, max(sizes.values())
    blocks = {s: (n - 1) // block + 1 for s, n in chars.items()}
    first_end = min(blocks[s] * total / weight[s] for s in weight)
    done = Counter()
    checked = 0
    in_order = sorted(got, key=lambda r: (r.slot, r.offset))
    assert len({(r.slot, r.offset) for r in got}) == len(got)
    for r, after in zip(in_order, in_order[1:]):
        assert r.offset == done[r.source]
        done[r.source] += sizes[r.doc_id]
        if after.slot != r.slot and r.slot < first_end - 3:
            checked += 1
            for s in weight:
                assert abs(done[s] - (r.slot + 1) * block * weight[s] / total) < block + longest
    assert checked > 30


def test_run_equals_its_stages(spark, table, rough):
    folder = table(rough)
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_empty_table(spark, table):
    assert corpus_pipeline.run(spark, table([])).count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
