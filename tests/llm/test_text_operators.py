"""The operators on whole texts, each against a plain computation in Python."""

import hashlib
import itertools
import os
import random
import zlib
from array import array
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonetide.llm import (
    coder,
    debruijn,
    mixing,
    pieces,
    quality_model,
    quality_rules,
    suffix_dedup,
    suffixes,
    syncmers,
    token_files,
)

digest = lambda data: hashlib.sha256(data).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


# ---- quality ------------------------------------------------------------------------------


def base_facts(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_quality_rules_base(spark, table, rough):
    got = quality_rules.op2_quality_rules(spark, table(rough)).collect()
    expected = []
    for i, t in rough:
        n, *rest, repeats = base_facts(t)
        expected.append((i, n, *rest, repeats, n < 50 or 100 * repeats > 50 * n))
    assert ordered(tuple(r)[:7] for r in got) == ordered(expected)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_estimate_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9])
    truth = np.where(good, 1, -1)[:, None]
    votes = np.where(rng.random((20_000, 4)) < right, truth, -truth)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.estimate(patterns, counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.02)
    assert model.on_good == pytest.approx(right, abs=0.03)
    assert model.on_bad == pytest.approx(right, abs=0.04)


@pytest.mark.parametrize(
    "query, column",
    [(quality_rules.op2_quality_rules, "base_failed"), (quality_model.op6_quality_classifier, None)],
)
def test_quality_agrees_with_labels(spark, query, column):
    sf = "/root/testdata/sf0.01"
    joined = query(spark, sf).drop("quality").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    if column:
        joined = joined.where(~F.col(column))
    found = joined.groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in found}
    good = counts.get((1, True), 0) / sum(n for (q, _), n in counts.items() if q == 1)
    bad = counts.get((0, False), 0) / sum(n for (q, _), n in counts.items() if q == 0)
    assert good > 0.98 and bad > 0.9


def test_keep_good_keeps_columns(make, rough):
    docs = make(rough)
    for keep in (quality_rules.keep_good, quality_model.keep_good):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert 0 < kept.count() < docs.count()
    assert quality_rules.keep_good(make([])).count() == 0
    assert quality_model.keep_good(make([])).count() == 0


def plain_estimate(votes, trust, expected):
    """Accuracies of voters by expectation-maximisation, vote by vote."""
    rules = len(votes[0])
    prior, on_good, on_bad = 0.8, [0.9] * rules, [0.6] * rules

    def good(v):
        a, b = prior, 1 - prior
        for j, x in enumerate(v):
            a *= {1: on_good[j], -1: 1 - on_good[j], 0: 1}[x]
            b *= {1: 1 - on_bad[j], -1: on_bad[j], 0: 1}[x]
        return a / (a + b)

    for _ in range(200):
        p = [good(v) for v in votes]
        goods, bads = sum(p), len(p) - sum(p)
        prior = (goods + 1) / (len(p) + 2)
        for j in range(rules):
            up = sum(x for x, v in zip(p, votes) if v[j] == 1)
            against = sum(x for x, v in zip(p, votes) if v[j] == -1)
            on_good[j] = (up + 1 + trust * expected[0] * goods) / (up + against + 2 + trust * goods)
            up = sum(1 - x for x, v in zip(p, votes) if v[j] == -1)
            against = sum(1 - x for x, v in zip(p, votes) if v[j] == 1)
            on_bad[j] = (up + 1 + trust * expected[1] * bads) / (up + against + 2 + trust * bads)
    return [good(v) for v in votes]


def votes_of(spark, facts, rules):
    rows = spark.createDataFrame([tuple(f) for f in facts], ", ".join(f"{n} long" for n in quality_rules.NAMES))
    return [tuple(r) for r in rows.select(*[r.vote().alias(r.name) for r in rules]).collect()]


def junk(corpus):
    """The corpus with texts of several bad kinds."""
    rows = [t for _, t in corpus]
    rows += ["#$% " * 20 + t for t in rows[:6]]
    rows += ["SHOUT " + t.upper() for t in rows[6:14]]
    rows += ["\n".join(t.split()[:8] * 6) for t in rows[14:24]]
    rows += [" ".join("%d9" % (i * n) for i in range(60)) for n in range(1, 9)]
    rows += [" ".join(f"{w.upper()}#$%&" for w in t.split()) for t in rows[24:44]]
    return [(i, t) for i, t in enumerate(rows)]


def test_rule_posteriors_against_plain_estimate(spark, table, corpus):
    rows = junk(corpus)
    got = quality_rules.op2_quality_rules(spark, table(rows)).collect()
    facts = {i: quality_rules.facts_of(t.encode()) for i, t in rows}
    judged = [r for r in got if not r.base_failed]
    votes = votes_of(spark, [facts[r.doc_id] for r in judged], quality_rules.RULES)
    expected = plain_estimate(votes, 0.0, (0, 0))
    assert len({r.kept for r in judged}) == 2
    for row, p in zip(judged, expected):
        assert row.quality == pytest.approx(p, abs=1e-6)
        assert row.kept == (p >= 0.5)


def test_classifier_against_plain_training(spark, table, corpus):
    rows = junk(corpus)
    got = {r.doc_id: r.score for r in quality_model.op6_quality_classifier(spark, table(rows)).collect()}
    facts = [quality_rules.facts_of(t.encode()) for _, t in rows]
    labels = plain_estimate(votes_of(spark, facts, quality_model.LABELLERS), 1.0, (0.99, 0.4))
    features = []
    for (_, t), f in zip(rows, facts):
        slots, weights = quality_model.slots_of(t.encode(), f)
        sums = Counter()
        for s, w in zip(slots.tolist(), weights.tolist()):
            sums[s] += w
        features.append(sums)
    goods = sum(labels)
    weight = [p / goods + (1 - p) / (len(labels) - goods) for p in labels]
    # Adam, full batch, over the slots that occur (-1: the bias)
    names = sorted({s for f in features for s in f}) + [-1]
    w, first, second = ({s: 0.0 for s in names} for _ in range(3))
    value = lambda f: w[-1] + sum(w[s] * x for s, x in f.items())
    for step in range(1, 151):
        slope = {s: 1e-5 * w[s] for s in names}
        slope[-1] = 0.0
        for f, p, much in zip(features, labels, weight):
            error = much * (1 / (1 + np.exp(-value(f))) - p)
            slope[-1] += error
            for s, x in f.items():
                slope[s] += error * x
        for s in names:
            first[s] = 0.9 * first[s] + 0.1 * slope[s]
            second[s] = 0.99 * second[s] + 0.01 * slope[s] ** 2
            w[s] -= 0.5 * first[s] / (1 - 0.9**step) / ((second[s] / (1 - 0.99**step)) ** 0.5 + 1e-6)
    for (i, _), f in zip(rows, features):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-value(f))), abs=0.01)


# ---- suffix arrays ------------------------------------------------------------------------


@pytest.mark.parametrize("n, letters", [(1, 2), (60, 1), (700, 2), (900, 4)])
def test_suffix_array_and_prefixes(n, letters):
    data = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    raw = data.tobytes()
    order = suffixes.suffix_array(data)
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))
    got = suffixes.common_prefixes(data, order, 20, lanes=7)
    for a, b, g in zip(order, order[1:], got[1:]):
        assert g == min(20, len(os.path.commonprefix([raw[a:], raw[b:]])))


def brute_bytes(rows, size):
    seen = Counter(
        b[i : i + size]
        for b in ((t or "").encode() for _, t in rows)
        for i in range(len(b) - size + 1)
    )
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                hit[s : s + size] = b"\1" * size
        kept = bytes(itertools.compress(b, (not h for h in hit)))
        runs = sum(1 for k, _ in itertools.groupby(hit) if k)
        yield i, len(b), sum(hit), runs, kept


@pytest.mark.parametrize("limits", [{}, {"hot": 1, "shard_bytes": 600}])
def test_suffix_dedup(spark, make, rough, limits):
    """With the usual limits, and with all groups salted and cut into many shards."""
    repeats = suffix_dedup.Repeats(make(rough), window=40, gram=12, **limits)
    rows = repeats.applied()
    got = rows.select("id", suffix_dedup.cut_texts(rows, 40, True).alias("c")).select(
        "id", "c.n_bytes", "c.n_removed", "c.n_spans", "c.kept"
    )
    got = [(*tuple(r)[:4], bytes(r.kept)) for r in got.collect()]
    assert ordered(got) == ordered(brute_bytes(rough, 40))


def test_suffix_dedup_query(spark, table, corpus):
    long = [(i, t * 1) for i, t in corpus] + [(9001, "ab" * 900), (9002, corpus[0][1] * 2)]
    got = suffix_dedup.op4_suffix_dedup(spark, table(long)).collect()
    expected = [(*r[:4], digest(r[4])) for r in brute_bytes(long, 400)]
    assert ordered(got) == ordered(expected)
    assert suffix_dedup.op4_suffix_dedup(spark, table([])).count() == 0


# ---- substring dedup ----------------------------------------------------------------------


def brute_words(rows, size=13):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        if i is not None:
            for s in range(len(words) - size + 1):
                key = tuple(words[s : s + size])
                first[key] = min(i, first.get(key, i))
    for i, t in rows:
        words = (t or "").encode().split()
        hit = [False] * len(words)
        for s in range(len(words) - size + 1) if i is not None else ():
            if first[tuple(words[s : s + size])] < i:
                hit[s : s + size] = [True] * size
        yield i, len(words), sum(hit), [w for w, h in zip(words, hit) if not h]


def test_substring_dedup(spark, table, rough):
    got = debruijn.op10_substring_dedup(spark, table(rough)).collect()
    expected = [(i, n, r, digest(b" ".join(k))) for i, n, r, k in brute_words(rough)]
    assert ordered(got) == ordered(expected)
    assert debruijn.op10_substring_dedup(spark, table([])).count() == 0


def test_substring_dedup_finds_all_under_false_alarms(spark, make, corpus):
    """A bitmap so small that every window is suspected."""
    repeats = debruijn.Repeats(make(corpus).select("doc_id", "text"), bits=8)
    lost = {r.id for r in repeats.paths.collect()}
    cut = {i for i, _, removed, _ in brute_words(corpus) if removed}
    whole = {r.id for r in repeats.copies.later().collect()}
    assert lost | whole == cut


def test_substring_stage_keeps_columns(make, rough):
    docs = make(rough)
    got = debruijn.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = {(i, " ".join(w.decode() for w in k)) for i, _, r, k in brute_words(rough) if r}
    assert texts <= {(r.doc_id, r.text) for r in got.collect()}
    assert got.where("n_chars <> length(text)").count() == 0


def test_words_are_forgotten_with_their_task():
    """A worker is used again by other stages, whose room the words would take."""
    import pyarrow as pa

    vocabulary = pieces.vocabulary()
    batches = [pa.array(["some words", None]), pa.array(["of a text"])]
    made = []
    for ids in pieces._encoded_batches(batches, vocabulary):
        assert vocabulary.known
        made += [np.array(r, "<u4").tobytes() for r in ids.to_pylist()]
    assert not vocabulary.known
    assert made == vocabulary.encode(["some words", None, "of a text"])


# ---- token files --------------------------------------------------------------------------


@pytest.mark.parametrize("length", [0, 1, 5, coder.BLOCK, 3 * coder.BLOCK + 11])
@pytest.mark.parametrize("kind", ["same", "period", "random", "edges"])
def test_coder_round_trip(length, kind):
    ids = {
        "same": np.zeros(length, int),
        "period": np.arange(length) % 7,
        "random": np.random.default_rng(1).integers(0, 50_000, length),
        "edges": np.array([0, 1, 2**19, 2**20 - 1] * (length // 4 + 1))[:length],
    }[kind]
    coded, sums = coder.encode(ids)
    assert (coder.decode(coded, sums, length) == ids).all()
    if length > coder.BLOCK and kind in ("same", "period"):
        assert sum(map(len, coded)) < length // 8


def test_coder_reports_damage():
    coded, sums = coder.encode(np.arange(5000) % 100)
    coded[1] = coded[1][:8] + bytes(4) + coded[1][12:]
    with pytest.raises(ValueError, match="block 1"):
        coder.decode(coded, sums, 5000)
    with pytest.raises(ValueError, match="digits"):
        coder.encode(np.array([2**20]))


def test_token_files(spark, table, rough, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = rough + [(8000, "a <|startoftext|> b<|endoftext|>c"), (8001, "don't ΣΑΣ é x y")]
    whole = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    encode = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [2]
    got = token_files.op5_token_files(spark, table(rows)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    made = Counter((i, zlib.crc32(array("I", encode(t)).tobytes()), len(encode(t))) for i, t in rows)
    assert made == Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert token_files.op5_token_files(spark, table([])).count() == 0


def test_words_of_a_line_have_their_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = "abzABZ019'’.,!éßΣσς中文ｆ\u00a0\u2028\u0301\u200b\u0130<|>"
    words = {"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(3000)}
    words |= {"<|endoftext|>", "a<|startoftext|>b", "İ", "\u0301x", "\u00a0", "don't"}
    whole = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    texts = [" ".join(rng.choices(sorted(words), k=400)) for _ in range(20)] + sorted(words)
    made = token_files.WordTokenizer(public_tokenizers.path(token_files.TOKENIZER)).encode(
        [t.encode() for t in texts], b""
    )
    for text, ids in zip(texts, made):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_share_the_ids_of_their_letters():
    """Capitals and marks after a word ask for no more tokenizing; the ids stay those of the text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER)
    words = token_files.WordTokenizer(path)
    text = "Größer größer, GRÖSSER. word Word... WORD! don't x1 a<b <|endoftext|> µ word\x1cword"
    made = np.frombuffer(words.encode([text.encode(), "word, größer".encode()], b"")[0], "<u4").tolist()
    assert made == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    parts = {"größer", "grösser", "word", ",", ".", "...", "!"}
    whole = {"don't", "x1", "a<b", "<|endoftext|>", "µ", "word\x1cword"}
    assert set(words.known) == parts | whole | {""}


@pytest.mark.parametrize("chunk_ids", [1, 7, 60])
def test_chunks_end_with_the_text_that_fills_them(spark, table, rough, tmp_path, chunk_ids):
    docs = spark.read.parquet(f"{table(rough)}/documents.parquet")
    token_files.write(docs, f"{tmp_path}/small", chunk_ids=chunk_ids)
    token_files.write(docs, f"{tmp_path}/whole")
    rows = [token_files.read(spark, f"{tmp_path}/{n}").orderBy("start").collect() for n in ("small", "whole")]
    assert rows[0] == rows[1]
    for r in spark.read.parquet(f"{tmp_path}/small").collect():
        counts = np.frombuffer(r.counts, "<u4")
        assert r.n_ids == counts.sum() and counts[:-1].sum() < chunk_ids


# ---- mixing -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1000}, {f"s{i}": i + 1 for i in range(30)}]
)
def test_slots_deviate_less_than_one_block(weights):
    shares = mixing.exact_shares(weights)
    length, done = sum(shares.values()), Counter()
    for slot, (source, *_) in enumerate(itertools.islice(mixing.served(shares), 4000), 1):
        done[source] += 1
        assert all(abs(done[s] * length - slot * n) < length for s, n in shares.items())


def test_schedule_places_every_block_once():
    blocks = {"a": 2500, "b": 3, "c": 700, "d": 0}
    rows = list(mixing.schedule(blocks, {"a": 1, "b": 2, "c": 3, "d": 1}))
    assert [slot for *_, slot in rows] == list(range(sum(blocks.values())))
    assert all(release <= slot < deadline for *_, release, deadline, slot in rows)
    for source, n in blocks.items():
        assert [k for s, k, *_ in rows if s == source] == list(range(n))


def test_mixing_query(spark, table, make, rough, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 5)
    got = mixing.op7_source_mixing(spark, table(rough)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rough)
    assert all(r.release <= r.slot < r.deadline for r in got)
    by_source = {}
    for r in sorted(got, key=lambda r: (str(r.source), r.offset)):
        assert r.offset == by_source.get(r.source, 0) and r.block == r.offset // mixing.BLOCK_CHARS
        by_source[r.source] = r.offset + r.n_chars
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got})
    docs = make(rough)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs).count() == 0
    assert mixing.op7_source_mixing(spark, table([])).count() == 0


@pytest.mark.parametrize(
    "weights",
    [
        {"big": 0.3} | {f"s{i}": 0.7 / 19 for i in range(19)},
        {"big": 0.5} | {f"s{i}": 0.5 / 899 for i in range(899)},
        {f"s{i}": (i + 1) ** 0.5 for i in range(1500)},
    ],
)
def test_schedule_keeps_to_the_weights_themselves(weights):
    """Over 20 times 1,000 slots no source is a block away from its target; rounded shares drift."""
    total = sum(map(Fraction, weights.values()))
    blocks = {s: 20_000 for s in weights}
    done = Counter()
    for source, block, phase, release, deadline, slot in itertools.islice(
        mixing.schedule(blocks, weights), 20_000
    ):
        assert block == done[source] and phase == 0 and release <= slot < deadline
        done[source] += 1
        share = Fraction(weights[source]) / total
        assert abs(done[source] - (slot + 1) * share) < 1 and abs(block - slot * share) < 1
    assert all(abs(done[s] - 20_000 * Fraction(w) / total) < 1 for s, w in weights.items())


@pytest.mark.parametrize("sent", [0, 1 << 18])
def test_slots_over_chunks_and_many_sources(spark, monkeypatch, sent):
    """More sources than slots in the former cycle, several chunks of one source, both joins."""
    monkeypatch.setattr(mixing, "SENT_BLOCKS", sent)
    items = spark.range(4_000).selectExpr(
        "id", "if(id < 2700, 'large', concat('s', id)) AS source", "10L AS size"
    )
    weights = {"large": 0.5} | {f"s{i}": 0.5 / 1300 for i in range(2700, 4000)}
    got = mixing.placed(items, weights, block_chars=10).collect()
    blocks = {s: 2700 if s == "large" else 1 for s in weights}
    keyed = {f"={s}": s for s in weights}
    expected = {
        (keyed[s], *rest)
        for s, *rest in mixing.schedule(
            {k: blocks[s] for k, s in keyed.items()}, {k: weights[s] for k, s in keyed.items()}
        )
    }
    assert {(r.source, r.block, r.phase, r.release, r.deadline, r.slot) for r in got} == expected
    assert sorted(r.slot for r in got) == list(range(4_000))


# ---- syncmers -----------------------------------------------------------------------------


def test_syncmers(spark, table, rough):
    rows = [(i, t) for i, t in rough if i is not None]
    got = syncmers.op8_syncmer_fingerprints(spark, table(rough)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rough)
    # rows of one id follow each other in the order of a hash: leave them out here
    single = [i for i, n in Counter(i for i, _ in rows).items() if n == 1]
    falling = sorted((r for r in rows), key=lambda r: -r[0])
    by_id = {r.doc_id: r for r in got}
    for (i, t), (j, after) in zip(falling, falling[1:]):
        if i in single and j in single:
            t, after = t or "", after or ""
            cut = len(t) // 3
            edited = t[: len(t) - cut] + after[:cut]
            assert by_id[i].edited_sha256 == digest(edited.encode())
            assert by_id[i].n_chars == len(t)
            assert 0 <= by_id[i].near_next <= 1 and 0 <= by_id[i].near_edited <= 1
    prints = {}
    texts = dict(rows)
    for i in single:
        assert prints.setdefault(texts[i] or "", by_id[i].fingerprint) == by_id[i].fingerprint
    long = [by_id[i] for i in single if len((texts[i] or "").split()) > 60 and "again" not in texts[i]]
    assert sum(r.near_edited > 0.25 for r in long) > 0.9 * len(long)
    assert syncmers.op8_syncmer_fingerprints(spark, table([])).count() == 0


def test_anchors_are_closed_syncmers_and_free_of_context(spark):
    words = [f"w{i * i % 97}" for i in range(60)]
    rows = [("whole", " ".join(words)), ("part", " ".join(words[20:50])), ("few", "a b"), ("none", "")]
    frame = spark.createDataFrame(rows, "name string, text string")
    got = {
        r.name: [(a["at"], a["hash"]) for a in r.anchors]
        for r in syncmers.with_anchors(frame, "text", "anchors").collect()
    }
    inside = [(at - 20, h) for at, h in got["whole"] if 20 <= at <= 50 - syncmers.K]
    assert inside == got["part"]
    assert len(got["few"]) == 1 and got["none"] == []
    gaps = np.diff([at for at, _ in got["whole"]])
    assert gaps.max() <= syncmers.K - 2
    found = syncmers.matches(frame.where("name = 'whole'"), frame.where("name = 'part'"), "name", "text")
    assert found.orderBy(F.desc("anchors")).first()["shift"] == -20


# ---- pieces -------------------------------------------------------------------------------


def best_score(word, scores):
    """The best segmentation by trying all of them from the left."""
    if not word:
        return 0.0
    options = [
        scores[word[:n]] + best_score(word[n:], scores)
        for n in range(1, len(word) + 1)
        if word[:n] in scores
    ]
    return max(options + [pieces.FALLBACK + best_score(word[1:], scores)])


def test_viterbi_is_the_best_segmentation():
    rng = np.random.default_rng(2)
    parts = {"".join(rng.choice(list("ab▁"), n)).strip("▁") for n in (1, 1, 2, 2, 3, 4) for _ in range(9)}
    parts = sorted({p for p in parts if p and "▁" not in p} | {"▁", "▁a", "▁ab"})
    scores = {p: -float(rng.integers(1, 12)) for p in parts}
    rows = [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    rows += [(p, s, "text") for p, s in scores.items()]
    made = pieces.Pieces(rows)
    plain = {p.replace("▁", " "): s for p, s in scores.items()}
    words = [" " + "".join(rng.choice(list("abc"), rng.integers(0, 8))) for _ in range(200)]
    made.learn(set(words))
    for w in words:
        ids = array("I", made.known[w]).tolist()
        cost = sum(rows[i][1] for i in ids if i >= 256) + pieces.FALLBACK * sum(i < 256 for i in ids)
        assert cost == pytest.approx(best_score(w, plain))
        assert b"".join(made.bytes[i] for i in ids).decode() == w


def test_sentencepiece_round_trip(spark, table, make, rough):
    got = pieces.op9_sentencepiece(spark, table(rough)).collect()
    assert all(r.same for r in got)
    expected = Counter((i, digest((t or "").encode())) for i, t in rough)
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == expected
    docs = make(rough)
    ids = pieces.with_ids(docs)
    assert ids.columns == [*docs.columns, "ids"]
    back = ids.select("text", pieces.decoded(F.col("ids")).alias("back"))
    assert back.where("back <> coalesce(text, '')").count() == 0
    assert pieces.op9_sentencepiece(spark, table([])).count() == 0
