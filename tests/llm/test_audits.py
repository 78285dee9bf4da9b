"""Source divergence, decontamination and the prefix trie against plain computations."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tonetide.llm import decontamination, divergence, prefix_trie
from tonetide.llm.automaton import Automaton

#: missing, empty, gaps only, one word, not ASCII, long, line ends
ODD_TEXTS = [
    None, "", " \t\n", "word", "Größe ▁ naïve \U0001f600 ñandú", "x" * 30_000,
    "a b\r\nc\x0bd\x0ce\tf", "again " * 3_000, "\x1c odd \x85 signs   here",
]
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _split(text, extra=""):
    """Lower-cased words of letters (and ``extra``) and everything outside ASCII."""
    text = "".join(c if ord(c) > 127 or c in LETTERS + extra else " " for c in text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]


# ---- source divergence ----------------------------------------------------------------------


def _audit(rows, min_docs, top):
    """Rows of (lang, source, text) → the report as a set."""
    rows = [(a or "", b or "", _split(t)) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for a, _, words in rows if a == lang for t in set(words))
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for a, b, words in rows:
            if a == lang:
                counts[b].update(w for w in words if docs[w] >= min_docs)

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out |= {(lang, s, part, o, v, i) for i, (v, o) in enumerate(ranked, 1)}
    return out


def _audit_rows():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcXÄß", k=rng.randint(1, 3))) for _ in range(90)]
    rows = []
    for i in range(240):
        size = rng.choice([0, 1, 20, 60])
        lang = rng.choice(["de", "de", "de", "fr", None])
        source = rng.choice(["a", "a", "a", "b", "c", "d", None])
        picked = rng.choices(words[: 40 + 10 * (i % 5)], k=size)
        rows.append((lang, source, rng.choice([" ", ", ", "1"]).join(picked)))
    rows += rows[:40]
    rows += [("xx", "only", t) for t in ODD_TEXTS] + [("fr", "silent", None)]
    return rows


@pytest.mark.parametrize("held", [200_000, 7])
def test_divergence_equals_plain_computation(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = _audit_rows()
    docs = spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int"
    ).repartition(4)
    for min_docs, top in ((5, 3), (1, 50)):
        found = divergence.Audit(docs, min_docs=min_docs).report(top)
        assert sorted(map(tuple, found.collect())) == sorted(_audit(rows, min_docs, top))


def test_divergence_without_terms_and_without_rows(spark):
    schema = "lang string, source string, text string"
    docs = spark.createDataFrame([("a", "x", "word"), ("a", "y", None), ("a", None, "")], schema)
    found = {tuple(r) for r in divergence.Audit(docs).report().collect()}
    assert found == _audit([("a", "x", "word"), ("a", "y", None), ("a", None, "")], 30, 50)
    assert len(found) == 6 and {r[4] for r in found} == {0}
    assert divergence.Audit(docs.limit(0)).report().collect() == []


def test_divergence_tree_hands_sums_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1)
    rows = _audit_rows()
    batch_rows = divergence.Audit(
        spark.createDataFrame(rows, "lang string, source string, text string"), min_docs=3
    )
    paths = batch_rows.rows().where(F.size("path") > 1).orderBy("lang", "path").select(
        "lang", F.col("path.source").alias("sources"), F.col("path.p").alias("p"),
        F.col("path.zero").alias("zero"), "rows",
    )
    table = paths.toArrow()

    def sums():
        out = Counter()
        for b in divergence._corrections(table.to_batches()):
            for r in b.to_pylist():
                out[r["lang"], *sorted((r["source"], r["item"]))] += r["value"]
        return out

    small = sums()
    monkeypatch.setattr(divergence, "HELD_PAIRS", 1 << 30)
    assert small == sums() and small


# ---- decontamination --------------------------------------------------------------------------


def _leaks(docs, items, window=10):
    windows = defaultdict(set)
    for name, text in items:
        words = _split(text, "0123456789")
        size = min(len(words), window)
        for at in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[at : at + size])].add(name)
    sizes = {len(w) for w in windows}
    out = []
    for number, text in docs:
        words = _split(text, "0123456789")
        hit, names = set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                found = windows.get(tuple(words[at : at + size]))
                if found:
                    hit |= set(range(at, at + size))
                    names |= found
        names = sorted(str(n) for n in names if n is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((number, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def _leak_rows(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abc" for b in ("", "x", "Y", "9")]
    said = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, said(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(30)]
    items += [items[5], (None, said(12)), (3, said(14)), (77, None), (78, "L" * 200 + " b c")]
    docs = [(i, said(rng.randint(0, 40))) for i in range(60)]
    for i, (_, t) in enumerate(items):
        docs.append((100 + i, f"{said(3)}, {(t or '').upper()}. {said(5)} {t}"))
    return docs + [(500 + i, t) for i, t in enumerate(ODD_TEXTS)] + [docs[0], (None, items[9][1])], items


@pytest.fixture(scope="module")
def leak_tables(spark):
    def build(docs, items):
        d = spark.createDataFrame(
            [(i, t, "k", 1) for i, t in docs], "doc_id bigint, text string, items string, spans int"
        ).repartition(3)
        return d, spark.createDataFrame(items, "item_id bigint, text string")

    return build


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
@pytest.mark.parametrize("shortest", [0, 10])
def test_decontamination_equals_plain_computation(spark, leak_tables, block_bytes, shortest, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT", 6)
    docs, items = _leak_rows(shortest + 1)
    items = [(i, t) for i, t in items if not t or len(t.split()) >= shortest]
    d, b = leak_tables(docs, items)
    found = decontamination.Leaks(d, b, block_bytes=block_bytes).rows.select(
        F.col("__row.doc_id"), "n_words", decontamination._hit(), "items", "spans"
    )
    got = [
        (r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), bool(r[4]))
        for r in found.collect()
    ]
    assert sorted(got, key=str) == _leaks(docs, items)


def test_decontamination_without_items_or_documents(leak_tables):
    docs, items = _leak_rows(5)
    d, b = leak_tables(docs, items)
    rows = decontamination.Leaks(d, b.limit(0)).rows.collect()
    assert len(rows) == len(docs) and not any(r["spans"] for r in rows)
    assert decontamination.Leaks(d.limit(0), b).rows.collect() == []


def test_without_leaks_cuts_texts_and_drops_leaky_ones(spark, leak_tables):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, f"Before, {item.upper()}; after it comes a longer tail of clean words that all remain here"),
        (2, item), (3, "clean text"), (4, None), (5, "one two three four"),
    ]
    d, b = leak_tables(docs, [(1, item)])
    kept = decontamination.without_leaks(d, b)
    assert kept.columns == d.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {
        1: "Before, ; after it comes a longer tail of clean words that all remain here",
        3: "clean text", 4: None, 5: "one two three four",
    }
    loose = decontamination.without_leaks(d, b, min_words=12, max_share=1.0)
    assert {r["doc_id"]: r["text"] for r in loose.collect()} == dict(docs)


def test_automaton_follows_matches_across_items():
    made = Automaton([(0, [b"a", b"b", b"c"]), (1, [b"b", b"c", b"d"]), (2, [b"c"])], 3)
    assert made.matches([b"a", b"b", b"c", b"d"]) == ([(0, 4)], {0, 1, 2})
    assert made.matches([b"b", b"c", b"x", b"d"]) == ([(1, 2)], {2})
    assert made.matches([]) == ([], set())


# ---- prefix trie ------------------------------------------------------------------------------


def _trie(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        value = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == p)
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p],
            saved[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _conversation_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(207, 215), 5000]:
        for turn in range(rng.choice([1, 2, 4, 7])):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["yes", "no", "größer"])))
    rows += [(700, None, "user", "late"), (700, 0, None, None), (700, None, None, "x"), (None, 1, "a", "b")]
    rows += [(701, 2, "b", "tie"), (701, 2, "a", "tie"), (701, 2, "a", "tie")]
    rows += [(702, t, "user", f"long {t % 7}") for t in range(60)]
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    def build(rows):
        full = [(*r, "clash", 3) for r in rows]
        return spark.createDataFrame(
            full, "conv_id bigint, turn bigint, role string, text string, rep string, depth int"
        ).repartition(3)

    return build


@pytest.mark.parametrize("chunk", [4096, 5])
def test_trie_equals_plain_computation(conversations, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = _conversation_rows(chunk)
    turns = prefix_trie.turns_of(conversations(rows))
    whole = prefix_trie.Trie(prefix_trie.with_shared_heads(turns)).report()
    assert sorted(map(tuple, whole.collect()), key=str) == _trie(rows)
    plain = prefix_trie.Trie(prefix_trie.with_starts(turns)).report()
    assert sorted(map(tuple, plain.collect()), key=str) == _trie(rows, rebuild=False)


def test_trie_of_no_conversations(conversations):
    turns = prefix_trie.turns_of(conversations(_conversation_rows(1)).limit(0))
    assert prefix_trie.Trie(prefix_trie.with_shared_heads(turns)).report().collect() == []


def test_trie_of_conversations_that_lose_all_turns(conversations):
    # their own first turns are replaced by those of a conversation that is not there
    ids = [c for c in range(101, 190) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "user", "gone") for c in ids]
    turns = prefix_trie.turns_of(conversations(rows))
    found = prefix_trie.Trie(prefix_trie.with_shared_heads(turns)).report()
    assert sorted(map(tuple, found.collect()), key=str) == _trie(rows)
    assert len(_trie(rows)) == 1
