"""Near copies of the pipeline against all pairs; the hash of words."""

import itertools
import random

import numpy as np
import pytest

from tonetide.llm import common, debruijn, katz, near_copies


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return set(runs)


def stays_of(rows, similarity=0.8):
    """The rows that stay: of each group of similar texts the least (id, hash of the text)."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, u) in itertools.combinations(zip(texts, sets), 2):
        both = len(s & u)
        if both and both >= similarity * (len(s) + len(u) - both):
            root[find(a)] = find(b)
    groups = {}
    for i, t in rows:
        groups.setdefault(find(t or ""), []).append((i is None, i or 0, t or "", (i, t)))
    return [min(g)[-1] for g in groups.values()]


def kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_one_of_each_group_stays(make, rough):
    docs = make(rough)
    found = near_copies.keep_one(docs)
    assert found.columns == docs.columns
    assert kept(found) == sorted(stays_of(rough), key=str)
    assert near_copies.keep_one(make([])).count() == 0


def test_unlike_texts_of_one_id_are_judged_apart(make):
    a, b = "the first text has its own words here", "another one that is nothing like it at all"
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, "no id at all"), (None, "no id at all")]
    assert kept(near_copies.keep_one(make(rows))) == sorted(
        [(1, a), (1, b), (None, "no id at all")], key=str
    )


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_similarities_around_the_threshold(make, similarity):
    """Copies with words changed, from nearly equal to well below the threshold."""
    rng = random.Random(17)
    rows, number = [], 0
    for _ in range(40):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.randint(60, 200))]
        rows.append((number, " ".join(words)))
        for share in (0.002, 0.01, 0.02, 0.03, 0.05):
            changed = [w if rng.random() > share else w[::-1] + "x" for w in words]
            number += 1
            rows.append((number, " ".join(changed)))
        number += 1
    found = kept(near_copies.keep_one(make(rows), similarity=similarity))
    want = stays_of(rows, similarity)
    # links are verified, so nothing goes that must stay; of links at most a tenth may be missed
    assert {i for i, _ in want} <= {i for i, _ in found}
    assert len(rows) - len(found) >= 0.95 * (len(rows) - len(want)) > 0


def test_fingerprints_are_simhash():
    """Bits by majority, one at a time; segments hold the bits they name, each once a round."""
    shingles = near_copies.shingle_set(" ".join(f"w{i * i % 911}" for i in range(700)).encode())
    assert len(shingles) > 2 * near_copies._STEP
    for some in (shingles, shingles[:1], shingles[:6]):
        words = near_copies.fingerprint(some)
        for j, word in enumerate(words.tolist()):
            h = common.mixed(some * near_copies._TIMES[j] + near_copies._PLUS[j]).tolist()
            for bit in range(64):
                assert (word >> bit & 1) == (2 * sum(x >> bit & 1 for x in h) > len(h))
    bits_of = near_copies.segments(5000, 0.8)
    keys = near_copies.segment_keys(words[None], bits_of)[0].tolist()
    assert len(set(keys)) == len(bits_of) >= near_copies.BANDS
    for number, (key, bits) in enumerate(zip(keys, bits_of.tolist())):
        want = number
        for bit in bits:
            want = 2 * want + (words[bit // 64].item() >> bit % 64 & 1)
        assert key == want and len(set(bits)) == len(bits)


def test_similar_sets_share_segments_and_unlike_ones_do_not():
    """At 0.8 nine of ten pairs share a segment and lie within the radius, as derived."""
    rng = np.random.default_rng(3)
    bits_of = near_copies.segments(200_000, 0.8)
    found = {}
    for share in (0.8, 0.9, 0.0):
        hits = 0
        for _ in range(300):
            both = round(270 * 2 * share / (1 + share))
            pool = rng.integers(0, 1 << 63, 540, dtype=np.uint64)
            a, b = pool[:270], np.append(pool[:both], pool[270 : 540 - both])
            words = np.array([near_copies.fingerprint(a), near_copies.fingerprint(b)])
            keys = near_copies.segment_keys(words, bits_of)
            apart = (words[0, -1] ^ words[1, -1]).item().bit_count()
            hits += bool((keys[0] == keys[1]).any()) and apart <= near_copies.RADIUS
        found[share] = hits / 300
    assert found[0.8] >= 0.9 and found[0.9] >= 0.99 and found[0.0] == 0, found


def test_a_large_group_costs_two_comparisons_per_member_and_band(spark):
    keys = [list(range(near_copies.BANDS)) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(keys)), "mark bigint, keys array<bigint>")
    pairs = near_copies.candidates(frame).collect()
    assert len(pairs) == 2 * 500 - 3 and all(r.a == 0 or r.b == 499 for r in pairs)


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bits[:n]


@pytest.mark.parametrize("n", [8, 64, 256, 1024, 4096])
def test_complementary_words_have_hashes_of_their_own(n):
    one = "".join("ab"[b] for b in thue_morse(n)).encode()
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    words = [one, other, one[:-1], one + b"a", b"a", b"b", "größer".encode()] * 2
    data = np.frombuffer(b" ".join(words), np.uint8)
    spans = common.word_spans(data)
    assert [data[a:b].tobytes() for a, b in zip(*spans)] == words
    for seed in (0, 1):
        h = common.word_hashes(data, *spans, seed).tolist()
        assert h[:7] == h[7:] and len(set(h)) == 7
    assert not set(h) & set(common.word_hashes(data, *spans, 0).tolist())


def test_complementary_words_stay_apart_in_windows_and_counts(spark, table):
    one = "".join("ab"[b] for b in thue_morse(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    lead = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{lead} {w}") for i, w in ((1, one), (2, other), (3, one))]
    cut = {r.doc_id: r.n_removed for r in debruijn.op10_substring_dedup(spark, table(rows)).collect()}
    assert cut == {1: 0, 2: 0, 3: 13}
    # unseen in training, the word is unknown although its complement is known
    held_out = next(i for i in range(10, 99) if katz_held_out(i))
    train = [i for i in range(100, 140) if not katz_held_out(i)][:3]
    known = [(i, f"{one} end") for i in train] + [(held_out, f"{other} end")]
    scored = {r.doc_id: r for r in katz.op3_katz_backoff(spark, table(known)).collect()}
    assert scored[held_out].n_known == 2 and scored[held_out].n_tokens == 3


def katz_held_out(number):
    import zlib

    return zlib.crc32(str(number).encode()) % 7 == 2
