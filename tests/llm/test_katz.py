"""The Katz model against a token-by-token computation with dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from tonetide.llm import katz


def tokens(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return words.encode().split() + ["</s>"]


def brute(rows):
    """Model pieces and results by (id, text)."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    ones, twos = Counter(), Counter()
    for i, text in rows:
        if not held(i):
            seq = tokens(text)
            ones.update(seq)
            twos.update(zip(["<s>"] + seq, seq))
    total = sum(ones.values())

    def kept(counts):
        n = [sum(1 for c in counts.values() if c == r) for r in range(1, katz.K + 2)]
        d = katz.discounts(n)
        return lambda c: d[c - 1] * c if c <= katz.K else katz.KEPT_ABOVE * c

    keep1, keep2 = kept(ones), kept(twos)
    unknown = 1 - sum(map(keep1, ones.values())) / total if total else 1.0
    p1 = lambda w: keep1(ones[w]) / total if ones[w] else unknown
    after = defaultdict(dict)
    for (a, b), c in twos.items():
        after[a][b] = c
    alpha = {}
    for a, seen in after.items():
        left = 1 - sum(map(keep2, seen.values())) / sum(seen.values())
        alpha[a] = left / (1 - sum(p1(w) for w in seen))

    def p2(a, w):
        seen = after.get(a)
        if not seen:
            return p1(w)
        return keep2(seen[w]) / sum(seen.values()) if w in seen else alpha[a] * p1(w)

    out = {}
    for i, text in rows:
        seq = tokens(text)
        out[i, text] = (
            held(i),
            len(seq),
            sum(ones[w] > 0 for w in seq),
            total,
            sum(math.log10((ones[w] + 1) / (total + len(ones) + 1)) for w in seq),
            sum(math.log10(p2(a, w)) for a, w in zip(["<s>"] + seq, seq)),
        )
    return out, ones, after, p2


def test_the_brute_model_is_normalised(corpus):
    _, ones, after, p2 = brute(corpus)
    for context in list(after)[:40] + ["never seen"]:
        mass = sum(p2(context, w) for w in [*ones, "an unknown word"])
        assert mass == pytest.approx(1, abs=1e-12)


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, table, rough, monkeypatch, small):
    if small:  # many chunks, buckets and words dealt by pair
        monkeypatch.setattr(katz, "CHUNK_TOKENS", 500)
        monkeypatch.setattr(katz, "BUCKET_TOKENS", 1500)
    expected = {}
    for (i, _), v in brute(rough)[0].items():
        expected.setdefault(i, []).append(v)
    got = katz.op3_katz_backoff(spark, table(rough)).collect()
    assert len(got) == len(rough)
    for row in got:
        values = tuple(row)[1:]
        assert any(values == pytest.approx(e, rel=1e-9) for e in expected[row.doc_id]), row


@pytest.mark.parametrize("small", [False, True])
def test_the_stored_tables_score_other_texts(spark, make, rough, monkeypatch, small):
    """Pairs with their discounted probabilities are a table, and it is enough for new texts."""
    if small:
        monkeypatch.setattr(katz, "CHUNK_TOKENS", 500)
        monkeypatch.setattr(katz, "BUCKET_TOKENS", 1500)
    _, ones, after, p2 = brute(rough)
    model = katz.Model(make(rough))
    stored = sorted((r.n, r.log_p) for r in model.pairs.collect())
    counted = [(c, math.log10(p2(a, w))) for a, seen in after.items() for w, c in seen.items()]
    assert len(stored) == len(counted)
    assert [x for row in stored for x in row] == pytest.approx(
        [x for row in sorted(counted) for x in row], rel=1e-9, abs=1e-12
    )
    # repeated rows, a word training has not, a known word after it, unseen pairs, no words
    new = [(1, "unheard of"), (1, "unheard of"), (2, None), (None, rough[3][1])]
    new += [(i, " ".join(reversed((t or "").split()))) for i, t in rough[:40]]
    got = sorted(map(tuple, model.score(make(new)).collect()), key=str)
    want = []
    for i, text in new:
        seq = tokens(text)
        score = sum(math.log10(p2(a, w)) for a, w in zip(["<s>"] + seq, seq))
        want.append((i, len(seq), sum(ones[w] > 0 for w in seq), score))
    for g, e in zip(got, sorted(want, key=str), strict=True):
        assert g[:3] == e[:3] and g[3] == pytest.approx(e[3], rel=1e-9)


def test_held_out_texts_are_predicted_better_than_by_single_words(spark):
    got = katz.op3_katz_backoff(spark, "/root/testdata/sf0.01").where("held_out")
    score, base = got.selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base


def test_empty_table(spark, table):
    assert katz.op3_katz_backoff(spark, table([])).count() == 0


def test_discounts_are_proper():
    assert katz.discounts([0] * 6) == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 4.5 / 5]
    for n in ([100, 40, 20, 10, 6, 4], [5, 9, 1, 0, 0, 3], [7, 0, 0, 0, 0, 0]):
        assert all(0 < d < 1 for d in katz.discounts(n))
