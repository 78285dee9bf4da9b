"""A quality classifier trained on weak labels.

Overlapping heuristic labellers vote on every text; expectation-maximisation over their vote
patterns estimates how accurate each one is, and the posterior is a soft label. A linear
scorer over hashed features learns these labels from a sample of at most ``sample_rows``
texts on average (a parameter; texts are chosen by a hash, so the sample is the same on every
run), and then scores all texts. It generalises from what labellers agree on to what they
abstain from.

Features share one table of 2 ** 16 weights: words in lower case, shapes of words (letters,
capitals, digits and signs, repeats squeezed), and ranges of the text's ratios. Words and
shapes count by their share of the text, so long and short texts are on one scale.

Defined cases: a null or empty text has no words, gets score 0 and is not kept. Repeated rows
get the same score. An empty table gives an empty table. If the sample holds one class only,
the scorer follows the prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonetide.llm.common import ROW, documents, mixed, pack, unpack, word_hashes, word_spans
from tonetide.llm.quality_rules import NAMES, RULES, Rule, estimate, facts_of
from tonetide.session import cut_lineage

BITS = 16
SAMPLE_ROWS = 10_000
#: The quality rules, but repeated lines and words only count against a text if most repeat.
LABELLERS = tuple(
    {
        "lines": Rule("lines", "n_dup_lines > 0.5 * n_lines", "n_dup_lines = 0 and n_lines > 2"),
        "repeats": Rule(
            "repeats", "n_repeat_words > 0.5 * n_words", "n_repeat_words < 0.1 * n_words"
        ),
    }.get(rule.name, rule)
    for rule in RULES
)
#: Ratios of the facts, as numerator and denominator.
RATIOS = (
    ("n_symbols", "word_chars"),
    ("n_dup_lines", "n_lines"),
    ("n_repeat_words", "n_words"),
    ("n_distinct", "n_words"),
    ("n_upper", "word_chars"),
    ("n_noisy_ends", "n_words"),
    ("n_letter_words", "n_words"),
)
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[48:58] = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _slots(data: np.ndarray, salt: int) -> np.ndarray:
    h = mixed(word_hashes(data, *word_spans(data)) + np.uint64(salt))
    return (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def slots_of(text: bytes, facts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of one text, and their weights."""
    data = np.frombuffer(text, np.uint8)
    kinds = _KIND[data]
    shapes = kinds[np.append(True, kinds[1:] != kinds[:-1])]
    words, forms = _slots(_LOWER[data], 1), _slots(shapes, 2)
    named = dict(zip(NAMES, facts))
    ranges = np.array(
        [min(20, 20 * named[a] // max(1, named[b])) + 32 * i for i, (a, b) in enumerate(RATIOS)],
        np.uint64,
    )
    ranges = (mixed(ranges + np.uint64(1 << 40)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    slots = np.concatenate([words, forms, ranges])
    weights = np.concatenate(
        [
            np.full(len(words), 1 / max(1, len(words))),
            np.full(len(forms), 2 / max(1, len(forms))),
            np.full(len(ranges), 1 / len(RATIOS)),
        ]
    )
    return slots, weights


FACTS = ", ".join(f"{n} bigint" for n in NAMES) + ", slots binary, weights binary"


def _facts(text: Column, chosen: Column) -> Column:
    """The counts of a text and, if it is in the sample, its features."""

    def run(texts: pa.Array, samples: pa.Array) -> pa.Array:
        rows = []
        for t, sampled in zip(texts, samples.to_pylist()):
            raw = t.as_py() or b""
            facts = facts_of(raw)
            blobs = (None, None)
            if sampled and facts[0]:
                slots, weights = slots_of(raw, facts)
                slots, place = np.unique(slots, return_inverse=True)
                sums = np.bincount(place, weights)
                blobs = (slots.astype("<i4").tobytes(), sums.astype("<f4").tobytes())
            rows.append(facts + blobs)
        columns = list(zip(*rows)) or [()] * (len(NAMES) + 2)
        kinds = [pa.int64()] * len(NAMES) + [pa.binary()] * 2
        names = NAMES + ["slots", "weights"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return arrow_udf(run, FACTS).asNondeterministic()(text.cast("binary"), chosen)


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, slots: np.ndarray, weights: np.ndarray) -> float:
        z = self.bias + float(self.weights[slots] @ weights)
        return 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    rounds: int = 150,
    rate: float = 0.5,
    decay: float = 1e-5,
) -> Scorer:
    """Logistic regression on soft labels, both classes weighing the same (Adam, full batch)."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if not len(rows):
        return Scorer(weights, bias)
    slot = np.concatenate([s for s, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(float)
    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    good, bad = labels.sum(), (1 - labels).sum()
    if min(good, bad) < 1:
        return Scorer(weights, float(np.log((good + 1) / (bad + 1))))
    importance = labels / good + (1 - labels) / bad
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(owner, weights[slot] * value, len(rows))
        error = importance * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        slope = np.bincount(slot, error[owner] * value, len(weights)) + decay * weights
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        weights -= move[:-1]
        bias -= float(move[-1])
    return Scorer(weights, bias)


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Labels from all texts' votes, weights from the sample."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    point = F.pmod(F.xxhash64(docs[text], F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    facts = docs.select(_facts(docs[text], point < share).alias("facts")).select("facts.*")
    staged = cut_lineage(facts.where("n_words > 0"), "weak-labels")
    votes = [f"vote_{r.name}" for r in LABELLERS]
    voted = staged.withColumns({v: r.vote() for v, r in zip(votes, LABELLERS)})
    # at most 3 ** len(LABELLERS) rows
    found = voted.groupBy(*votes).count().orderBy(*votes).collect()
    patterns = np.array([r[:-1] for r in found], np.int8).reshape(-1, len(votes))
    model = estimate(patterns, np.array([r[-1] for r in found], float), trust=1.0)
    # the sample, whose size is a parameter
    sample = voted.where("slots is not null").select(*votes, "slots", "weights").toArrow()
    # rows come in any order; sums of floats shall not depend on it
    sample = sample.sort_by([(c, "ascending") for c in ("slots", "weights", *votes)])
    seen = np.column_stack([sample[v].to_numpy() for v in votes]).reshape(-1, len(votes))
    rows = [
        (np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(w, "<f4"))
        for s, w in zip(sample["slots"].to_pylist(), sample["weights"].to_pylist())
    ]
    return train(rows, model.posterior(seen))


def scores(text: Column, scorer: Scorer) -> Column:
    """Probability that a text is good."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            raw = t.as_py() or b""
            facts = facts_of(raw)
            out.append(scorer.score(*slots_of(raw, facts)) if facts[0] else 0.0)
        return pa.array(out, pa.float64())

    return arrow_udf(run, "double").asNondeterministic()(text.cast("binary"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scorer = fit(docs.select("text"))
    return docs.select("doc_id", scores(F.col("text"), scorer).alias("score")).withColumn(
        "kept", F.col("score") >= 0.5
    )


def keep_good(docs: DataFrame, text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a good score, with their columns as they were."""
    scorer = fit(docs.select(docs[text].alias("text")))
    packed = pack(docs, score=scores(docs[text], scorer))
    return unpack(packed.where(F.col("score") >= keep_from).select(ROW))
