"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. Nobody knows which rules are right, so
expectation-maximisation estimates, from agreement alone, how often each rule is right
about good and about bad texts; the posterior probability that a text is good replaces
"all rules must pass".

Only the distinct vote patterns matter to the estimate. They are counted by Spark and there
are at most 3 ** (number of rules) of them, whatever the size of the corpus: that small table
is all the driver sees, and all that is joined back.

Defined cases: a null text has no words, fails the base rule and is not kept. Repeated rows
are judged alike. An empty table gives an empty table. Input columns keep their values unless
an output column has the same name, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonetide.llm.common import ROW, SPACE, documents, pack, unpack, word_spans
from tonetide.session import cut_lineage

FACTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_lines bigint, n_distinct bigint, n_upper bigint, "
    "n_lower bigint, n_noisy_ends bigint, n_letter_words bigint"
)
NAMES = [part.split()[0] for part in FACTS.split(", ")]
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 128)
_PLAIN = _LETTER | ((np.arange(256) >= 48) & (np.arange(256) <= 57)) | SPACE
_COUNTED = ((np.arange(256) & 0xC0) != 0x80) & ~SPACE


def facts_of(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``NAMES``."""
    words = text.split()
    if not words:
        return (0, 0, int(_SYMBOL[np.frombuffer(text, np.uint8)].sum())) + (0,) * 8
    data = np.frombuffer(text, np.uint8)
    start, end = word_spans(data)
    letters = np.append(0, np.cumsum(_LETTER[data]))
    odd = ~_PLAIN[data]
    last = end - 1
    noisy = odd[last] & odd[np.maximum(last - 1, 0)] & (end - start > 1)
    lines = [line for line in text.split(b"\n") if line.strip()]

    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(distinct := set(windows)) < len(windows):
        first: dict = {}
        hit = np.zeros(len(words), bool)
        for i, window in enumerate(windows):
            earlier = first.setdefault(window, i)
            if earlier != i:
                hit[i : i + 3] = True
                hit[earlier : earlier + 3] = True
        repeated = int(hit.sum())
    del distinct
    return (
        len(words),
        int(_COUNTED[data].sum()),
        int(_SYMBOL[data].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(set(words)),
        int(_UPPER[data].sum()),
        int(_LOWER[data].sum()),
        int(noisy.sum()),
        int((letters[end] > letters[start]).sum()),
    )


def text_facts(text: Column) -> Column:
    """The counts as a struct. Runs once per row: the filter on it is not pushed below."""

    def facts(texts: pa.Array) -> pa.Array:
        rows = [facts_of(t.as_py() or b"") for t in texts]
        columns = np.array(rows, np.int64).reshape(len(rows), len(NAMES))
        return pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(NAMES))], NAMES
        )

    return arrow_udf(facts, FACTS).asNondeterministic()(text.cast("binary"))


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions on the facts; neither: the rule abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return (
            F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0).cast("tinyint")
        )


RULES = (
    Rule("symbols", "n_symbols > 0.05 * word_chars", "n_symbols < 0.01 * word_chars"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    Rule("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 and n_lines > 2"),
    Rule("capitals", "n_upper > n_lower", "n_upper < 0.15 * n_lower"),
    Rule("endings", "n_noisy_ends > 0.2 * n_words", "n_noisy_ends < 0.03 * n_words"),
    Rule("letters", "n_letter_words < 0.7 * n_words", "n_letter_words > 0.9 * n_words"),
    Rule("variety", "n_distinct < 0.15 * n_words and n_words < 2000", "n_distinct > 0.4 * n_words"),
    Rule(
        "length",
        "word_chars < 2.5 * n_words or word_chars > 14 * n_words",
        "word_chars between 3.5 * n_words and 10 * n_words",
    ),
)
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Estimate:
    """Prior probability of a good text; accuracy of each rule's votes on good and bad texts."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes in {-1, 0, 1}."""
        up, down = votes > 0, votes < 0
        good = np.log(self.prior) + up @ np.log(self.on_good) + down @ np.log(1 - self.on_good)
        bad = np.log(1 - self.prior) + up @ np.log(1 - self.on_bad) + down @ np.log(self.on_bad)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def estimate(
    votes: np.ndarray,
    counts: np.ndarray,
    rounds: int = 200,
    tolerance: float = 1e-9,
    trust: float = 0.0,
    expected: tuple[float, float] = (0.99, 0.4),
) -> Estimate:
    """Expectation-maximisation over vote patterns with their counts.

    Starts from "rules are mostly right and most texts are good"; one pseudo-count on each
    side keeps accuracies inside (0, 1) where a rule never voted. That is all the prior the
    quality rules use: their accuracies come from the data alone. ``trust`` adds, per rule,
    that many times the texts of each class as prior votes, right at the rates ``expected`` on
    good and on bad texts. It is for votes among which plainly bad texts were left in (the
    labellers of the classifier): their kinds are so unlike that some pass for good texts
    with a habit otherwise.
    """
    rules = votes.shape[1]
    now = Estimate(0.8, np.full(rules, 0.9), np.full(rules, 0.6))
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    for _ in range(rounds):
        p = now.posterior(votes)
        good, bad = p * counts, (1 - p) * counts
        after = Estimate(
            float((good.sum() + 1) / (counts.sum() + 2)),
            (good @ up + 1 + trust * expected[0] * good.sum())
            / (good @ (up + down) + 2 + trust * good.sum()),
            (bad @ down + 1 + trust * expected[1] * bad.sum())
            / (bad @ (up + down) + 2 + trust * bad.sum()),
        )
        moved = max(
            abs(after.prior - now.prior),
            np.abs(after.on_good - now.on_good).max(initial=0),
            np.abs(after.on_bad - now.on_bad).max(initial=0),
        )
        now = after
        if moved < tolerance:
            break
    return now


def judge(
    facts: DataFrame,
    rules: Sequence[Rule] = RULES,
    base_failed: str = BASE_FAILED,
    keep_from: float = 0.5,
) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (posterior) and ``kept`` to a frame with the facts.

    ``facts`` is read twice: once for the votes, once for the result. Texts that fail the base
    rule are known bad and do not take part in the estimate.
    """
    spark = facts.sparkSession
    votes = [f"vote_{r.name}" for r in rules]

    def voted(frame: DataFrame) -> DataFrame:
        return frame.withColumn("base_failed", F.expr(base_failed)).withColumns(
            {v: r.vote() for v, r in zip(votes, rules)}
        )

    # at most 3 ** len(rules) rows
    found = voted(facts.select(NAMES)).where("not base_failed").groupBy(*votes).count()
    found = found.orderBy(*votes).collect()
    patterns = np.array([r[:-1] for r in found], np.int8).reshape(-1, len(rules))
    model = estimate(patterns, np.array([r[-1] for r in found], float))
    quality = model.posterior(patterns)
    table = spark.createDataFrame(
        [(*map(int, p), float(q)) for p, q in zip(patterns, quality)],
        ", ".join(f"{v} tinyint" for v in votes) + ", quality double",
    )
    return (
        voted(facts)
        .join(F.broadcast(table), votes, "left")
        .drop(*votes)
        .withColumn("quality", F.when(F.col("base_failed"), 0.0).otherwise(F.col("quality")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    facts = docs.select("doc_id", text_facts(F.col("text")).alias("facts"))
    staged = cut_lineage(facts.select("doc_id", "facts.*"), "quality-facts")
    return judge(staged).select("doc_id", *NAMES[:5], "base_failed", "kept", "quality")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with their columns as they were.

    The counts are worked out twice rather than written with the texts.
    """
    facts = pack(docs, facts=text_facts(docs[text])).select(ROW, "facts.*")
    return unpack(judge(facts).where("kept"))
