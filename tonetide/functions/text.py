"""Column helpers for text: tokens, cleaning, weighted word counts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


HIT_UNIT = 1 << 32


def weigh_tokens(words: Column, weights: Mapping[str, int]) -> Column:
    """Weight sum and number of weighted tokens of a token array, in one pass.

    Both are kept in one BIGINT (see ``net_weight`` and ``weighted_tokens``).
    Terms are grouped by weight so a token costs a few hash-set probes and the
    row never leaves its partition: no explode, no shuffle.
    """
    by_weight: dict[int, list[str]] = defaultdict(list)
    for term, weight in weights.items():
        by_weight[weight].append(term)

    def worth(word: Column) -> Column:
        value = F.lit(0).cast("long")
        for weight, terms in sorted(by_weight.items()):
            value = F.when(word.isin(*terms), F.lit(weight + HIT_UNIT)).otherwise(value)
        return value

    return F.aggregate(words, F.lit(0).cast("long"), lambda total, word: total + worth(word))


def weighted_tokens(packed: Column) -> Column:
    """Number of weighted tokens in a ``weigh_tokens`` value (weight sums stay below 2^31)."""
    return F.shiftright(packed + F.lit(HIT_UNIT // 2), 32)


def net_weight(packed: Column) -> Column:
    """Weight sum in a ``weigh_tokens`` value."""
    return packed - F.shiftleft(weighted_tokens(packed), 32)


def count_tokens(words: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """How many tokens belong to ``terms``."""
    return F.size(F.filter(words, lambda t: t.isin(*terms)))


def strip_markup(text: Column) -> Column:
    """Text without tags, URLs, control characters and repeated blanks, lower-cased."""
    no_script = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    no_tags = F.regexp_replace(no_script, r"(?s)<[^>]*>", " ")
    no_urls = F.regexp_replace(no_tags, r"https?://[^\s]+", " ")
    no_control = F.regexp_replace(no_urls, r"[\x00-\x1f\x7f]", " ")
    return F.trim(F.lower(F.regexp_replace(no_control, r" +", " ")))
