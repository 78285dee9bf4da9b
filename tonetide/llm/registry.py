"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from tonetide.llm import (
    debruijn,
    decontamination,
    divergence,
    katz,
    mixing,
    pieces,
    prefix_trie,
    quality_model,
    quality_rules,
    simhash,
    suffix_dedup,
    syncmers,
    token_files,
)

QUERIES = [
    simhash.op1_simhash_dedup,
    quality_rules.op2_quality_rules,
    katz.op3_katz_backoff,
    suffix_dedup.op4_suffix_dedup,
    token_files.op5_token_files,
    quality_model.op6_quality_classifier,
    mixing.op7_source_mixing,
    syncmers.op8_syncmer_fingerprints,
    pieces.op9_sentencepiece,
    debruijn.op10_substring_dedup,
    divergence.op11_source_divergence,
    decontamination.op12_decontamination,
    prefix_trie.op13_prefix_trie,
]


def queries():
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express within its time; tests hold the others
    against plain computations."""
    return {
        "op10_substring_dedup": debruijn.ORACLE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL,
        "op12_decontamination": decontamination.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }
