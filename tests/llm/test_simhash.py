"""SimHash components against all pairs of fingerprints."""

import pytest
import xxhash
from pyspark.sql import functions as F

from tonetide.llm import simhash
from tonetide.llm.graph import components


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Component by row number."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            least[find(i)] = min(number, least.get(find(i), number))
    return [(n, f"{prints[i]:016x}", least.get(find(i))) for i, (n, _) in enumerate(rows)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_components(spark, table, rough):
    got = simhash.op1_simhash_dedup(spark, table(rough)).collect()
    assert ordered(got) == ordered(brute(rough))


@pytest.mark.parametrize("dense", [0, 2, 64])
def test_dense_keys_keep_all_connections(spark, dense):
    """Fingerprints close to each other, chained, and apart, at every use of midpoints."""
    prints = [0, 7, 7 << 20, 1 << 63, (1 << 63) | 3, (1 << 63) | 63, 2**64 - 1, 2**64 - 8]
    prints += [0x5555 << 16 | 1 << i for i in range(16)] + [0xF0F0 << 40, 0xF0F3 << 40, 0xF0FF << 40]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = components(simhash.links(frame, dense), "a", "b").collect()
    root = {r.node: r.root for r in found}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, a in zip(prints, signed):
        for q, b in zip(prints, signed):
            if (p ^ q).bit_count() <= 3 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: root.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_empty_table(spark, table):
    assert simhash.op1_simhash_dedup(spark, table([])).count() == 0


def test_long_chain_settles(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(edges, "a", "b").where("root = 0").count() == 301
