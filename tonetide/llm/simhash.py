"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into four 16-bit segments arranged in a ring. If two fingerprints
differ in at most 3 bits, some segment starts a chain in which the differences of the first
l segments add up to at most 3 * l / 4 for every l: none in the first segment, at most one
in the first two, two in the first three, three in all. So the first two segments make a
32-bit join key (equal, or one bit of the second flipped), and the sums over longer chains
discard candidates before the full Hamming distance would be taken.

Only distinct fingerprints are compared; copies share one. A key shared by more than
``dense`` fingerprints is not paired off. Its members are linked through midpoints instead:
two fingerprints differ in at most 3 bits exactly if some value lies within 1 bit of one and
2 bits of the other, and all fingerprints around one midpoint hang on one of them. That is
linear in the members and keeps every connection.

Defined cases: a null or empty text has fingerprint zero, which links like any other. Repeated
rows share their component. A row without id gets its fingerprint's component but never names
one; a component without any id is null. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonetide.llm.common import documents
from tonetide.llm.graph import components
from tonetide.session import cut_lineage

SEED = 42
DENSE = 64
_BLOCK = 1 << 16


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of one text; bit i is 1 if set in over half of the shingle hashes."""
    words = text.lower().split()  # bytes: exactly A-Z and the six ASCII spaces
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        count = min(_BLOCK, total - at)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(next(shingles), SEED) for _ in range(count)), "<u8", count
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    """SimHash as a signed long."""

    def run(texts: pa.Array) -> pa.Array:
        values = [fingerprint_of(t.as_py() or b"", width) for t in texts]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return arrow_udf(run, "bigint").asNondeterministic()(text.cast("binary"))


def _turned(start: Column) -> Column:
    """The fingerprint read round the ring from segment ``start``."""
    by = (start * 16).cast("int")
    left = F.call_function("shiftleft", F.col("fp"), by)
    right = F.call_function("shiftrightunsigned", F.col("fp"), (F.lit(64) - by).cast("int"))
    return F.when(by == 0, F.col("fp")).otherwise(left.bitwiseOR(right))


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links between fingerprints in column ``fp`` that keep every component whole.

    All pairs within 3 bits are returned, except inside dense keys, where members hang on
    others around a common midpoint.
    """
    ring = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("start"))
    ring = ring.withColumn("turned", _turned(F.col("start")))
    ring = ring.select(
        "fp",
        "start",
        F.shiftrightunsigned("turned", 32).alias("key"),
        F.col("turned").bitwiseAND(0xFFFFFFFF).alias("rest"),
    )
    crowded = ring.groupBy("start", "key").count().where(F.col("count") > dense)
    crowded = cut_lineage(crowded.select("start", "key", F.lit(True).alias("dense")), "dense")
    ring = ring.join(crowded, ["start", "key"], "left").fillna(False, ["dense"])

    # each pair that differs in one bit of the second segment is asked for from the side with 0
    flips = F.filter(
        F.sequence(F.lit(0), F.lit(15)), lambda b: _bit("key", b) == 0
    )
    asks = ring.select(
        F.col("fp").alias("a"),
        "start",
        F.col("rest").alias("rest_a"),
        F.col("dense").alias("dense_a"),
        F.col("key").alias("own"),
        F.explode(
            F.concat(F.array("key"), F.transform(flips, lambda b: F.col("key") + _power(b)))
        ).alias("key"),
    )
    apart = F.col("rest_a").bitwiseXOR(F.col("rest"))
    second = F.when(F.col("own") == F.col("key"), 0).otherwise(1)
    third = second + F.bit_count(F.shiftrightunsigned(apart, 16))
    whole = second + F.bit_count(apart)
    found = asks.join(ring, ["start", "key"]).where(
        (third <= 2)
        & (whole <= 3)
        & ((F.col("own") != F.col("key")) | (F.col("a") < F.col("fp")))
        & ~(F.col("dense_a") & F.col("dense"))
    )
    return found.select("a", F.col("fp").alias("b")).union(_around_midpoints(ring.where("dense")))


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _bit(name: str, bit: Column) -> Column:
    return F.call_function("shiftright", F.col(name), bit).bitwiseAND(1)


def _around_midpoints(members: DataFrame) -> DataFrame:
    """Links among members that share their first segment, through values 1 and 2 bits away.

    The other 48 bits are varied: 1 + 48 values within one bit and 1128 more within two, so
    the work per member is fixed.
    """
    masks = [0] + [1 << i for i in range(48)]
    masks += [(1 << i) | (1 << j) for i in range(48) for j in range(i)]
    segment = F.shiftrightunsigned("key", 16)
    rest = F.call_function("shiftleft", F.col("key").bitwiseAND(0xFFFF), F.lit(32)).bitwiseOR(
        F.col("rest")
    )
    around = members.select(
        "fp",
        "start",
        segment.alias("segment"),
        F.posexplode(
            F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), rest.bitwiseXOR)
        ).alias("nth", "middle"),
    )
    spot = ["start", "segment", "middle"]
    hubs = around.where("nth < 49").groupBy(*spot).agg(F.min("fp").alias("a"))
    return around.join(hubs, spot).where("fp <> a").select("a", F.col("fp").alias("b"))


def near_duplicates(marked: DataFrame, id_col: str = "doc_id", dense: int = DENSE) -> DataFrame:
    """Adds ``component_id`` to a table with column ``fp``: the least id reachable over links.

    ``marked`` is read twice, so hand in a table.
    """
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    distinct = cut_lineage(distinct, "fingerprints")
    roots = components(links(distinct, dense), "a", "b")
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def op1_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marked = cut_lineage(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "simhash")
    return near_duplicates(marked).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
