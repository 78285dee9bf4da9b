"""Document fingerprints from closed syncmers, in DataFrame functions only.

The letters are words. A k-mer is 5 consecutive words and its inner s-mers are the 4 pairs of
neighbouring words. The k-mer is a closed syncmer if its least s-mer hash is the first or the
last of the four. That depends on nothing outside the k-mer, so an edit changes only anchors
it touches, and two texts that share a passage share its anchors at the same distances. Half
of all k-mers are chosen on average, and never fewer than one in any 3 consecutive ones.

A fingerprint is the 64 least distinct anchor hashes of a text, 8 hexadecimal digits each. The
likeness of two fingerprints is the share of the 64 least of their union that both have: an
estimate of the Jaccard similarity of the anchor sets, exact for texts with up to 64 anchors
together.

Defined cases: a null text is an empty one and has the empty fingerprint. A text in which no
k-mer is chosen (fewer than five words, mostly) has the hash of its whole word sequence as the
only anchor. Equal fingerprints have likeness 1, an empty one and any other 0. Rows with equal
ids follow each other in the order of a hash of the text; rows without id come last. A table
of one row is followed by itself; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetide.functions.stage import with_once
from tonetide.llm.common import documents

K = 5
SKETCH = 64
#: Rows of one window group when neighbours are looked up; ids are taken to be evenly spread.
BUCKET_ROWS = 2_000
_GAPS = " \t\n\x0b\f\r"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the anchors of a text: array of (word number, hash), in text order.

    Each step is a column of its own that is worked out once per row; ``_words`` and the like
    are dropped again.
    """
    trimmed = F.trim(F.col(text), F.lit(_GAPS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")
    )
    df = with_once(df, {"_words": words})
    df = with_once(df, {"_codes": F.transform("_words", lambda w: F.xxhash64(w))})
    pairs = F.size("_codes") - 1
    inner = F.when(
        pairs > 0,
        F.zip_with(
            F.slice("_codes", 1, pairs), F.slice("_codes", 2, pairs), lambda a, b: F.xxhash64(a, b)
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = with_once(df, {"_inner": inner})
    at = lambda i, step: F.get("_inner", i + step)
    edge = lambda i: F.least(at(i, 0), at(i, K - 2))
    between = lambda i: F.least(*[at(i, j) for j in range(1, K - 2)])
    last = F.size("_inner") - (K - 1)
    chosen = F.when(
        last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: edge(i) <= between(i))
    ).otherwise(F.array().cast("array<int>"))
    df = with_once(df, {"_chosen": chosen})
    short = lambda h: F.shiftright(h, 32).cast("int")
    anchors = F.transform(
        "_chosen",
        lambda i: F.struct(
            i.alias("at"), short(F.xxhash64(*[at(i, j) for j in range(K - 1)])).alias("hash")
        ),
    )
    whole = F.array(
        F.struct(F.lit(0).alias("at"), short(F.xxhash64(F.concat_ws(" ", "_words"))).alias("hash"))
    )
    found = (
        F.when(F.size("_chosen") > 0, anchors)
        .when(F.size("_words") > 0, whole)
        .otherwise(F.array().cast("array<struct<at:int,hash:int>>"))
    )
    return with_once(df, {out: found}).drop("_words", "_codes", "_inner", "_chosen")


def sketch(anchors: Column) -> Column:
    """The least distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(anchors["hash"])), 1, SKETCH)


def fingerprint(values: Column) -> Column:
    digits = lambda h: F.lpad(F.right(F.hex(h.cast("bigint")), F.lit(8)), 8, "0")
    return F.lower(F.array_join(F.transform(values, digits), ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(a == b, 1.0).otherwise(shared / F.size(least))


def matches(a: DataFrame, b: DataFrame, id_col: str, text: str) -> DataFrame:
    """Positional matching of two tables of texts: (id_a, id_b, shift, anchors).

    One row per pair of texts and distance between equal anchors; many anchors at one shift
    mean a shared passage. Anchors that many texts share make many pairs: meant for queries
    against a table, not for a table against itself.
    """
    side = lambda df, name: with_anchors(
        df.select(F.col(id_col).alias(f"id_{name}"), F.coalesce(text, F.lit("")).alias("_text")),
        "_text",
        "_anchors",
    ).select(f"id_{name}", F.inline("_anchors").alias(f"at_{name}", "hash"))
    return (
        side(a, "a")
        .join(side(b, "b"), "hash")
        .groupBy("id_a", "id_b", (F.col("at_b") - F.col("at_a")).alias("shift"))
        .agg(F.count("*").alias("anchors"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): the next row by descending id, the first
    after the last.

    Rows are dealt by ranges of ids, so the texts move once. Only the first text of each range
    is also handed to the range before it; the list of ranges is one row per
    ``BUCKET_ROWS`` documents.
    """
    size = docs.agg(F.count("id"), F.min("id"), F.max("id")).first()
    count, low, high = (x or 0 for x in size)
    width = max(1, -(-(high - low + 1) // max(1, -(-count // BUCKET_ROWS))))
    ranged = docs.withColumns(
        {
            "bucket": F.coalesce(F.floor((F.col("id") - low) / width), F.lit(-1)),
            "mark": F.xxhash64("text"),
        }
    )
    heads = ranged.groupBy("bucket").agg(
        # the first row in falling order of id, then rising order of mark
        F.max_by("text", F.struct("id", F.bitwise_not("mark"))).alias("text")
    )
    return _neighbours(ranged, heads)


def _neighbours(ranged: DataFrame, heads: DataFrame) -> DataFrame:
    falling = Window.orderBy(F.desc("bucket"))
    everything = Window.partitionBy()
    before = F.coalesce(F.lag("bucket").over(falling), F.min("bucket").over(everything))
    guests = heads.withColumn("before", before).select(
        F.lit(None).cast("bigint").alias("id"),
        "text",
        F.col("before").alias("bucket"),
        F.lit(None).cast("bigint").alias("mark"),
        F.lit(1).alias("guest"),
    )
    rows = ranged.select("id", "text", "bucket", "mark", F.lit(0).alias("guest")).union(guests)
    rows = with_anchors(rows, "text", "_anchors")
    rows = with_once(rows, {"sketch": sketch(F.col("_anchors"))}).drop("_anchors")
    order = Window.partitionBy("bucket").orderBy(
        "guest", F.desc_nulls_last("id"), F.asc_nulls_last("mark")
    )
    return (
        rows.withColumns(
            {
                "next_text": F.lead("text").over(order),
                "next_sketch": F.lead("sketch").over(order),
            }
        )
        .where("guest = 0")
        .select("id", "text", "sketch", "next_text", "next_sketch")
    )


def op8_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - cut),
        F.substring("next_text", F.lit(1), cut),
    )
    rows = with_once(rows, {"edited": edited}).drop("next_text", "text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_anchors(rows, "edited", "_anchors")
    rows = with_once(rows, {"edited_sketch": sketch(F.col("_anchors"))})
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
