"""Benchmark decontamination by a generalised suffix automaton of the test items.

Test items and texts are normalised alike (A-Z lower-cased, words of letters, digits and signs
outside ASCII). The automaton of all items is built once per worker; the words of each text
stream through it, and at each word it knows the longest run up to there that some item has.
Where that run holds a window (ten consecutive words of an item, or the whole of a shorter item),
the window's words are hit. Words and word pairs that no item has cannot lie in a window, so the
automaton starts again behind them.

Items are dealt into blocks of bounded size by a hash of their segments (consecutive segments
overlap by a window less one word, so no window is lost). A block is what travels to the tasks,
one at a time; the usual benchmark is one block, and texts are then read once and not moved. With
several blocks each one passes over the texts, and what it found is joined by two hashes of the text.

Defined cases: a null or empty text has no words and no hits; an item without words has no
window. Items that share an id are one item. An item without id is looked for like any other but
cannot be named. Repeated rows are treated alike. Without items nothing is hit; an empty table
gives an empty table. Words are compared as bytes, those over 64 bytes by SHA-256.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetide.llm.automaton import Automaton, short_word
from tonetide.llm.common import ROW, documents, pack, pieces, unpack
from tonetide.llm.copies import marks
from tonetide.session import cut_lineage

WINDOW = 10
SEGMENT = 2_000
#: Normalised bytes of items in a block; its automaton takes some hundred times as much.
BLOCK_BYTES = 1 << 20

#: Bytes of words: digits, letters with A-Z lower-cased, everything outside ASCII.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
FOUND = "n_words bigint, spans array<struct<at:bigint,words:bigint>>, items array<string>"
_FOUND_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes of the text."""
    plain = np.frombuffer(text.translate(_WORDS), np.uint8) != 32
    step = np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _segments(window: int, size: int):
    def run(batches):
        for batch in batches:
            names, parts, lists, sizes = [], [], [], []
            for name, text in zip(batch["item"].to_pylist(), batch["text"]):
                words = [short_word(w) for w in words_of(text.as_py())]
                last = max(len(words) - window + 1, 1)
                for number, at in enumerate(range(0, last if words else 0, size)):
                    part = words[at : at + size + window - 1]
                    names.append(name)
                    parts.append(number)
                    lists.append(part)
                    sizes.append(sum(map(len, part)) + len(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(parts, pa.int64()),
                    pa.array(lists, pa.list_(pa.binary())),
                    pa.array(sizes, pa.int64()),
                ],
                ["item", "part", "words", "size"],
            )

    return run


_BUILT: dict[str, Automaton] = {}


class Block:
    """The automaton of a bounded set of segments; each worker builds it when it first needs it."""

    def __init__(self, rows: pa.Table, window: int, spark):
        self.names = rows["item"].unique().to_pylist()
        number = {n: i for i, n in enumerate(self.names)}
        sequences = [
            (number[n], w) for n, w in zip(rows["item"].to_pylist(), rows["words"].to_pylist())
        ]
        self.window = window
        self.sent = spark.sparkContext.broadcast(sequences)
        self.key = uuid.uuid4().hex

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit ranges of words, names of the items met."""
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = Automaton(self.sent.value, self.window)
        words = words_of(text)
        spans, labels = _BUILT[self.key].matches(words)
        return len(words), spans, [n for n in (self.names[i] for i in labels) if n is not None]


def item_blocks(
    items: DataFrame,
    item: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
):
    """The items in blocks of about ``block_bytes``, one after another."""
    spark = items.sparkSession
    texts = items.select(
        items[item].cast("string").alias("item"),
        F.coalesce(items[text].cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    schema = "item string, part bigint, words array<binary>, size bigint"
    # equal segments of one item are one
    found = cut_lineage(
        texts.mapInArrow(_segments(window, SEGMENT), schema).distinct(), "segments"
    )
    total = found.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    dealt = F.pmod(F.xxhash64("item", "part"), F.lit(count))
    for number in range(count):
        rows = found.where(dealt == number) if count > 1 else found
        yield Block(rows.select("item", "words").toArrow(), window, spark)


def _scan(texts: DataFrame, block: Block, only_hits: bool) -> DataFrame:
    """``texts`` with ``found`` in place of ``text``."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                rows, which = [], []
                for i, t in enumerate(part["text"]):
                    n, spans, names = block.find(t.as_py() or b"")
                    if spans or not only_hits:
                        which.append(i)
                        cuts = [{"at": a, "words": b - a} for a, b in spans]
                        rows.append({"n_words": n, "spans": cuts, "items": names})
                if rows:
                    some = part.select(kept).take(pa.array(which))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array(rows, _FOUND_TYPE)], [*kept, "found"]
                    )

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"]
    return texts.mapInArrow(run, ", ".join([*fields, f"found struct<{_as_struct(FOUND)}>"]))


def _as_struct(fields: str) -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in fields.split(", "))


def _union_of(spans: Column) -> Column:
    """Overlapping and touching ranges as one, ascending."""
    empty = F.array().cast("array<struct<at:bigint,words:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        end = last["at"] + last["words"]
        joined = F.struct(
            last["at"].alias("at"),
            (F.greatest(end, s["at"] + s["words"]) - last["at"]).alias("words"),
        )
        apart = (F.size(done) == 0) | (s["at"] > end)
        return F.when(F.size(done) == 0, F.array(s)).when(apart, F.concat(done, F.array(s))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


class Leaks:
    """Where texts hold windows of test items: ``rows`` with ``n_words``, ``spans`` (at, words)
    and ``items`` (names, ascending) beside the packed document."""

    def __init__(
        self,
        docs: DataFrame,
        items: DataFrame,
        text: str = "text",
        item: str = "item_id",
        item_text: str = "text",
        window: int = WINDOW,
        block_bytes: int = BLOCK_BYTES,
    ):
        whole = F.coalesce(docs[text].cast("string"), F.lit(""))
        blocks = item_blocks(items, item, item_text, window, block_bytes)
        first = next(blocks)
        second = next(blocks, None)
        if second is None:
            found = _scan(pack(docs, text=whole.cast("binary")), first, False)
            found = found.select(ROW, "found.*")
        else:
            found = self._by_blocks(docs, whole, first, second, blocks)
        self.rows = found.withColumn("items", F.array_sort("items"))

    @staticmethod
    def _by_blocks(docs, whole, first, second, others) -> DataFrame:
        mark, mark2 = marks(whole)
        texts = docs.select(mark.alias("mark"), mark2.alias("mark2"), whole.cast("binary").alias("text"))
        parts = []
        for block in (first, second, *others):
            parts.append(cut_lineage(_scan(texts, block, True).distinct(), "leaks"))
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.union(part)
        by_text = merged.groupBy("mark", "mark2").agg(
            F.max("found.n_words").alias("n"),
            _union_of(F.flatten(F.collect_list("found.spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("found.items"))).alias("items"),
        )
        packed = pack(docs, mark=mark, mark2=mark2, n_words=_word_count(whole))
        joined = packed.join(by_text, ["mark", "mark2"], "left")
        none = F.array()
        return joined.select(
            ROW,
            "n_words",
            F.coalesce("spans", none.cast("array<struct<at:bigint,words:bigint>>")).alias("spans"),
            F.coalesce("items", none.cast("array<string>")).alias("items"),
        )


def _word_count(text: Column) -> Column:
    plain = F.regexp_replace(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "a")
    return F.length(F.translate(plain, "".join(chr(c) for c in range(128) if c != 97), "")).cast("bigint")


def _hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    min_words: int = WINDOW,
    max_share: float = 0.5,
    **options,
) -> DataFrame:
    """``docs`` without hit ranges of ``min_words`` words or more, from their first word's start
    to their last word's end; texts that are hit in more than ``max_share`` of their words go."""

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts, spans):
            raw, cuts = t.as_py(), [s for s in found.as_py() if s["words"] >= min_words]
            if raw is not None and cuts:
                lo, hi = word_bounds(raw)
                kept, at = [], 0
                for s in cuts:
                    kept.append(raw[at : lo[s["at"]]])
                    at = hi[s["at"] + s["words"] - 1]
                raw = b"".join([*kept, raw[at:]])
            out.append(None if raw is None else raw.decode())
        return pa.array(out, pa.string())

    found = Leaks(docs, items, text, **options).rows
    found = found.where(_hit() <= F.col("n_words") * F.lit(max_share))
    cutting = F.arrow_udf(cut, "string")(F.col(ROW)[text].cast("binary"), F.col("spans"))
    cleaned = unpack(found, **{text: cutting.cast(docs.schema[text].dataType)})
    return cleaned.select(*[f"`{c}`" for c in docs.columns])


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = Leaks(documents(spark, sf_dir).select("doc_id", "text"), items)
    return leaks.rows.select(
        F.col(ROW)["doc_id"].alias("doc_id"),
        "n_words",
        _hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id::varchar AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, size, array_to_string(words[pos:pos + size - 1], ' ') AS run
  FROM (SELECT item, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos
    FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT d, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS run
  FROM (SELECT d, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM docs, sizes WHERE len(words) >= size)),
found AS (SELECT d, pos, size, item FROM places JOIN windows USING (size, run)),
hits AS (
  SELECT d, count(*) AS n FROM (SELECT DISTINCT d, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY d),
named AS (
  SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT d, item FROM found WHERE item IS NOT NULL) GROUP BY d)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (d) LEFT JOIN named USING (d)
"""
