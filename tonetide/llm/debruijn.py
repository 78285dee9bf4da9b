"""Substring dedup by De Bruijn compaction.

Every window of 13 consecutive words is an edge between its first and its last 12 words. An
edge that also starts in a document with a smaller id is repeated; the least place where it
starts is its source. Walking a document along its repeated edges, a stretch is nonbranching
as long as the source walk goes on in step: such a stretch is compacted into one path
(document, first word, edges, source document, source word), and all words of it are removed.

Windows are compared by two hashes of their words' bytes with different seeds, 95 bits together. To keep unrepeated windows
from moving at all, a window is first represented by the least hash of its inner 5-word
grams, which neighbouring windows mostly share. Only windows whose representative occurs in
two documents are turned into edges; a bitmap of fixed size tells the tasks which these are
(it can only err towards more work). Edges repeated inside one task's slice are decided
there, so a passage that very many documents share crosses the shuffle once per slice, not
once per document. Exact copies are recognised as a whole and only the first one is walked.

Defined cases: a null or empty text has no words. A document without id is kept whole and is
no source. Rows with the same id are never each other's source. Texts shorter than a window
are kept whole. Repeated rows are cut alike. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonetide.llm.bitmap import LOG2_BITS, Bitmap
from tonetide.llm.common import (
    by_batch,
    documents,
    gram_hashes,
    merged,
    mixed,
    runs_of,
    signed,
    sliding_min,
    word_hashes,
    word_spans,
)
from tonetide.llm.copies import Copies
from tonetide.session import cut_lineage

WINDOW = 13
GRAM = 5
#: A place is the low 23 bits of the text's mark (tells apart rows of one id) and a word number.
PLACE_BITS = 40
TAG = (1 << 23) - 1


def _hashed(text: bytes, seed: int = 0) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return word_hashes(data, *word_spans(data), seed)


def _representatives(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window, the least hash of its inner grams: equal windows have equal ones."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    return sliding_min(gram_hashes(words, gram), window - gram + 1)


def _texts(batch: pa.RecordBatch):
    return zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["mark"].to_pylist())


def shared_grams(firsts: DataFrame, window: int, gram: int, bits: int) -> Bitmap:
    """Representatives that occur in at least two documents."""

    def work(batch):
        hashes, ids = [], []
        for number, text, _ in _texts(batch):
            found = _representatives(_hashed(text), window, gram)
            if len(found):
                hashes.append(np.unique(found[runs_of(found)[0]]))
                ids.append(np.full(len(hashes[-1]), number, np.int64))
        if not hashes:
            return None
        h, number = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((number, h))
        h, number = h[order], number[order]
        lo, hi = runs_of(h)
        return pa.RecordBatch.from_arrays(
            [signed(h[lo]), pa.array(number[lo]), pa.array(number[hi])], ["h", "least", "most"]
        )

    rows = by_batch(_bytes(firsts), work, "h bigint, least bigint, most bigint")
    shared = (
        rows.groupBy("h")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"))
        .where("least < most")
    )
    return Bitmap(shared, "h", bits)


def _bytes(firsts: DataFrame) -> DataFrame:
    return firsts.select("id", F.col("text").cast("binary").alias("text"), "mark")


EDGES = "h bigint, extra int, id bigint, place bigint, edges int, from_id bigint, from_place bigint"


def edges(firsts: DataFrame, grams: Bitmap, window: int, gram: int) -> DataFrame:
    """Candidate edges (``edges`` 0), and paths that a slice could decide alone (more)."""

    def work(batch):
        h, extra, ids, places = [], [], [], []
        for number, text, mark in _texts(batch):
            words = _hashed(text)
            found = _representatives(words, window, gram)
            at = np.flatnonzero(grams.holds(found)) if len(found) else ()
            if not len(at):
                continue
            h.append(gram_hashes(words, window)[at])
            extra.append(gram_hashes(_hashed(text, 1), window)[at] >> np.uint64(33))
            ids.append(np.full(len(at), number, np.int64))
            places.append(at + ((mark & TAG) << PLACE_BITS))
        if not h:
            return None
        return _decided(*map(np.concatenate, (h, extra, ids, places)))

    return by_batch(_bytes(firsts), work, EDGES)


def _decided(h, extra, ids, places) -> pa.RecordBatch:
    """Edges with an earlier document in the same slice become paths; the rest stay edges."""
    order = np.lexsort((places, ids, extra, h))
    h, extra, ids, places = h[order], extra[order], ids[order], places[order]
    first = np.append(True, (h[1:] != h[:-1]) | (extra[1:] != extra[:-1]))
    source = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    known = ids[source] < ids
    open_ = ~known
    # paths: in document order, cut where place or source does not go on by one
    i, p, fi, fp = ids[known], places[known], ids[source][known], places[source][known]
    order = np.lexsort((p, i))
    i, p, fi, fp = i[order], p[order], fi[order], fp[order]
    on = (i[1:] == i[:-1]) & (p[1:] == p[:-1] + 1) & (fi[1:] == fi[:-1]) & (fp[1:] == fp[:-1] + 1)
    lo = np.flatnonzero(np.append(True, ~on)) if len(i) else np.empty(0, np.int64)
    size = np.diff(np.append(lo, len(i)))
    n = int(open_.sum())
    spread = mixed(p[lo].astype(np.uint64) ^ mixed(i[lo].astype(np.uint64)))
    zero = np.zeros(n, np.int64)
    columns = [
        signed(np.concatenate([h[open_], spread])),
        pa.array(np.concatenate([extra[open_].astype(np.int32), np.full(len(lo), -1, np.int32)])),
        pa.array(np.concatenate([ids[open_], i[lo]])),
        pa.array(np.concatenate([places[open_], p[lo]])),
        pa.array(np.concatenate([zero, size]).astype(np.int32)),
        pa.array(np.concatenate([zero, fi[lo]])),
        pa.array(np.concatenate([zero, fp[lo]])),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in EDGES.split(", ")])


def paths(found: DataFrame) -> DataFrame:
    """(id, place, edges, from_id, from_place): repeated edges with their source, compacted."""
    same = Window.partitionBy("h", "extra")
    source = F.min(F.struct("id", "place")).over(same)
    repeated = (
        found.withColumn("source", source)
        .where("edges > 0 or source.id < id")
        .select(
            "id",
            "place",
            F.greatest("edges", F.lit(1)).alias("edges"),
            F.when(F.col("edges") > 0, F.col("from_id"))
            .otherwise(F.col("source.id"))
            .alias("from_id"),
            F.when(F.col("edges") > 0, F.col("from_place"))
            .otherwise(F.col("source.place"))
            .alias("from_place"),
        )
    )
    walk = Window.partitionBy("id").orderBy("place")
    on = (
        (F.lag(F.col("place") + F.col("edges")).over(walk) == F.col("place"))
        & (F.lag("from_id").over(walk) == F.col("from_id"))
        & (F.lag(F.col("from_place") + F.col("edges")).over(walk) == F.col("from_place"))
    )
    numbered = repeated.withColumn("cut", F.when(on, 0).otherwise(1)).withColumn(
        "path", F.sum("cut").over(walk)
    )
    return numbered.groupBy("id", "path").agg(
        F.min("place").alias("place"),
        F.sum("edges").alias("edges"),
        F.min_by("from_id", "place").alias("from_id"),
        F.min_by("from_place", "place").alias("from_place"),
    )


class Repeats:
    """Repeated paths of a table of texts, and the texts without them."""

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text: str = "text",
        window: int = WINDOW,
        gram: int = GRAM,
        bits: int = LOG2_BITS,
    ):
        self.window = window
        self.copies = Copies(docs, id_col, text)
        firsts = self.copies.firsts()
        grams = shared_grams(firsts, window, gram, bits)
        found = edges(firsts, grams, window, gram)
        self.paths = cut_lineage(paths(found), "paths")
        later = self.copies.later().select(
            "id", _tag(F.col("mark")), F.lit(True).alias("whole"), F.lit(None).alias("path")
        )
        cuts = self.paths.select(
            "id",
            F.shiftrightunsigned("place", PLACE_BITS).alias("tag"),
            F.lit(False).alias("whole"),
            F.struct(
                F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).alias("at"), "edges"
            ).alias("path"),
        )
        cut = (
            later.union(cuts)
            .groupBy("id", "tag")
            .agg(F.max("whole").alias("whole"), F.collect_list("path").alias("paths"))
        )
        self.cut = cut_lineage(cut.withColumn("key", F.xxhash64("id", "tag")), "cuts")

    def applied(self) -> DataFrame:
        """(rest, id, text, whole, paths): only texts with cuts are moved to meet them."""
        docs = self.copies.documents.withColumn("tag", _tag(F.col("mark")))
        touched = Bitmap(self.cut, "key").test(F.xxhash64("id", "tag"))
        none = docs.where(~touched).withColumns(
            {"whole": F.lit(None).cast("boolean"), "paths": F.lit(None).cast(PATHS)}
        )
        some = docs.where(touched).join(self.cut.drop("key"), ["id", "tag"], "left")
        return none.select("rest", "id", "text", "whole", "paths").union(
            some.select("rest", "id", "text", "whole", "paths")
        )


PATHS = "array<struct<at:bigint,edges:bigint>>"


def _tag(mark: Column) -> Column:
    return mark.bitwiseAND(TAG).alias("tag")


def kept_of(text: bytes, whole: bool | None, found: list | None, window: int):
    """Number of words, number of removed words, words that stay."""
    words = text.split()
    n = len(words)
    if n < window or not (whole or found):
        return n, 0, words
    if whole:
        return n, n, []
    lo = np.array([p["at"] for p in found], np.int64)
    hi = lo + np.array([p["edges"] for p in found], np.int64) + window - 1
    lo, hi = merged(lo, hi)
    kept, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return n, n - len(kept), kept


def _cutting(kind: str, last, last_type: pa.DataType, window: int):
    def run(texts: pa.Array, wholes: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for t, w, found in zip(texts, wholes.to_pylist(), lists):
            raw = t.as_py() or b""
            n, removed, kept = kept_of(raw, w, found.as_py(), window)
            rows.append((n, removed, last(raw, removed, kept)))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], last_type),
            ],
            ["n_words", "n_removed", "kept"],
        )

    schema = f"n_words bigint, n_removed bigint, kept {kind}"
    return arrow_udf(run, schema).asNondeterministic()(
        F.col("text").cast("binary"), F.col("whole"), F.col("paths")
    )


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    repeats = Repeats(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda raw, removed, kept: hashlib.sha256(b" ".join(kept)).hexdigest()
    cut = _cutting("string", digest, pa.string(), repeats.window)
    return repeats.applied().select(F.col("id").alias("doc_id"), cut.alias("cut")).select(
        "doc_id",
        "cut.n_words",
        "cut.n_removed",
        F.col("cut.kept").alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos,
    unnest(list_transform(range(1, len(words) - 11), lambda i: array_to_string(words[i:i + 12], ' '))) AS run
  FROM split WHERE len(words) >= 13),
firsts AS (SELECT run, min(doc_id) AS first FROM windows GROUP BY run),
covered AS (
  SELECT DISTINCT doc_id, pos + step AS pos FROM windows JOIN firsts USING (run), range(13) AS steps(step)
  WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM split),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM placed ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::bigint AS n_words, (len(words) - coalesce(n, 0))::bigint AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = "n_chars"
) -> DataFrame:
    """``docs`` with repeated words removed; a text without any stays as it is.

    Cut texts are their remaining words joined by one space, possibly none. Column ``length``
    follows the text, if there is one.
    """
    repeats = Repeats(docs, id_col, text)
    joined = lambda raw, removed, kept: (b" ".join(kept) if removed else raw).decode()
    cut = _cutting("string", joined, pa.string(), repeats.window)
    made = repeats.applied().select("rest", "id", cut.alias("cut"))
    after = F.col("cut.kept")
    columns = []
    for name in docs.columns:
        if name == text:
            columns.append(after.alias(name))
        elif name == length:
            columns.append(F.length(after).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col("rest")[name].alias(name))
    return made.select(columns)
