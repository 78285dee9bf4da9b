"""Katz backoff language model over word pairs, with Good-Turing discounts.

Tokens are the words of a text and one end. The probability of a token after another that was
seen in training is d(c) * c / C, c their count, C the count of the first; d is the
Good-Turing discount for counts up to 5 and keeps all but one part in 10,000 of larger ones,
so every context has mass left. A pair not seen gets alpha * P(token): alpha spreads exactly
the mass that is left over the tokens not seen in this context. P is the same one level down:
discounted counts of single tokens, what is left being the probability of any unknown word.

How it is computed. One pass counts words. The second pass deals all pairs of all texts, per
text with their number, to buckets by their second word; words with a large share of all
tokens are dealt by pair. A bucket knows the counts of its pairs and words, and hands out

* per text: how many of its pairs have count 1, 2, 3, 4, 5, and the sum of everything that
  does not wait for the discounts,
* its part of the stored table of pairs: every pair seen in training with its count,
* pairs not seen in training, which meet their context's alpha in a join.

The table of contexts (C and alpha) is made from the table of pairs; both have discounted
probabilities as soon as all buckets are counted. ``Model.pairs`` and ``Model.contexts`` are
these tables as rows, and ``Model.score`` reads any texts' probabilities from them: a pair's,
or where it is not seen alpha times the word's, or that alone after an unseen context.

A text of the training set has only seen pairs; backing off concerns the other texts. All
counts cover all texts; pairs move once, packed in arrays, and nothing is cut off.

Defined cases: a null or empty text is its end token. A row without id belongs to the
training texts. Repeated rows count each. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetide.llm.bitmap import Bitmap
from tonetide.llm.common import by_batch, documents, pieces, runs_of, word_hashes, word_spans
from tonetide.session import cut_lineage

END, START = np.uint64(1), np.uint64(2)
K = 5
KEPT_ABOVE = 1 - 1e-4
#: Tokens that are packed together, and that a bucket is to hold.
CHUNK_TOKENS = 1_500_000
BUCKET_TOKENS = 1_500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words in lower case, then the end."""
    data = _LOWER[np.frombuffer(text or b"", np.uint8)]
    return np.append(word_hashes(data, *word_spans(data)), END)


def discounts(n: list[int]) -> list[float]:
    """d(1) to d(K) from the numbers of items seen 1, …, K + 1 times.

    Where Good-Turing gives no proper discount (few data), the absolute discount
    n1 / (n1 + 2 n2) is taken off instead.
    """
    absolute = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    tail = (K + 1) * n[K] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, K + 1):
        d = 0.0
        if n[r - 1] and tail < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - absolute) / r)
    return out


@dataclass(frozen=True)
class Unigrams:
    """What all tasks need to know about single tokens."""

    total: int
    types: int
    discount: list[float]
    seen_mass: float
    training_texts: int

    def probability(self, count: np.ndarray) -> np.ndarray:
        """P of tokens with these counts; 0: of an unknown one."""
        keep = np.append(np.append(0.0, self.discount), KEPT_ABOVE)[np.minimum(count, K + 1)]
        return np.where(count > 0, keep * count / max(1, self.total), 1 - self.seen_mass)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n, held): training count of each token, and whether held-out texts have it."""

    def work(batch):
        found, known = [], []
        for number, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
            (known if held_out(number) else found).append(tokens(text))
        empty = [np.empty(0, np.uint64)]
        h, n = np.unique(np.concatenate(found or empty), return_counts=True)
        other = np.unique(np.concatenate(known or empty))
        return pa.RecordBatch.from_pydict(
            {
                "h": np.concatenate([h, other]).view(np.int64),
                "n": np.concatenate([n, np.zeros(len(other), np.int64)]),
                "held": np.repeat([False, True], [len(h), len(other)]),
            }
        )

    rows = by_batch(docs, work, "h bigint, n bigint, held boolean")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("held").alias("held"))


# ---- packing ------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece."""
    raw = b"".join(
        np.array([a.itemsize, len(a)], "<i8").tobytes() + np.ascontiguousarray(a).tobytes()
        for a in arrays
    )
    head = len(raw).to_bytes(8, "little")
    return head + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        _, n = np.frombuffer(raw, "<i8", 2, at)
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + int(n) * np.dtype(kind).itemsize
    return out


PAIRS = "bucket int, chunk bigint, pairs binary"
_PAIR_KINDS = ("<u8", "<u4", "<u8", "<u4", "<u4", "<u4")
#: For each text of a chunk: id, whether the id is missing, held out, number of tokens.
_TEXT_KINDS = ("<i8", "u1", "u1", "<i8")


def _mixed_bucket(w: np.ndarray, ctx: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by word; of frequent words, by pair."""
    key = w.copy()
    if len(hot):
        at = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
        often = hot[at] == w
        key[often] ^= ctx[often] * np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _chunk(chunk: int, ids: list, made: list[np.ndarray], hot, buckets) -> pa.RecordBatch:
    """A row of pairs for each bucket, and one (bucket null) that lists the texts."""
    held = np.array([held_out(i) for i in ids], np.uint8)
    sizes = np.array([len(t) for t in made])
    w = np.concatenate(made)
    ctx = np.append(START, w[:-1])
    ctx[np.cumsum(sizes)[:-1]] = START
    doc = np.repeat(np.arange(len(ids)) * 2 + held, sizes)
    bucket = _mixed_bucket(w, ctx, hot, buckets)
    order = np.lexsort((doc, ctx, w, bucket))
    bucket, w, ctx, doc = bucket[order], w[order], ctx[order], doc[order]
    new_w = np.append(True, (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1]))
    new_pair = new_w | np.append(True, ctx[1:] != ctx[:-1])
    new_doc = new_pair | np.append(True, doc[1:] != doc[:-1])
    post = np.flatnonzero(new_doc)
    times = np.diff(np.append(post, len(w)))
    pair = np.flatnonzero(new_pair[post])
    word = np.flatnonzero(new_w[post][pair])
    per_pair = np.diff(np.append(pair, len(post)))
    per_word = np.diff(np.append(word, len(pair)))
    owner = bucket[post[pair[word]]]
    words, pairs_of = w[post[pair[word]]], ctx[post[pair]]
    pair_at = np.append(word, len(pair))
    post_at = np.append(pair, len(post))
    texts = _packed(
        np.array([i or 0 for i in ids], "<i8"),
        np.array([i is None for i in ids], "u1"),
        held,
        sizes.astype("<i8"),
    )
    rows = [(None, chunk, texts)]
    lo, hi = runs_of(owner)
    for a, b in zip(lo.tolist(), (hi + 1).tolist()):
        p, q = pair_at[a], pair_at[b]
        s, t = post_at[p], post_at[q]
        rows.append(
            (
                int(owner[a]),
                chunk,
                _packed(
                    words[a:b],
                    per_word[a:b].astype("<u4"),
                    pairs_of[p:q],
                    per_pair[p:q].astype("<u4"),
                    doc[post[s:t]].astype("<u4"),
                    times[s:t].astype("<u4"),
                ),
            )
        )
    kinds = [pa.int32(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in PAIRS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def deal_pairs(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    def run(batches):
        part, number, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        made: list[np.ndarray] = []
        for batch in batches:
            for piece in pieces(batch, 4 << 20):
                for i, text in zip(piece["id"].to_pylist(), piece["text"].to_pylist()):
                    ids.append(i)
                    made.append(tokens(text))
                    size += len(made[-1])
                    if size >= CHUNK_TOKENS:
                        yield _chunk((part << 32) | number, ids, made, hot, buckets)
                        ids, made, size, number = [], [], 0, number + 1
        if ids:
            yield _chunk((part << 32) | number, ids, made, hot, buckets)

    return docs.mapInArrow(run, PAIRS)


# ---- buckets ------------------------------------------------------------------------------

#: One table for four kinds of rows: ``texts`` (chunk's list of texts, or sums of a bucket for
#: them), the bucket's training pairs (``pairs``), unseen pairs (``ctx``, ``text``, ``times``),
#: counts of counts (``n`` alone).
FOUND = (
    "kind string, chunk bigint, texts binary, pairs binary, ctx bigint, text int, times int, "
    "n array<bigint>"
)
#: Words, their counts, their numbers of contexts; contexts and counts of their pairs.
_TABLE_KINDS = ("<u8", "<i8", "<u4", "<u8", "<u4")
_SUM_KINDS = ("<u4", "<f8", "<f8", "<u4", *["<u4"] * K, "<u4")


def _found(kind: str, rows: int, **columns) -> pa.RecordBatch:
    kinds = {
        "chunk": pa.int64(), "texts": pa.binary(), "pairs": pa.binary(), "ctx": pa.int64(),
        "text": pa.int32(), "times": pa.int32(), "n": pa.list_(pa.int64()),
    }
    arrays = [pa.array([kind] * rows, pa.string())]
    for name, type_ in kinds.items():
        value = columns.get(name)
        arrays.append(pa.nulls(rows, type_) if value is None else pa.array(value, type_))
    return pa.RecordBatch.from_arrays(arrays, ["kind", *kinds])


def _bucket(
    chunks: list[int], blobs: list[bytes], words: Unigrams, often: dict[int, int], wanted: Bitmap
) -> Iterator[pa.RecordBatch]:
    """Everything a bucket can say about its pairs."""
    parts = [_unpacked(b, *_PAIR_KINDS) for b in blobs]
    w = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    ctx = np.concatenate([p[2] for p in parts])
    per_pair = np.concatenate([p[3] for p in parts])
    doc = np.concatenate([p[4] for p in parts])
    times = np.concatenate([p[5] for p in parts])
    source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[4]) for p in parts])
    del parts
    # equal pairs of different chunks get one number
    order = np.lexsort((ctx, w))
    w, ctx = w[order], ctx[order]
    new_w = np.append(True, w[1:] != w[:-1])
    new = new_w | np.append(True, ctx[1:] != ctx[:-1])
    number = np.empty(len(w), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    pair = np.repeat(number, per_pair)
    del order, number, per_pair
    w, ctx = w[new], ctx[new]
    word = (np.cumsum(new_w, dtype=np.int32) - 1)[new]
    del new, new_w
    count = np.bincount(pair, np.where(doc & 1, 0, times), len(w)).astype(np.int64)
    own = np.bincount(word, count).astype(np.int64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    if often:
        own = np.array(
            [often.get(h, n) for h, n in zip(w[first].view(np.int64).tolist(), own.tolist())],
            np.int64,
        )
    of_word = own[word]
    p = words.probability(of_word)

    yield _found(
        "counts", 1, n=[[int((count == r).sum()) for r in range(1, K + 2)]]
    )
    seen = count > 0
    followed = np.bincount(word[seen], minlength=len(own))
    kept = followed > 0
    columns = [w[first][kept], own[kept], followed[kept], ctx[seen], count[seen]]
    yield _found(
        "pairs", 1, pairs=[_packed(*(c.astype(k) for c, k in zip(columns, _TABLE_KINDS)))]
    )
    del word, own, first, seen, columns

    # what a token adds to its text's sums, by pair
    base = np.log10((of_word + 1) / (words.total + words.types + 1))
    fixed = np.where(count > 0, 0.0, np.log10(p))
    big = count > K
    fixed[big] += np.log10(count[big] * KEPT_ABOVE)
    leads = (of_word > 0) & (w != END)
    fixed[leads] -= np.log10(of_word[leads])
    grade = np.where(big, 0, count).astype(np.int8)
    spot = source.astype(np.int64) << 32 | (doc >> 1)
    place, slot = np.unique(spot, return_inverse=True)
    del spot
    total = lambda weights: np.bincount(slot, weights, len(place))
    sums = [total(base[pair] * times), total(fixed[pair] * times), total((of_word > 0)[pair] * times)]
    sums += [total((grade[pair] == r) * times) for r in range(1, K + 1)] + [total(times)]
    del slot, base, fixed, grade, of_word
    lo, hi = runs_of(place >> 32)
    for a, b in zip(lo.tolist(), (hi + 1).tolist()):
        columns = [(place[a:b] & 0xFFFFFFFF), *(s[a:b] for s in sums)]
        blob = _packed(*(c.astype(k) for c, k in zip(columns, _SUM_KINDS)))
        yield _found("sums", 1, chunk=[chunks[int(place[a] >> 32)]], texts=[blob])

    # unseen pairs; after a word that training does not have, nothing is left to add
    known = wanted.holds(ctx) | (ctx == START)
    at = np.flatnonzero(((count == 0) & known)[pair])
    if len(at):
        yield _found(
            "unseen",
            len(at),
            chunk=np.array(chunks, np.int64)[source[at]],
            ctx=ctx[pair[at]].view(np.int64),
            text=(doc[at] >> 1).astype(np.int32),
            times=times[at].astype(np.int32),
        )


def work_buckets(
    dealt: DataFrame, buckets: int, words: Unigrams, often: dict[int, int], wanted: Bitmap
) -> DataFrame:
    """All buckets, each in one task; rows of ``FOUND``."""
    rows = dealt.repartition(buckets, F.coalesce("bucket", F.col("chunk")))
    rows = rows.sortWithinPartitions("bucket")

    def run(batches):
        now, chunks, blobs = None, [], []
        for batch in batches:
            for bucket, chunk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket is None:
                    yield _found("texts", 1, chunk=[chunk], texts=[blob])
                    continue
                if bucket != now and blobs:
                    yield from _bucket(chunks, blobs, words, often, wanted)
                    chunks, blobs = [], []
                now = bucket
                chunks.append(chunk)
                blobs.append(blob)
        if blobs:
            yield from _bucket(chunks, blobs, words, often, wanted)

    return rows.mapInArrow(run, FOUND)


# ---- model and scores ---------------------------------------------------------------------

SCORED = (
    "chunk bigint, text int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
    "base_score double, fixed double"
)


def _texts(table: pa.Table, log_kept: np.ndarray, log_first: float) -> pa.Table:
    """Add up what the buckets say about the texts of one chunk."""
    rows = table.to_pylist()
    ids, missing, held, sizes = _unpacked(
        next(r["texts"] for r in rows if r["kind"] == "texts"), *_TEXT_KINDS
    )
    sums = np.zeros((3, len(ids)))
    for r in rows:
        if r["kind"] == "sums":
            at, base, fixed, known, *by_count, _ = _unpacked(r["texts"], *_SUM_KINDS)
            sums[0, at] += base
            sums[1, at] += fixed + log_kept @ np.array(by_count)
            sums[2, at] += known
    return pa.table(
        {
            "chunk": np.full(len(ids), rows[0]["chunk"]),
            "text": np.arange(len(ids), dtype=np.int32),
            "doc_id": pa.array(ids, mask=missing.astype(bool)),
            "held_out": held.astype(bool),
            "n_tokens": sizes,
            "n_known": sums[2].astype(np.int64),
            "base_score": sums[0],
            # the first token's context is the start, which training texts began with
            "fixed": sums[1] - log_first,
        }
    )


ROWS = "ctx bigint, h bigint, n bigint, kept double"
CONTEXTS = "ctx bigint, total bigint, left double, p double"
TOKENS = "row bigint, doc_id bigint, ctx bigint, h bigint, times bigint"


class Model:
    """Counts of all texts; ``words``, ``contexts`` and the pairs in ``found`` are stored tables."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text"):
        rows = docs.select(docs[id_col].alias("id"), docs[text].cast("binary").alias("text"))
        self.words = cut_lineage(count_words(rows), "words")
        counts = [F.count_if(F.col("n") == r) for r in range(1, K + 2)]
        total, types, ends, *n = self.words.agg(
            F.coalesce(F.sum("n"), F.lit(0)),
            F.count_if(F.col("n") > 0),
            F.coalesce(F.sum(F.when(F.col("h") == int(END), F.col("n"))), F.lit(0)),
            *counts,
        ).first()
        d = discounts(n)
        kept = sum(r * n[r - 1] * d[r - 1] for r in range(1, K + 1))
        above = total - sum(r * n[r - 1] for r in range(1, K + 1))
        mass = (kept + above * KEPT_ABOVE) / total if total else 0.0
        self.unigrams = Unigrams(total, types, d, mass, ends)

        buckets = max(1, -(-total // BUCKET_TOKENS))
        limit = max(1, total // (8 * buckets))
        # words with a large share of all tokens: at most 8 per bucket
        hot = self.words.where(F.col("n") > limit).select("h", "n").collect()
        often = {r["h"]: r["n"] for r in hot}
        self.wanted = Bitmap(self.words.where("held and n > 0"), "h")
        hashes = np.sort(np.array(list(often), np.int64).view(np.uint64))
        dealt = deal_pairs(rows, hashes, buckets)
        self.found = cut_lineage(
            work_buckets(dealt, buckets, self.unigrams, often, self.wanted), "pairs"
        )
        pairs = self.found.where("kind = 'counts'").agg(
            *[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(K + 1)]
        )
        self.discount = discounts(list(pairs.first()))
        #: of the words that held-out texts have, and the start
        self.contexts = cut_lineage(self._contexts(self.wanted), "contexts")

    def _table(self, work, schema: str) -> DataFrame:
        """``work`` over the packed pairs of each bucket: words, counts, contexts, counts, kept."""
        by_count = np.array([0.0, *(r * d for r, d in enumerate(self.discount, 1))])

        def run(batches):
            for batch in batches:
                for blob in batch["pairs"]:
                    w, own, per_word, ctx, n = _unpacked(blob.as_py(), *_TABLE_KINDS)
                    n = n.astype(np.int64)
                    kept = np.where(n > K, n * KEPT_ABOVE, by_count[np.minimum(n, K)])
                    if len(n):
                        columns = work(np.repeat(w, per_word), np.repeat(own, per_word), ctx, n, kept)
                        names = [c.split()[0] for c in schema.split(", ")]
                        yield from pa.table(columns, names).to_batches(1 << 16)

        return self.found.where("kind = 'pairs'").select("pairs").mapInArrow(run, schema)

    def _contexts(self, only: Bitmap | None) -> DataFrame:
        """(ctx, total, log_back): count C of a context, log10 of C * alpha."""
        words = self.unigrams

        def work(w, own, ctx, n, kept):
            some = slice(None) if only is None else only.holds(ctx) | (ctx == START)
            values, slot = np.unique(ctx[some], return_inverse=True)
            sums = [
                np.bincount(slot, c[some], len(values)) for c in (n, n - kept, words.probability(own))
            ]
            return [values.view(np.int64), sums[0].astype(np.int64), *sums[1:]]

        table = self._table(work, CONTEXTS).groupBy("ctx").agg(
            F.sum("total").alias("total"), F.sum("left").alias("left"), F.sum("p").alias("p")
        )
        return table.select(
            "ctx", "total", F.log10(F.col("left") / (1 - F.col("p"))).alias("log_back")
        )

    @functools.cached_property
    def all_contexts(self) -> DataFrame:
        """As ``contexts``, of every context that training has."""
        return cut_lineage(self._contexts(None), "contexts")

    @functools.cached_property
    def pairs(self) -> DataFrame:
        """(ctx, h, n, log_p): all training pairs with their discounted probability, by context."""

        def work(w, own, ctx, n, kept):
            return [ctx.view(np.int64), w.view(np.int64), n, kept]

        rows = self._table(work, ROWS).join(self.all_contexts.select("ctx", "total"), "ctx")
        log_p = F.log10(F.col("kept") / F.col("total"))
        return cut_lineage(rows.select("ctx", "h", "n", log_p.alias("log_p")), "probabilities")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_tokens, n_known, score) of any texts, by the stored tables alone."""

        def run(batches):
            part, number = TaskContext.get().partitionId() << 33, 0
            for batch in batches:
                for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                    w = tokens(t)
                    pair, times = np.unique(
                        np.column_stack([np.append(START, w[:-1]), w]), axis=0, return_counts=True
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(pair), part + number)),
                            pa.array([i] * len(pair), pa.int64()),
                            pa.array(pair[:, 0].copy().view(np.int64)),
                            pa.array(pair[:, 1].copy().view(np.int64)),
                            pa.array(times.astype(np.int64)),
                        ],
                        [c.split()[0] for c in TOKENS.split(", ")],
                    )
                    number += 1

        texts = docs.select(docs[id_col].alias("id"), docs[text].cast("binary").alias("text"))
        one = self.unigrams
        n = F.coalesce(F.col("count"), F.lit(0))
        keep = F.array(*[F.lit(float(d)) for d in [*one.discount, KEPT_ABOVE]])
        alone = F.when(n > 0, F.get(keep, F.least(n, F.lit(K + 1)).cast("int") - 1) * n / one.total)
        log_one = F.log10(alone.otherwise(1 - one.seen_mass))
        log_back = F.col("log_back") - F.log10("total")
        log_p = F.coalesce("log_p", log_back + log_one, log_one)
        return (
            texts.mapInArrow(run, TOKENS)
            .join(self.pairs.select("ctx", "h", "log_p"), ["ctx", "h"], "left")
            .join(self.all_contexts, "ctx", "left")
            .join(self.words.select("h", F.col("n").alias("count")), "h", "left")
            .groupBy("row", "doc_id")
            .agg(
                F.sum("times").alias("n_tokens"),
                F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
                F.sum(F.col("times") * log_p).alias("score"),
            )
            .drop("row")
        )

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, base_score, score) of all texts."""
        kept = np.log10([r * d for r, d in enumerate(self.discount, 1)])
        first = math.log10(max(1, self.unigrams.training_texts))
        texts = (
            self.found.where("kind in ('texts', 'sums')")
            .select("kind", "chunk", "texts")
            .groupBy("chunk")
            .applyInArrow(lambda table: _texts(table, kept, first), SCORED)
        )
        back = (
            self.found.where("kind = 'unseen'")
            .select("chunk", "text", "ctx", "times")
            .join(self.contexts, "ctx")
            .groupBy("chunk", "text")
            .agg(F.sum(F.col("times") * F.col("log_back")).alias("back"))
        )
        return texts.join(back, ["chunk", "text"], "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            "base_score",
            (F.col("fixed") + F.coalesce("back", F.lit(0.0))).alias("score"),
        )


def op3_katz_backoff(spark, sf_dir: str) -> DataFrame:
    model = Model(documents(spark, sf_dir))
    return model.scores().select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.unigrams.total).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
