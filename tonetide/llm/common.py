"""Helpers shared by the corpus operators: words, numpy hashing, packing rows, prefix sums."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
ROW = "__row"


#: Rows per Arrow batch: texts are large rows, and the default of 10,000 is tens of megabytes.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches, unless the user has chosen one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pack(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``docs`` in one struct, beside ``columns``.

    Input columns then cannot clash with working columns, whatever their names.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]) if docs.columns else F.lit(None)
    return docs.select(whole.alias(ROW), *[c.alias(n) for n, c in columns.items()])


def unpack(df: DataFrame, **columns: Column) -> DataFrame:
    """The packed columns again; ``columns`` replace those of the same name (in any case)."""
    named = {n.lower() for n in columns}
    kept = [c for c in df.schema[ROW].dataType.names if c.lower() not in named]
    return df.select(
        *[F.col(ROW)[c].alias(c) for c in kept], *[c.alias(n) for n, c in columns.items()]
    )


def pieces(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes, so that long texts do not meet in one working set."""
    if batch.num_rows:
        rows = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Free memory of a worker goes back to the system.

    Workers stay for the tasks of other stages; what each stage once needed would add up.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_batch(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``work`` over bounded slices of the rows, inside the tasks."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


# ---- hashing over bytes -------------------------------------------------------------------

_SEED = np.random.default_rng(20240101)
BYTE_CODE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive codes (shorter input: empty).

    Runs of doubling length are combined, then two overlapping ones make ``k``.
    """
    if len(codes) < k:
        return np.empty(0, np.uint64)
    h, have = codes, 1
    while have * 2 <= k:
        n = len(h) - have
        h = mixed(h[:n] * (ODD + np.uint64(2 * have)) + h[have:])
        have *= 2
    if have < k:
        n = len(h) - (k - have)
        h = mixed(h[:n] * (ODD + np.uint64(2 * k + 1)) + h[k - have :])
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        step = width - have
        h = np.minimum(h[:-step], h[step:])
    return h


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LONG = 256


def word_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0
) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time go through ``mixed``.

    Seeds give independent hashes. One step per eight bytes of the longest word, over the words
    that are that long; words over 256 bytes are hashed one by one.
    """
    size = end - start
    h = mixed(size.astype(np.uint64) * ODD + np.uint64(2 * seed + 1) * BYTE_CODE[seed % 256])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    at = start[left]
    while len(left):
        part = eight[at] & _KEEP[np.minimum(end[left] - at, 8)]
        h[left] = mixed(mixed(h[left]) * ODD + part)
        at = at + 8
        more = at < end[left]
        left, at = left[more], at[more]
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.append(0, change), np.append(change, len(values)) - 1


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as disjoint ones in order; touching ones join."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.append(True, lo[1:] > top[:-1])
    return lo[first], top[np.append(np.flatnonzero(first)[1:], len(lo)) - 1]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
