"""Suffix-array dedup: removes every byte covered by a 400-byte string that occurs twice.

Only text that can repeat is sorted. Each 400-byte window is represented by the least hash of
its inner 64-byte grams: equal windows have equal representatives, and neighbouring windows
mostly share one, so a stretch of windows is one segment. A gram hash that occurs once in all
texts represents nothing that repeats; a bitmap of fixed size tells the tasks which occur
twice (it can only err towards more work).

Segments are dealt by their representative, so equal windows meet, and worked off in shards of
two megabytes (about a hundred times that while they are sorted): a suffix array by Larsson-Sadakane refinement, common prefixes by Kasai's
method, and windows whose neighbours in the array share 400 bytes are equal. Equal segments
are collapsed before the shuffle, and once more in the shard.

A representative with very many segments is salted over several tasks, and any group larger
than a shard is cut. Such shards hand out sorted runs of the digests of their distinct
windows, cut by binary search at fixed borders; the runs of one range are merged and searched
for digests that two shards have, each of which comes back as a window to remove.

Exact copies are recognised as a whole; one of them is sorted as a witness for other texts.

Defined cases: a null or empty text has no bytes. Texts are told apart by their content, so
rows without id and rows with equal ids are treated like any other; repeated rows are copies
of each other. Texts of less than 400 bytes are kept. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonetide.llm.bitmap import LOG2_BITS, Bitmap
from tonetide.llm.common import (
    BYTE_CODE,
    by_batch,
    documents,
    gram_hashes,
    merged,
    mixed,
    runs_of,
    signed,
    sliding_min,
)
from tonetide.llm.copies import Copies
from tonetide.llm.suffixes import classes
from tonetide.session import cut_lineage

WINDOW = 400
GRAM = 64
SHARD_BYTES = 2 << 20
#: Representatives with more grams than this are salted.
HOT = 4_096
SALTS = 64
#: A longer stretch of windows is cut.
SEGMENT_WINDOWS = 1 << 16
#: Digests of windows that one merging task is to hold.
RANGE_WINDOWS = 1 << 20
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_CODE2 = mixed(BYTE_CODE + np.uint64(0x5851F42D4C957F2D))


def _representatives(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the least one inside."""
    grams = gram_hashes(BYTE_CODE[data], gram)
    return grams, sliding_min(grams, window - gram + 1)


def _chosen(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """The grams that represent some window, each as often as it occurs."""
    around = np.full(len(least) + 2 * (width - 1), _NEVER)
    around[width - 1 : width - 1 + len(least)] = ~least
    return grams[~sliding_min(around, width) == grams]


def gram_counts(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, n): how often each representative occurs in all texts."""

    def work(batch):
        found = []
        for text in batch["text"].to_pylist():
            if len(text) >= window:
                grams, least = _representatives(np.frombuffer(text, np.uint8), window, gram)
                found.append(_chosen(grams, least, window - gram + 1))
        if not found:
            return None
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([signed(h), pa.array(n)], ["h", "n"])

    rows = by_batch(_bytes(texts), work, "h bigint, n bigint")
    return rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def _bytes(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("text").cast("binary").alias("text"), "mark", "mark2")


#: ``bytes`` null: the stretch is known to repeat. Else a segment to be compared; ``known``:
#: equal ones were found already.
SEGMENTS = (
    "h bigint, salt int, mark bigint, mark2 bigint, lo bigint, windows int, known boolean, "
    "bytes binary"
)


def segments(
    texts: DataFrame, repeated: Bitmap, hot: Bitmap, window: int, gram: int
) -> DataFrame:
    """Stretches of windows with a repeated representative; equal ones of a slice collapse."""

    def work(batch):
        rows: dict[tuple, list] = {}
        again = []
        for text, mark, mark2 in zip(*(batch[c].to_pylist() for c in ("text", "mark", "mark2"))):
            if len(text) < window:
                continue
            _, least = _representatives(np.frombuffer(text, np.uint8), window, gram)
            lo, hi = runs_of(least)
            h = least[lo]
            here = np.flatnonzero(repeated.holds(h))
            crowded = hot.holds(h[here])
            for value, a, b, many in zip(
                h[here].view(np.int64).tolist(), lo[here].tolist(), hi[here].tolist(), crowded
            ):
                salt = (mark ^ a) % SALTS + 1 if many else 0
                for at in range(a, b + 1, SEGMENT_WINDOWS):
                    n = min(SEGMENT_WINDOWS, b + 1 - at)
                    part = text[at : at + n + window - 1]
                    seen = rows.get((value, part))
                    if seen is None:
                        rows[value, part] = [value, salt, mark, mark2, at, n, False, part]
                    else:
                        seen[6] = True
                        again.append([mark ^ at, -1, mark, mark2, at, n, True, None])
        for r in rows.values():
            if r[6]:
                again.append([r[2] ^ r[4], -1, r[2], r[3], r[4], r[5], True, None])
        return _batch([*rows.values(), *again], SEGMENTS)

    return by_batch(_bytes(texts), work, SEGMENTS)


_KINDS = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
}


def _batch(rows: list[list], schema: str) -> pa.RecordBatch | None:
    if not rows:
        return None
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows), fields)],
        [name for name, _ in fields],
    )


#: Stretches that repeat (``run`` null), or a run of digests of one range.
FOUND = "mark bigint, mark2 bigint, lo bigint, windows int, range int, run binary"
RUN = np.dtype(
    [("d1", "<u8"), ("d2", "<u8"), ("mark", "<i8"), ("mark2", "<i8"), ("lo", "<i8")]
)


class _Shard:
    """Segments of whole groups, or of parts of one group."""

    def __init__(self, window: int, ranges: int):
        self.window, self.ranges = window, ranges
        self.rows: list[tuple] = []
        self.size = 0
        #: representatives whose segments other shards have too
        self.split: set[int] = set()

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[7])
        if row[1] > 0:
            self.split.add(row[0])

    def found(self) -> list[list]:
        """Rows of ``FOUND``: windows equal to another one here, and runs for other shards."""
        out: list[list] = []
        kinds: dict[tuple, list] = {}
        for row in self.rows:
            kinds.setdefault((row[0], row[7]), []).append(row)
        groups: dict[int, int] = {}
        for h, _ in kinds:
            groups[h] = groups.get(h, 0) + 1
        open_, times = [], []
        for (h, part), same in kinds.items():
            repeated = len(same) > 1 or same[0][6]
            if repeated:
                out += [[r[2], r[3], r[4], r[5], None, None] for r in same if not r[6]]
            if h in self.split or groups[h] > 1 or not repeated:
                open_.append(same[0])
                times.append(2 if repeated else 1)
        if open_:
            out += self._compared(open_, np.array(times))
        self.rows, self.size, self.split = [], 0, set()
        return out

    def _compared(self, rows: list[tuple], times: np.ndarray) -> list[list]:
        data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
        sizes = np.array([len(r[7]) for r in rows])
        counts = np.array([r[5] for r in rows])
        owner = np.repeat(np.arange(len(rows)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(sizes) - sizes)[owner] + nth
        number = classes(data, starts, self.window)
        weight = np.bincount(number, times[owner])
        twice = weight[number] > 1
        out = _stretches(rows, owner, nth, twice & (times[owner] == 1))
        shared = np.flatnonzero(np.array([r[0] in self.split for r in rows])[owner])
        if len(shared):
            _, first = np.unique(number[shared], return_index=True)
            first = shared[first]
            place = starts[first]
            run = np.empty(len(first), RUN)
            run["d1"] = gram_hashes(BYTE_CODE[data], self.window)[place]
            run["d2"] = gram_hashes(_CODE2[data], self.window)[place]
            for name, i in (("mark", 2), ("mark2", 3)):
                run[name] = np.array([r[i] for r in rows], np.int64)[owner[first]]
            run["lo"] = np.array([r[4] for r in rows])[owner[first]] + nth[first]
            run["lo"][twice[first]] = -1
            run = run[np.lexsort((run["d2"], run["d1"]))]
            borders = np.arange(1, self.ranges).astype(np.uint64) * np.uint64(
                (1 << 64) // self.ranges
            )
            cut = [0, *np.searchsorted(run["d1"], borders).tolist(), len(run)]
            out += [
                [None, None, None, None, i, run[a:b].tobytes()]
                for i, (a, b) in enumerate(zip(cut, cut[1:]))
                if b > a
            ]
        return out


def _stretches(rows, owner, nth, chosen) -> list[list]:
    """Chosen windows as stretches (mark, mark2, lo, windows)."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return []
    cut = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
    lo = np.append(0, np.flatnonzero(cut) + 1)
    hi = np.append(lo[1:], len(at))
    return [
        [rows[owner[at[a]]][2], rows[owner[at[a]]][3], rows[owner[at[a]]][4] + int(nth[at[a]]),
         int(b - a), None, None]
        for a, b in zip(lo.tolist(), hi.tolist())
    ]


def compared(found: DataFrame, window: int, ranges: int, shard_bytes: int) -> DataFrame:
    """Sort the segments in shards; rows of ``FOUND``."""
    dealt = found.repartition("h", "salt").sortWithinPartitions("h", "salt")
    names = [f.split()[0] for f in SEGMENTS.split(", ")]

    def run(batches):
        shard, group = _Shard(window, ranges), None
        for batch in batches:
            out = []
            for row in zip(*(batch[n].to_pylist() for n in names)):
                if row[7] is None:
                    out.append([*row[2:6], None, None])
                    continue
                if row[:2] != group:
                    if shard.size >= shard_bytes:
                        out += shard.found()
                    group = row[:2]
                    begun = shard.size
                elif shard.size - begun >= shard_bytes:
                    # one group is more than a shard: its parts are compared by digests
                    shard.split.add(row[0])
                    out += shard.found()
                    shard.split.add(row[0])
                    begun = 0
                shard.add(row)
            if out:
                yield _batch(out, FOUND)
        if shard.rows:
            yield _batch(shard.found(), FOUND) or _batch([[None] * 6], FOUND)

    return dealt.mapInArrow(run, FOUND)


def merge_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """The entries of each sorted run whose digest another run has too."""
    together = np.concatenate([r[["d1", "d2"]] for r in runs])
    order = np.lexsort((together["d2"], together["d1"]))
    together = together[order]
    same = (together["d1"][1:] == together["d1"][:-1]) & (
        together["d2"][1:] == together["d2"][:-1]
    )
    shared = together[1:][same]
    out = []
    for run in runs:
        # digests equal in d1 only are as rare as collisions, and lie within a few places
        at = np.searchsorted(shared["d1"], run["d1"])
        hit = np.zeros(len(run), bool)
        for step in range(4):
            i = np.minimum(at + step, len(shared) - 1)
            if len(shared):
                hit |= (shared["d1"][i] == run["d1"]) & (shared["d2"][i] == run["d2"])
        out.append(run[hit])
    return out


STRETCHES = "mark bigint, mark2 bigint, lo bigint, windows int"


def across(found: DataFrame) -> DataFrame:
    """Windows that repeat in different shards."""

    def work(table: pa.Table) -> pa.Table:
        runs = [np.frombuffer(b, RUN) for b in table["run"].to_pylist()]
        hits = np.concatenate(merge_runs(runs))
        hits = hits[hits["lo"] >= 0]
        return pa.table(
            {
                "mark": hits["mark"],
                "mark2": hits["mark2"],
                "lo": hits["lo"],
                "windows": np.ones(len(hits), np.int32),
            }
        )

    return found.groupBy("range").applyInArrow(work, STRETCHES)


class Repeats:
    """Repeated stretches of a table of texts, and the texts without them."""

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text: str = "text",
        window: int = WINDOW,
        gram: int = GRAM,
        bits: int = LOG2_BITS,
        shard_bytes: int = SHARD_BYTES,
        hot: int = HOT,
    ):
        self.window = window
        self.copies = Copies(docs, id_col, text)
        texts = self.copies.distinct_texts()
        counts = cut_lineage(gram_counts(texts, window, gram), "grams")
        many = counts.where(F.col("n") > hot)
        crowded = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        ranges = max(16, -(-crowded * (window - gram + 1) // RANGE_WINDOWS))
        found = segments(
            texts, Bitmap(counts, "h", bits), Bitmap(many, "h", bits), window, gram
        )
        found = cut_lineage(compared(found, window, ranges, shard_bytes), "stretches")
        stretches = found.where("mark is not null").select("mark", "mark2", "lo", "windows")
        stretches = stretches.union(across(found.where("run is not null")))
        whole = self.copies.groups.select(
            "mark", "mark2", F.lit(True).alias("whole"), F.lit(None).alias("stretch")
        )
        cut = stretches.select(
            "mark", "mark2", F.lit(False).alias("whole"), F.struct("lo", "windows").alias("stretch")
        )
        cut = (
            whole.union(cut)
            .groupBy("mark", "mark2")
            .agg(F.max("whole").alias("whole"), F.collect_list("stretch").alias("stretches"))
        )
        self.cut = cut_lineage(cut, "cuts")

    def applied(self) -> DataFrame:
        """(rest, id, text, whole, stretches): only texts with cuts are moved to meet them."""
        docs = self.copies.documents
        touched = Bitmap(self.cut, "mark").test(F.col("mark"))
        columns = ["rest", "id", "text", "whole", "stretches"]
        none = docs.where(~touched).withColumns(
            {
                "whole": F.lit(None).cast("boolean"),
                "stretches": F.lit(None).cast("array<struct<lo:bigint,windows:int>>"),
            }
        )
        some = docs.where(touched).join(self.cut, ["mark", "mark2"], "left")
        return none.select(columns).union(some.select(columns))


def kept_of(text: bytes, whole: bool | None, found: list | None, window: int):
    """Removed runs as (starts, ends), and the bytes that stay."""
    if len(text) < window or not (whole or found):
        return 0, 0, text
    if whole:
        return len(text), 1, b""
    lo = np.array([s["lo"] for s in found], np.int64)
    hi = lo + np.array([s["windows"] for s in found], np.int64) + window - 1
    lo, hi = merged(lo, hi)
    kept = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)]))
    return len(text) - len(kept), len(lo), kept


CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def cut_texts(rows: DataFrame, window: int, with_text: bool):
    """Column of struct ``CUT`` for the rows of ``Repeats.applied``."""

    def run(texts: pa.Array, wholes: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, w, found in zip(texts, wholes.to_pylist(), lists):
            raw = t.as_py() or b""
            removed, spans, kept = kept_of(raw, w, found.as_py(), window)
            digest = hashlib.sha256(kept).hexdigest()
            out.append((len(raw), removed, spans, kept if with_text else None, digest))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            [f.split()[0] for f in CUT.split(", ")],
        )

    cut = arrow_udf(run, CUT).asNondeterministic()
    return cut(rows.text.cast("binary"), rows.whole, rows.stretches)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    repeats = Repeats(documents(spark, sf_dir).select("doc_id", "text"))
    rows = repeats.applied()
    made = rows.select(
        F.col("id").alias("doc_id"), cut_texts(rows, repeats.window, False).alias("cut")
    )
    return made.select(
        "doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256"
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the bytes that stay in place of the text, as binary: a cut may part a
    character."""
    repeats = Repeats(docs, id_col, text)
    rows = repeats.applied()
    made = rows.select("rest", cut_texts(rows, repeats.window, True).alias("cut"))
    return made.select(
        [
            F.col("cut.kept").alias(c) if c == text else F.col("rest")[c].alias(c)
            for c in docs.columns
        ]
    )
