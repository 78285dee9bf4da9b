"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a hashed order and cut into blocks of equal size in
characters. With weight w, block k of a source may be placed from slot floor(k / w) on (its
release) and must be placed before slot ceil((k + 1) / w) (its deadline). Serving, slot by
slot, the released block with the earliest deadline meets all deadlines, so after any number
of slots each source is less than one block away from its share.

Weights enter exactly, as whole numbers in their proportion, so nothing drifts however long a
phase lasts and however many sources there are. The slots are served in one task that streams
its result: it reads the list of sources and holds one chunk of blocks of each. A document finds
its slot by a join on the chunk of its block number. Block numbers are running sums over parts
of a source (hash ranges), so the largest source is spread like any other.

When a source has no blocks left, the next phase starts: the rest share the slots in the
proportion of their weights. Every document is placed exactly once.

Defined cases: documents without source are a source of their own. Null and empty texts have
size zero and take the block of their neighbours. Repeated rows are placed one after another.
A document longer than a block counts where it begins; the blocks it covers stay its own. An
empty table gives an empty table. The number of sources is taken to be small (it is the list
that has weights).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetide.llm.common import ROW, documents, pack, unpack
from tonetide.session import cut_lineage

BLOCK_CHARS = 16_384
PART_ROWS = 4_000
CHUNK = 256
#: Schedules of up to so many blocks (about 32 bytes each) are sent along with the tasks.
SENT_BLOCKS = 1 << 18
PLACES = (
    "key string, chunk bigint, places array<struct<phase int, release bigint, deadline bigint, "
    "slot bigint>>"
)


def tempered(sizes: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to size ** power: large sources count less than their size."""
    return {s: max(n, 1) ** power for s, n in sizes.items()}


def exact_shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def served(shares: Mapping[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of slot 0, 1, … without end: earliest deadline first
    among released blocks."""
    length = sum(shares.values())
    release = lambda s, k: k * length // shares[s]
    deadline = lambda s, k: -(-(k + 1) * length // shares[s])
    waiting = [(0, deadline(s, 0), s, 0) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while shares:
        while waiting and waiting[0][0] <= slot:
            free, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k, free))
        due, s, k, free = heapq.heappop(ready)
        yield s, k, free, due
        heapq.heappush(waiting, (release(s, k + 1), deadline(s, k + 1), s, k + 1))
        slot += 1


def schedule(
    blocks: Mapping[str, int], weights: Mapping[str, float]
) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase of the source, release, deadline, slot) in the order of slots."""
    left = {s: n for s, n in blocks.items() if n > 0}
    base = phase = 0
    while left:
        done = {s: blocks[s] - n for s, n in left.items()}
        for turn, (s, k, free, due) in enumerate(served(exact_shares({s: weights[s] for s in left}))):
            yield s, done[s] + k, phase, base + free, base + due, base + turn
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        base += turn + 1
        phase += 1


def _chunks(blocks: Mapping[str, int], weights: Mapping[str, float], rows: int = 64):
    """The schedule as Arrow batches of PLACES: at most a chunk of each source is held."""
    open_chunks: dict[str, list[dict]] = {}
    full: list[dict] = []
    kind = pa.list_(pa.struct([("phase", pa.int32())] + [(n, pa.int64()) for n in ("release", "deadline", "slot")]))
    shape = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("places", kind)])
    for s, block, phase, free, due, slot in schedule(blocks, weights):
        own = open_chunks.setdefault(s, [])
        own.append({"phase": phase, "release": free, "deadline": due, "slot": slot})
        if len(own) == CHUNK or block + 1 == blocks[s]:
            full.append({"key": s, "chunk": block // CHUNK, "places": open_chunks.pop(s)})
        if len(full) == rows:
            yield pa.RecordBatch.from_pylist(full, shape)
            full = []
    yield pa.RecordBatch.from_pylist(full, shape)


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def placed(
    items: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_chars: int = BLOCK_CHARS,
    seed: int = 1,
) -> DataFrame:
    """Adds block, release, deadline, slot, phase and offset to rows (id, source, size, …).

    ``weights`` by source; None: tempered sizes. ``items`` is read three times. Order inside a
    source: hash of the id, then the id, then size, then column ``tie`` if there is one.
    """
    spark = items.sparkSession
    hashed = items.withColumn("key", _key(F.col("source").cast("string"))).withColumn(
        "mark", F.xxhash64(F.col("id"), F.lit(seed))
    )
    totals = {
        r["key"]: (r["rows"], r["chars"])
        for r in hashed.groupBy("key")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("chars"))
        .collect()
    }
    blocks = {k: max(chars - 1, 0) // block_chars + 1 for k, (_, chars) in totals.items()}
    if weights is None:
        wanted = tempered({k: chars for k, (_, chars) in totals.items()})
    else:
        wanted = {("" if s is None else f"={s}"): w for s, w in weights.items()}
        if lost := set(totals) - set(wanted):
            raise ValueError(f"no weight for {sorted(lost)}")
    table = spark.range(0, 1, 1, 1).mapInArrow(lambda _: _chunks(blocks, wanted), PLACES)
    table = cut_lineage(table, "schedule")
    if sum(blocks.values()) <= SENT_BLOCKS:
        table = F.broadcast(table)

    most = max((rows for rows, _ in totals.values()), default=1)
    bits = max(0, math.ceil(math.log2(max(1, most / PART_ROWS))))
    parts = hashed.withColumn("part", F.shiftrightunsigned("mark", 64 - bits) if bits else F.lit(0))
    sums = parts.select("key", "part", "size").groupBy("key", "part").agg(F.sum("size").alias("chars"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "key", "part", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("start")
    )
    ends = spark.createDataFrame([(k, n - 1) for k, n in blocks.items()], "key string, last bigint")
    starts = starts.join(F.broadcast(ends), "key")  # one row per source, like the weights
    inside = (
        Window.partitionBy("key", "part")
        .orderBy("mark", "id", "size", *[c for c in items.columns if c == "tie"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = (
        parts.join(starts, ["key", "part"])
        .withColumn(
            "offset", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        )
        # a last text of size zero may begin where its source ends
        .withColumn("block", F.least(F.floor(F.col("offset") / block_chars), "last"))
    )
    joined = numbered.withColumn("chunk", F.floor(F.col("block") / CHUNK)).join(
        table, ["key", "chunk"]
    )
    own = F.element_at("places", (F.col("block") % CHUNK + 1).cast("int"))
    return joined.withColumns(
        {n: own[n] for n in ("phase", "release", "deadline", "slot")}
    ).drop("places", "chunk", "key", "part", "start", "last", "mark", "tie")


def _items(docs: DataFrame, id_col: str, source: str, text: str, *more: str) -> DataFrame:
    packed = pack(
        docs,
        id=docs[id_col],
        source=docs[source],
        size=F.coalesce(F.length(docs[text].cast("string")), F.lit(0)).cast("bigint"),
        tie=F.xxhash64(docs[text]),
    )
    return packed.select("id", "source", "size", *more)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    items = cut_lineage(_items(documents(spark, sf_dir), "doc_id", "source", "text"), "sizes")
    return placed(items).select(
        F.col("id").alias("doc_id"),
        "source",
        F.col("size").alias("n_chars"),
        "offset",
        "block",
        "phase",
        "release",
        "deadline",
        "slot",
    )


def with_slots(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """All rows of ``docs`` with their place in the mixed order: by ``slot``, then ``offset``.

    ``docs`` is read three times, so hand in a table.
    """
    places = placed(_items(docs, id_col, source, text, ROW, "tie"), weights)
    return unpack(places, slot=F.col("slot"), offset=F.col("offset"))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """All rows of ``docs`` in the mixed order: across and within the files that are written.

    Readers do not keep that order; ``with_slots`` gives it as columns. ``docs`` is read three
    times, so hand in a table.
    """
    places = placed(_items(docs, id_col, source, text, ROW, "tie"), weights)
    ordered = places.repartitionByRange("slot", "offset", "id")
    return unpack(ordered.sortWithinPartitions("slot", "offset", "id"))
