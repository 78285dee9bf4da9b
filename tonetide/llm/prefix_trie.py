"""Prefix trie of conversations by whole-sequence collapse.

A conversation is a sequence of turns (role, text). Identical conversations are collapsed into
one sequence with its number of members and the digest of their ids; a sequence that is a proper
prefix of another one is found by an anti-join against the prefixes, the rest are leaves. Only
then are prefixes made, one row per distinct sequence and depth, and aggregated with the weights
of the sequences: a prefix that many sequences have is combined before it is moved.

A turn is held as two 64-bit hashes of its place, role and text; a prefix is named by the
exclusive or of its turns' hashes (128 bits) and its length, so prefixes are running aggregates
and no task ever holds a sequence. Running aggregates work in chunks of turns and carry one row per
chunk, so that one very long conversation is spread too. Ids are digested from sorted runs: one
task streams the joined runs of a sequence, it holds none of them.

A subtree's sums need each node once: a node is owned by its least member (the sequence that it
is named after), owners collect what their nodes are worth, and the sum over the sequences that
pass a node is corrected by what its owner's nodes above it are worth.

Defined cases: turns are ordered by turn (null first), ties by role and text; repeated rows are
turns of their own. Null role or text is read as ''. Rows without conversation id belong to no
conversation. A conversation without turns ends at the root. An empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetide.llm.common import small_batches
from tonetide.session import cut_lineage

CHUNK = 4_096
RUN = 4_096
#: Conversations share the head of the first one of their hundred.
GROUP = 100
HEADS = 6
NODE = ["d1", "d2", "depth"]


def _chunked(df: DataFrame, key: str, chunk: Column, order: list, measures: dict) -> DataFrame:
    """Running aggregates within ``key``: inside chunks, plus one carried row per chunk.

    ``measures``: name -> (aggregate function, column, combination of carried and inner value).
    ``chunk`` must grow with the first column of ``order``.
    """
    split = df.withColumn("chunk", chunk)
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = split.groupBy(key, "chunk").agg(
        *[f(c).alias(f"whole_{n}") for n, (f, c, _) in measures.items()]
    )
    carried = carried.select(
        key,
        "chunk",
        *[
            F.coalesce((F.sum if f is F.count else f)(f"whole_{n}").over(before), F.lit(0)).alias(
                f"carried_{n}"
            )
            for n, (f, _, _) in measures.items()
        ],
    )
    inside = Window.partitionBy(key, "chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = split.repartition(key, "chunk").join(carried, [key, "chunk"])
    return joined.select(
        *df.columns,
        *[join(F.col(f"carried_{n}"), f(c).over(inside)).alias(n) for n, (f, c, join) in measures.items()],
    )


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def turns_of(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, pos, h1, h2, chars): turns by place, without their texts."""
    blank = F.lit("")
    rows = conversations.select(
        conversations[conv_id].cast("bigint").alias("conv_id"),
        conversations[turn].cast("bigint").alias("turn"),
        F.coalesce(conversations[role].cast("string"), blank).alias("role"),
        F.coalesce(conversations[text].cast("string"), blank).alias("text"),
    ).where("conv_id is not null")
    chunk = F.coalesce(F.expr(f"turn div {CHUNK}"), F.lit(-(1 << 62)))
    placed = _chunked(
        rows, "conv_id", chunk, [F.asc_nulls_first("turn"), "role", "text"],
        {"pos": (F.count, F.lit(1), _plus)},
    )
    return placed.select(
        "conv_id",
        "pos",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), F.col("role"), F.col("text")).alias("h2"),
        F.length("text").cast("bigint").alias("chars"),
    )


def with_shared_heads(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Conversations rebuilt: the head comes from the first conversation of the ``group``.

    The head has as many turns as the id's CRC-32 modulo ``heads``; the conversation's own turns
    follow after its own head. Gives turns and, for each conversation, a start row (pos 0).
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    )
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn(
        "head", F.least("h", F.coalesce("n_base", F.lit(0)))
    )
    convs = cut_lineage(convs, "conversations")
    shared = turns.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0))
    heads_of = convs.select("conv_id", "base", "head").join(
        shared.withColumnRenamed("conv_id", "base"), "base"
    )
    columns = ["conv_id", "pos", "h1", "h2", "chars"]
    own = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h")
    start = convs.select(
        "conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("h1"),
        F.lit(0).cast("bigint").alias("h2"), F.lit(0).cast("bigint").alias("chars"),
    )
    return (
        start.union(heads_of.where("pos <= head").select(columns))
        .union(own.withColumn("pos", F.col("pos") - F.col("h") + F.col("head")).select(columns))
    )


def with_starts(turns: DataFrame) -> DataFrame:
    """Turns as they are, with a start row for each conversation."""
    none = F.lit(0).cast("bigint")
    starts = turns.select("conv_id").distinct().select(
        "conv_id", none.alias("pos"), none.alias("h1"), none.alias("h2"), none.alias("chars")
    )
    return turns.union(starts)


class Trie:
    """Trie of turns with start rows (``conv_id, pos, h1, h2, chars``).

    ``sequences``: (d1, d2, depth, rep, weight), distinct whole conversations; ``rep`` is the
    least member. ``prefixes``: their prefixes with the depth's turn.
    """

    def __init__(self, turns: DataFrame):
        placed = turns.select(
            "conv_id",
            F.col("pos").alias("depth"),
            # a start row changes nothing: its hashes are zero
            F.when(F.col("pos") > 0, F.xxhash64("pos", "h1", "h2")).otherwise(0).alias("x1"),
            F.when(F.col("pos") > 0, F.xxhash64(F.lit(2), F.col("h2"), F.col("pos"), F.col("h1")))
            .otherwise(0)
            .alias("x2"),
            "chars",
        )
        placed = cut_lineage(placed, "turns")
        whole = placed.groupBy("conv_id").agg(
            F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"), F.max("depth").alias("depth")
        )
        self.whole = cut_lineage(whole, "wholes")
        sequences = self.whole.groupBy(*NODE).agg(
            F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")
        )
        self.sequences = cut_lineage(sequences, "sequences")
        some = placed.withColumnRenamed("conv_id", "rep").join(
            self.sequences.select("rep", "weight", F.col("depth").alias("length")), "rep"
        )
        chunk = F.expr(f"depth div {CHUNK}")
        running = _chunked(
            some, "rep", chunk, ["depth"],
            {"d1": (F.bit_xor, "x1", _xor), "d2": (F.bit_xor, "x2", _xor)},
        )
        self.prefixes = cut_lineage(running, "prefixes")
        nodes = self.prefixes.groupBy(*NODE).agg(
            F.min("rep").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.max("chars").alias("chars"),
            F.min(F.col("d1").bitwiseXOR(F.col("x1"))).alias("p1"),
            F.min(F.col("d2").bitwiseXOR(F.col("x2"))).alias("p2"),
            F.max(F.col("depth") < F.col("length")).alias("inner"),
        )
        self.nodes = cut_lineage(nodes, "nodes")

    def leaves(self) -> DataFrame:
        """Sequences that are no proper prefix of another one."""
        return self.sequences.join(self.nodes.where("inner"), NODE, "left_anti")

    def ends(self) -> DataFrame:
        """(d1, d2, depth, ends): SHA-256 of each sequence's member ids, ascending."""
        node = "d1 bigint, d2 bigint, depth bigint"
        runs = (
            self.whole.repartitionByRange(*NODE, "conv_id")
            .sortWithinPartitions(*NODE, "conv_id")
            .select(*NODE, "conv_id")
            .mapInArrow(_runs, f"{node}, first bigint, ids string")
        )
        return (
            runs.repartition(*NODE)
            .sortWithinPartitions(*NODE, "first")
            .mapInArrow(_digests, f"{node}, ends string")
        )

    def report(self) -> DataFrame:
        """One row per node: members, children, leaves, tokens that sharing the node's subtree
        saves (in characters), digest of the members that end there."""
        root = self.nodes.where("depth = 0").select("conv_id").first()
        value = ((F.col("n_convs") - 1) * F.col("chars")).alias("value")
        worth = self.nodes.select("*", value)
        totals = worth.groupBy(F.col("conv_id").alias("rep")).agg(F.sum("value").alias("total"))
        owners = self.sequences.select("rep").join(totals, "rep", "left").join(
            self.leaves().select("rep", F.lit(1).cast("bigint").alias("leaf")), "rep", "left"
        )
        passed = self.prefixes.select("rep", *NODE).join(owners, "rep")
        above = _chunked(
            worth, "conv_id", F.expr(f"depth div {CHUNK}"), ["depth"],
            {"upto": (F.sum, "value", _plus)},
        ).withColumn("above", F.col("upto") - F.col("value"))
        # the first node that an owner has hangs on another owner's node; the root's children
        # need no join, the others' parents are looked up
        tops = worth.groupBy("conv_id").agg(F.min("depth").alias("top"))
        parents = self.nodes.where("inner").select(
            F.col("d1").alias("p1"), F.col("d2").alias("p2"), (F.col("depth") + 1).alias("depth"),
            F.col("conv_id").alias("other"),
        )
        hung = self.nodes.where("depth > 1").join(
            tops.withColumnRenamed("top", "depth"), ["conv_id", "depth"], "left_semi"
        )
        adopted = hung.join(parents, ["p1", "p2", "depth"]).select(*NODE, "other")

        def rows(df: DataFrame, **columns: Column) -> DataFrame:
            empty = {c: F.lit(None).cast(t) for c, t in _PARTS.items()}
            return df.select(*[c.alias(n) for n, c in {**{k: F.col(k) for k in NODE}, **empty, **columns}.items()])

        one = F.lit(1).cast("bigint")
        parts = [
            rows(above, **{c: F.col(c) for c in ("conv_id", "n_convs", "above")}),
            rows(passed, total=F.col("total"), leaf=F.col("leaf")),
            rows(
                self.nodes.where("depth > 0"),
                d1=F.col("p1"), d2=F.col("p2"), depth=F.col("depth") - 1, child=one,
            ),
            rows(adopted, other=F.col("other")),
            rows(self.ends(), ends=F.col("ends")),
        ]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.union(part)
        whole = merged.groupBy(*NODE).agg(
            F.max("conv_id").alias("conv_id"),
            F.max("n_convs").alias("n_convs"),
            F.max("other").alias("other"),
            F.coalesce(F.sum("child"), F.lit(0)).alias("n_children"),
            F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
            (F.coalesce(F.sum("total"), F.lit(0)) - F.max("above")).alias("saved_tokens"),
            F.coalesce(F.max("ends"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        first = F.lit(root[0] if root else None).cast("bigint")
        parent = F.when(F.col("depth") == 1, first).when(
            F.col("depth") > 1, F.coalesce("other", "conv_id")
        )
        return whole.select(
            "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
            "n_leaves", "saved_tokens", "ends_sha256",
        )


_PARTS = {
    "conv_id": "bigint", "n_convs": "bigint", "above": "bigint", "total": "bigint",
    "leaf": "bigint", "child": "bigint", "other": "bigint", "ends": "string",
}


def _runs(batches):
    """Sorted (node, id) rows as joined ids, at most RUN of them together."""
    for batch in batches:
        columns = [batch[c].to_pylist() for c in (*NODE, "conv_id")]
        out, node, ids = [], None, []
        for *row, number in zip(*columns):
            if row != node or len(ids) == RUN:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = row, []
            ids.append(number)
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield _table(out, [*NODE, "first", "ids"])


def _digests(batches):
    """SHA-256 over the joined runs of each node, as they stream by."""
    node, sha = None, None
    for batch in batches:
        done = []
        for *row, ids in zip(*[batch[c].to_pylist() for c in (*NODE, "ids")]):
            if row != node:
                if sha:
                    done.append((*node, sha.hexdigest()))
                node, sha = row, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if done:
            yield _table(done, [*NODE, "ends"])
    if sha:
        yield _table([(*node, sha.hexdigest())], [*NODE, "ends"])


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if isinstance(v, str) else pa.int64() for v in rows[0]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = cut_lineage(turns_of(conversations), "placed")
    return Trie(with_shared_heads(turns)).report()


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list(said ORDER BY pos) AS own, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(conv_id::varchar) + 1),
      lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, none: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
members AS (
  SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt),
nodes AS (
  SELECT depth, seq[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth) AS ends
  FROM members GROUP BY 1, 2),
children AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
marked AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
    CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(p[n.depth].text) ELSE 0 END AS value
  FROM nodes n LEFT JOIN children c USING (p, depth)),
subtrees AS (
  SELECT up AS depth, p[1:up] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(value) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM marked) GROUP BY ALL)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
  s.saved::bigint AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM marked m JOIN subtrees s USING (p, depth)
LEFT JOIN nodes q ON q.depth = m.depth - 1 AND q.p = m.p[1:m.depth - 1]
"""
