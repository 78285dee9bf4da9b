"""Source divergence audit by a frequent-pattern tree of term rows.

A language keeps the terms that enough of its documents have. Each source of the language gives
each kept term a smoothed share (parts per 10**9, whole numbers). The audit reports, for each
source, its distance to every other source of the language (sum of absolute differences over all
kept terms) and the terms that it uses more than its language does.

A term row is its list of (source, share) over the sources that have the term, in source order.
Equal rows are counted, not repeated, and inserted into a tree by prefix: rows are dealt by
ranges and sorted, so a task meets shared prefixes one after another and holds only the branch
at hand. With z the share of a count of zero, the distance of sources a and b is

    V |za - zb|  +  sum over terms of a (|pa - zb| - |za - zb|)  +  the same for terms of b
                 +  sum over terms of both (|pa - pb| - |pa - zb| - |za - pb| + |za - zb|)

and the last sum is taken once per node and ancestor, times the rows below the node. A prefix that
two tasks share is two nodes there, which only splits a sum. Words are counted inside the tasks
before they are moved.

Defined cases: null text, language or source is read as ''. Every (language, source) that occurs
has rows, also without any term. Repeated rows count as documents of their own. Without kept
terms all distances are 0. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetide.llm.common import documents
from tonetide.session import cut_lineage

MIN_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP = 50
#: Entries a task holds before it hands them on (terms with counts; sums of source pairs).
HELD_TERMS = 200_000
HELD_PAIRS = 2_000_000
PIECE = 4 << 20
#: Entries of a path by which rows are dealt.
BEGINNING = 3

#: Bytes of terms: letters, with A-Z lower-cased, and everything outside ASCII; others part them.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes):
    """The terms of a text in UTF-8, in lists of a bounded piece of text each."""
    plain, at = text.translate(_LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
_COUNT_TYPE = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()),
     ("n", pa.int64()), ("docs", pa.int64())]
)


def _count_terms(batches):
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed_on():
        for (lang, source), (n, docs) in groups.items():
            # the empty term stands for the group itself
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(docs.__getitem__, n)], pa.int64()),
                ],
                schema=_COUNT_TYPE,
            )
        groups.clear()

    for batch in batches:
        langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
        for row, group in enumerate(zip(langs, sources)):
            n, docs = groups.setdefault(group, (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in terms_of(batch["text"][row].as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - before
            if held > HELD_TERMS:
                yield from handed_on()
                held = 0
    yield from handed_on()


def _share(count: Column, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + s) / (total + s * terms)), exact for counts of any size."""
    top = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = F.nullif(F.col(total) + SMOOTHING * F.col(terms), F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", top, below) + 1


class Audit:
    """Kept terms and sources of a table of texts.

    ``kept``: (lang, source, term, n, p, zero, n_lang, q); ``groups``: (lang, source, zero, terms).
    """

    def __init__(
        self,
        docs: DataFrame,
        lang: str = "lang",
        source: str = "source",
        text: str = "text",
        min_docs: int = MIN_DOCS,
    ):
        blank = F.lit("")
        texts = docs.select(
            F.coalesce(docs[lang].cast("string"), blank).alias("lang"),
            F.coalesce(docs[source].cast("string"), blank).alias("source"),
            F.coalesce(docs[text].cast("string"), blank).cast("binary").alias("text"),
        )
        # dealt by term once: sums by source and by language need no second shuffle
        counts = (
            texts.mapInArrow(_count_terms, COUNTS)
            .withColumn("term", F.col("term").cast("string"))
            .repartition("lang", "term")
            .groupBy("lang", "term", "source")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        )
        term = Window.partitionBy("lang", "term")
        found = counts.select(
            "lang",
            "term",
            "source",
            "n",
            F.sum("docs").over(term).alias("docs"),
            F.sum("n").over(term).alias("n_lang"),
            ((F.min("source").over(term) == F.col("source")) & (F.col("term") != "")).alias("first"),
        ).where((F.col("term") == "") | (F.col("docs") >= min_docs))
        found = cut_lineage(found.drop("docs"), "terms")
        whole = Window.partitionBy("lang")
        groups = (
            found.groupBy("lang", "source")
            .agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("bigint")).alias("terms"))
            .withColumn("terms", F.sum("terms").over(whole))
            .withColumn("total_lang", F.sum("total").over(whole))
        )
        groups = groups.withColumn("zero", _share(F.lit(0), "total", "terms"))
        self.groups = cut_lineage(groups, "sources")
        self.kept = (
            found.where("term <> ''")
            .join(self.groups, ["lang", "source"])
            .withColumn("p", _share(F.col("n"), "total", "terms"))
            .withColumn("q", _share(F.col("n_lang"), "total_lang", "terms"))
        )

    def rows(self) -> DataFrame:
        """(lang, path, rows): term rows with the number of terms that have them."""
        entry = F.struct("source", "p", "zero")
        row = self.kept.groupBy("lang", "term").agg(
            F.array_sort(F.collect_list(entry)).alias("path")
        )
        return row.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("rows"))

    def distances(self) -> DataFrame:
        """(lang, source, item, value) for each ordered pair of sources of a language."""
        one = self.groups.select("lang", "source", "zero", "terms")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("z"))
        base = one.join(other, "lang").where("source < item").select(
            "lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("zero") - F.col("z")), F.lit(0)).alias("value")
        )
        levels = self.kept.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("m"))
        alone = levels.join(other, "lang").where("source <> item").select(
            "lang",
            F.least("source", "item").alias("source"),
            F.greatest("source", "item").alias("item"),
            ((F.abs(F.col("p") - F.col("z")) - F.abs(F.col("zero") - F.col("z"))) * F.col("m")).alias("value"),
        )
        paths = self.rows().select(
            "lang", "path", F.col("path.source").alias("sources"), F.col("path.p").alias("p"),
            F.col("path.zero").alias("zero"), "rows",
        )
        tree = (
            paths.where(F.size("path") > 1)
            # borders come from short beginnings, so that the rows sampled for them stay small;
            # the hash parts rows of one common beginning
            .repartitionByRange("lang", F.slice("path", 1, BEGINNING), F.xxhash64("path"))
            .sortWithinPartitions("lang", "path")
            .drop("path")
            .mapInArrow(_corrections, "lang string, source string, item string, value bigint")
        )
        half = (
            base.union(alone).union(tree).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        )
        return half.select("lang", F.explode(F.array(
            F.struct("source", "item", "value"),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"),
        )).alias("pair")).select("lang", "pair.*")

    def marked_terms(self) -> DataFrame:
        """(lang, source, item, value): terms whose share exceeds the language's, and by how much."""
        return self.kept.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select(
            "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
        )

    def report(self, top: int = TOP) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        rank = F.row_number().over(order)
        parts = {
            "pair": self.distances().withColumn("rank", rank),
            "term": self.marked_terms().withColumn("rank", rank).where(F.col("rank") <= top),
        }
        pair, term = (
            df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
            for part, df in parts.items()
        )
        return pair.union(term)


class _Sums:
    """Corrections by pair of sources of one language, handed on when there are many."""

    def __init__(self):
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.sums: dict[int, np.ndarray] = {}

    def numbers(self, sources: list[str]) -> list[int]:
        for s in sources:
            if s not in self.number:
                self.number[s] = len(self.names)
                self.names.append(s)
        return [self.number[s] for s in sources]

    def add(self, node: int, ancestors: np.ndarray, values: np.ndarray) -> None:
        have = self.sums.get(node)
        if have is None or len(have) < len(self.names):
            wide = np.zeros(2 * len(self.names), np.int64)
            if have is not None:
                wide[: len(have)] = have
            have = self.sums[node] = wide
        have[ancestors] += values

    def full(self) -> bool:
        return 2 * len(self.names) * len(self.sums) > HELD_PAIRS

    def handed_on(self, lang: str):
        for node, values in self.sums.items():
            at = np.flatnonzero(values)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(at), pa.string()),
                        pa.array([self.names[i] for i in at], pa.string()),
                        pa.array([self.names[node]] * len(at), pa.string()),
                        pa.array(values[at]),
                    ],
                    ["lang", "source", "item", "value"],
                )
        self.sums.clear()


def _corrections(batches):
    """Walk the tree of sorted rows; a node that is left behind meets its ancestors once."""
    lang, sums = None, _Sums()
    node, p, zero, below = [], [], [], []  # the branch at hand, from the root

    def leave(depth: int) -> None:
        while len(node) > depth:
            n, share, z, m = node.pop(), p.pop(), zero.pop(), below.pop()
            if not node:
                break
            below[-1] += m
            pa_, za = np.array(p), np.array(zero)
            change = np.abs(pa_ - share) - np.abs(pa_ - z) - np.abs(za - share) + np.abs(za - z)
            sums.add(n, np.array(node), change * m)

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("lang", "sources", "p", "zero", "rows")]
        for row_lang, sources, row_p, row_zero, rows in zip(*columns):
            if row_lang != lang:
                leave(0)
                yield from sums.handed_on(lang)
                lang, sums = row_lang, _Sums()
            row = sums.numbers(sources)
            shared = 0
            for a, b, x, y in zip(node, row, p, row_p):
                if a != b or x != y:
                    break
                shared += 1
            leave(shared)
            if sums.full():
                yield from sums.handed_on(lang)
            node += row[shared:]
            p += row_p[shared:]
            zero += row_zero[shared:]
            below += [0] * (len(row) - shared)
            below[-1] += rows
    leave(0)
    yield from sums.handed_on(lang)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return Audit(documents(spark, sf_dir).select("lang", "source", "text")).report()


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
tokens AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= 30),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT lang, source, term, coalesce(n, 0) AS n
  FROM sources JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT *, (1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)
    + 5 * count(*) OVER (PARTITION BY lang, source)))::bigint AS p FROM grid),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
lang_shares AS (
  SELECT lang, term, (1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang)
    + 5 * count(*) OVER (PARTITION BY lang)))::bigint AS q FROM lang_counts),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::bigint AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
marked AS (
  SELECT lang, source, term AS item, p - q AS value FROM shares JOIN lang_shares USING (lang, term)
  WHERE n > 0 AND p > q),
parts AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM marked),
ranked AS (
  SELECT lang, source, part, item, value, (row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
