"""A stored table of vectors in groups around centres, searched exactly.

Rows are partitioned by their nearest centre; each group's radius is stored. On unit vectors the
length of the difference is a metric and grows with the cosine distance, so no member of a group
is nearer to a query than the centre's distance less the radius. A search reads the groups nearest
to a query that hold k rows, which bounds its k-th distance, and then only groups that can hold
something nearer. Groups that cannot are skipped; the result is that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonetide.functions.vectors import matrix
from tonetide.operators.vectors import (
    BLOCK_ROWS,
    HITS,
    QUERY_BYTES_BOUND,
    BestSoFar,
    hits_frame,
    nearest_in,
    split_vectors,
    usual_width,
)
from tonetide.session import cut_lineage
from tonetide.sources.files import stored

#: Centres at most, so that they travel with tasks; rows that centres are fitted on, in the mean.
MOST_GROUPS, SAMPLE_ROWS, ROUNDS = 1024, 20_000, 6
#: Above the rounding of distances: groups this near to the bound are read all the same.
SLACK = 1e-7
GROUP, AWAY = "vector_group", "centre_distance"
STEPS = 1_000_003


def fit_centres(rows: np.ndarray, groups: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centres by alternating assignment and means, from different rows of the sample."""
    different = np.unique(rows, axis=0)
    pick = np.random.default_rng(seed).permutation(len(different))[:groups]
    centres = different[np.sort(pick)]
    for _ in range(rounds):
        of_row = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of_row, rows)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), centres)
    return centres


def chords(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lengths of the differences of unit rows."""
    return np.sqrt(np.maximum(2.0 - 2.0 * left @ right.T, 0.0))


@dataclass(frozen=True)
class Layout:
    """The groups that hold rows: ids, rows, radii and unit centres. Travels with tasks."""

    ids: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    centres: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def first_groups(self, queries: np.ndarray, k: int) -> list[list[int]]:
        """Per query the nearest groups that together hold k rows (all, if there are fewer)."""
        away = chords(queries, self.centres)
        order = away.argsort(axis=1, kind="stable")
        filled = self.counts[order].cumsum(axis=1)
        need = (filled < k).sum(axis=1) + 1
        return [self.ids[o[:n]].tolist() for o, n in zip(order, need)]

    def further_groups(self, queries: np.ndarray, kth: np.ndarray, k: int) -> list[list[int]]:
        """Per query the other groups that may hold a row at its ``kth`` distance or nearer."""
        nearest = np.maximum(chords(queries, self.centres) - self.radii, 0.0)
        can = nearest * nearest / 2.0 <= kth[:, None] + SLACK
        first = self.first_groups(queries, k)
        return [[g for g in self.ids[c].tolist() if g not in f] for c, f in zip(can, map(set, first))]


class VectorGroups:
    """Vectors by ``vec_id``; open a stored table with ``VectorGroups(spark, path)``."""

    def __init__(self, spark: SparkSession, path: str):
        found = stored(spark, f"{path}/groups")
        if found is None:
            raise FileNotFoundError(f"no vector groups at {path}")
        rows = found.orderBy(GROUP).collect()  # at most MOST_GROUPS
        self.spark, self.path = spark, path
        self.layout = Layout(
            np.array([r[GROUP] for r in rows], np.int64),
            np.array([r["n"] for r in rows], np.int64),
            np.array([r["radius"] for r in rows], float),
            matrix([r["centre"] for r in rows]) if rows else np.zeros((0, 0)),
        )

    @classmethod
    def build(
        cls, spark: SparkSession, path: str, corpus: DataFrame, groups: int | None = None,
        sample_rows: int = SAMPLE_ROWS, dim: int | None = None,
    ):
        """Store all usable vectors of ``corpus`` (vec_id, embedding, …) in groups.

        Centres are fitted on a sample of some ``sample_rows`` rows chosen by a hash of the id; every
        row is stored. Default number of groups: the root of the rows, at most ``MOST_GROUPS``.
        Vectors that are NULL, zero or not ``dim`` wide (None: the usual width) are left out, as in
        ``split_vectors``; an empty table gives an empty index.
        """
        dim = usual_width(corpus) if dim is None else dim
        rows, _ = split_vectors(corpus, dim)
        count = rows.count()
        groups = groups or max(1, min(MOST_GROUPS, math.isqrt(count)))
        share = math.ceil(STEPS * min(1.0, max(sample_rows, groups) / max(count, 1)))
        chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(STEPS)) < share)
        sample = chosen.select("vec_id", "embedding").toPandas().sort_values("vec_id")
        if count and sample.empty:
            sample = rows.select("vec_id", "embedding").limit(groups).toPandas()
        centres = fit_centres(matrix(sample["embedding"]), groups) if count else np.zeros((0, dim))

        @F.pandas_udf(f"{GROUP} int, {AWAY} double")
        def nearest(vectors: pd.Series) -> pd.DataFrame:
            if not len(vectors):
                return pd.DataFrame({GROUP: [], AWAY: []})
            away = chords(matrix(vectors), centres)
            return pd.DataFrame({GROUP: away.argmin(axis=1), AWAY: away.min(axis=1)})

        placed = rows.withColumn("__at", nearest("embedding")).select(*rows.columns, "__at.*")
        # a range may hold part of a group, so a group with a third of all rows is many files
        dealt = placed.repartitionByRange(GROUP, F.xxhash64("vec_id"))
        dealt.write.partitionBy(GROUP).mode("overwrite").parquet(f"{path}/rows")
        written = stored(spark, f"{path}/rows", placed.schema)
        facts = [] if written is None else written.groupBy(GROUP).agg(
            F.count(F.lit(1)).alias("n"), F.max(AWAY).alias("radius")
        ).collect()
        table = [(r[GROUP], centres[r[GROUP]].tolist(), r["n"], r["radius"]) for r in facts]
        spark.createDataFrame(table, f"{GROUP} int, centre array<double>, n long, radius double").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/groups")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    # --- search ---------------------------------------------------------------------

    def search(
        self, queries: DataFrame, k: int = 10, metadata: Sequence[str] = (),
        query_bytes_bound: int = QUERY_BYTES_BOUND, block_rows: int = BLOCK_ROWS,
    ) -> DataFrame:
        """Exact k nearest of every query: query_id, vec_id, distance, similarity, rank, ``metadata``.

        Query tables below the measured bound travel with the tasks, and the scan reads only the
        partitions of the groups asked for; larger ones are joined with the groups they ask for,
        block by block. Ties: smaller id first.
        """
        dim = self.layout.dim
        if not dim:
            queries = queries.limit(0)
        asked, _ = split_vectors(queries.select("query_id", "embedding"), dim)
        if asked.count() * dim * 8 <= query_bytes_bound:
            hits = self._small(asked, k)
        else:
            hits = self._large(cut_lineage(asked, "queries"), k, block_rows)
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        found = (
            hits.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .withColumn("similarity", 1.0 - F.col("distance"))
        )
        if not metadata:
            return found
        return found.join(self.rows().select("vec_id", *metadata), "vec_id")

    def _small(self, asked: DataFrame, k: int) -> DataFrame:
        rows = asked.collect()  # bounded by the caller's measure
        if not rows:
            return self.spark.createDataFrame([], HITS)
        query_ids = np.array([r["query_id"] for r in rows])
        vectors = matrix([r["embedding"] for r in rows])
        first = cut_lineage(self._scan(query_ids, vectors, self.layout.first_groups(vectors, k), k), "first-hits")
        kth = dict(_kth(first, k).collect())
        bound = np.array([kth.get(q, np.inf) for q in query_ids.tolist()])
        further = self.layout.further_groups(vectors, bound, k)
        if not any(further):
            return first
        return first.unionByName(self._scan(query_ids, vectors, further, k))

    def _scan(self, query_ids, vectors, wanted: list[list[int]], k: int) -> DataFrame:
        askers: dict[int, list[int]] = {}
        for place, groups in enumerate(wanted):
            for g in groups:
                askers.setdefault(g, []).append(place)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = BestSoFar(k, len(query_ids))
            for batch in batches:
                for group, part in batch.groupby(GROUP):
                    places = askers[group]
                    best.add(
                        nearest_in(
                            query_ids[places], vectors[places],
                            part["vec_id"].to_numpy(), matrix(part["embedding"]), k,
                        )
                    )
            if best.parts:
                yield hits_frame(*best.best())

        chosen = self.rows().where(F.col(GROUP).isin(sorted(askers)))
        return chosen.select("vec_id", "embedding", GROUP).mapInPandas(scan, HITS)

    def _large(self, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
        layout = self.layout

        @F.pandas_udf("array<int>")
        def first_of(vectors: pd.Series) -> pd.Series:
            return pd.Series(layout.first_groups(matrix(vectors), k) if len(vectors) else [], dtype=object)

        @F.pandas_udf("array<int>")
        def further_of(vectors: pd.Series, kth: pd.Series) -> pd.Series:
            found = layout.further_groups(matrix(vectors), kth.to_numpy(), k) if len(vectors) else []
            return pd.Series(found, dtype=object)

        first = asked.withColumn(GROUP, F.explode(first_of("embedding")))
        hits = cut_lineage(self._join(first, k, block_rows), "first-hits")
        bound = asked.join(_kth(hits, k), "query_id", "left").withColumn(
            "kth", F.coalesce("kth", F.lit(math.inf))
        )
        further = bound.withColumn(GROUP, F.explode(further_of("embedding", "kth"))).drop("kth")
        return hits.unionByName(self._join(further, k, block_rows))

    def _join(self, asks: DataFrame, k: int, block_rows: int) -> DataFrame:
        """Queries against the groups they ask for; both sides of a group are cut into blocks."""
        asks = cut_lineage(asks, "asks")
        n_asks = dict(asks.groupBy(GROUP).count().collect())  # at most MOST_GROUPS
        blocks = [
            (int(g), -(-n_asks[int(g)] // block_rows), -(-int(n) // block_rows))
            for g, n in zip(self.layout.ids, self.layout.counts) if int(g) in n_asks
        ]
        parts = F.broadcast(self.spark.createDataFrame(blocks, f"{GROUP} int, n_q int, n_v int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = asks.join(parts, GROUP).select(
            "query_id", "embedding", GROUP, own("query_id", "n_q").alias("q"), every("n_v").alias("v")
        )
        right = self.rows().join(parts, GROUP).select(
            "vec_id", "embedding", GROUP, every("n_q").alias("q"), own("vec_id", "n_v").alias("v")
        )

        def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return hits_frame(*nearest_in([], None, None, None, k))
            return hits_frame(
                *nearest_in(
                    a["query_id"].to_numpy(), matrix(a["embedding"]),
                    b["vec_id"].to_numpy(), matrix(b["embedding"]), k,
                )
            )

        keys = [GROUP, "q", "v"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, HITS)


def _kth(hits: DataFrame, k: int) -> DataFrame:
    """The k-th distance of each query that has k hits."""
    order = Window.partitionBy("query_id").orderBy("distance")
    ranked = hits.select("query_id", "distance", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))

