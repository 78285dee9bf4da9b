"""Column helpers and small numpy kernels for embedding vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector scaled to length one, as array<double>."""
    return F.transform(
        vector, lambda x: x.cast("double") / norm(vector)
    )


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (norm(left) * norm(right))


def matrix(vectors) -> np.ndarray:
    """Rows of unit length from a sequence of equally wide vectors."""
    rows = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def agreement(threshold: float) -> float:
    """Probability that a random plane has both vectors of a pair at ``threshold`` on one side."""
    return 1.0 - math.acos(threshold) / math.pi


def bands_needed(threshold: float, bits: int, miss: float, kept: float = 1.0) -> int:
    """Bands so that a pair at ``threshold`` is overlooked by all with probability ≤ ``miss``.

    ``kept``: probability that a band which holds the pair in one bucket also reports it.
    """
    share = min(kept * agreement(threshold) ** bits, 1.0 - 1e-9)
    return math.ceil(math.log(miss) / math.log1p(-share))


def _sign_codes(rows: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """One code per row and band of ``bits`` planes."""
    signs = (rows @ planes > 0).reshape(len(rows), planes.shape[1] // bits, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])


def band_codes(bits: int, bands: int, seed: int = 17):
    """Column function: vector → one hash code per band (signs against random planes)."""

    @F.pandas_udf("array<bigint>")
    def codes(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        rows = _rows(vectors)
        planes = np.random.default_rng(seed).standard_normal((rows.shape[1], bands * bits))
        return pd.Series(list(_sign_codes(rows, planes, bits)))

    return codes


def sub_codes(bits: int, subs: int, depth: int, seed: int = 17):
    """Column function: (vector, band) → one code per sub-band; every band has planes of its own."""

    @F.pandas_udf("array<bigint>")
    def codes(vectors: pd.Series, bands: pd.Series) -> pd.Series:
        out = np.zeros((len(vectors), subs), np.int64)
        if len(vectors):
            rows, of_row = _rows(vectors), bands.to_numpy()
            for band in np.unique(of_row):
                source = np.random.default_rng([seed, 1 + depth, int(band)])
                planes = source.standard_normal((rows.shape[1], subs * bits))
                here = of_row == band
                out[here] = _sign_codes(rows[here], planes, bits)
        return pd.Series(list(out))

    return codes


#: Texts whose tokens are counted at once.
TEXT_STEP = 200


def token_counts_to_unit(dim: int, step: int = TEXT_STEP):
    """Column function: array of tokens → unit vector of token counts in ``dim`` buckets.

    The bucket is the first eight md5 hex digits modulo ``dim``. Works on slices of Arrow batches,
    so that working arrays do not grow with the batch; each distinct token of a slice is hashed once.
    """

    def embedded(words: pa.Array) -> pa.Array:
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        bucket_of = np.array(
            [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()],
            dtype=np.int64,
        )
        rows = np.repeat(np.arange(len(words)), lengths)
        cells = rows * dim + bucket_of[coded.indices.to_numpy()]
        counts = np.bincount(cells, minlength=len(words) * dim).reshape(-1, dim)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        units = counts / np.where(length > 0, length, 1.0)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(words) + 1) * dim, pa.int32()),
            pa.array(units.ravel()),
            mask=pa.array(length[:, 0] == 0),
        )

    @F.arrow_udf("array<double>")
    def embed(words: pa.Array) -> pa.Array:
        return pa.concat_arrays([embedded(words.slice(at, step)) for at in range(0, max(len(words), 1), step)])

    return embed
