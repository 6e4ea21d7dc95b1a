"""Vector columns: cleaning, unit vectors, and spherical k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # rows, on average, that centres are fitted on


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part.

    Left out: null ids, null vectors, vectors of zeros or with a null, NaN or
    infinite component, and vectors of another length than most (of the longest
    of the most common lengths).
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    )
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.filter(F.size("v") == (common["n"] if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True) if x.size else 1.0
    x = x / top  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, in the same order of operations for each, whatever else is compared."""
    out = np.empty(len(a))
    for at in range(0, len(a), 16384):
        x, y = a[at : at + 16384], b[at : at + 16384]
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        dot, xx, yy = (np.cumsum(p, axis=1)[:, -1] for p in (x * y, x * x, y * y))
        out[at : at + 16384] = dot / (np.sqrt(xx) * np.sqrt(yy))
    return out


def sample(vectors: DataFrame, n: int, bound: int = SAMPLE, seed: int = 3) -> np.ndarray:
    """Unit vectors of about ``bound`` rows, chosen by a hash of the id."""
    share = min(1.0, bound / max(n, 1))
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    table = vectors.filter(draw < share).orderBy("vec_id").limit(2 * bound).select("v").toArrow()
    return unit(matrix(table["v"])) if table.num_rows else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres; fewer than k if points coincide."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return np.unique(centres, axis=0)
