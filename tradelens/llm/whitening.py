"""Whitening of vectors: principal components from merged moments, projected to unit variance.

Entries become whole numbers, ``floor(1024 * c) + 100000``, so sums are exact. Each task turns its
vectors into a count, exact sums, local means and the centred scatter matrix; two such moments are
merged by the pairwise formula (Chan, Golub, LeVeque), in a tree, so the driver gets a few d x d
matrices however many tasks there are. It finds eigenvectors; a second pass projects all vectors
and checks, by the same merging, that the covariance of the projections is the identity.

Vectors that are null, or hold null or non-finite entries, are left out; so are those with an entry
whose whole number needs more than 64 bits, and those whose length differs from that of most vectors
(of equally frequent lengths, the smaller). Repeated rows count as often as they occur. A null id
stays null. Components of no variance (below 1e-12 of the trace, as for a single vector) are left
out, so there may be fewer than asked for; without any, or without vectors, there are no rows. The
sign of a component makes its largest entry positive. Components of equal variance are those that
LAPACK gives. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
_SAFE = 1 << 62
_WIDE = Context(prec=60)


class Moments:
    """Count, exact sums and centred scatter of whole vectors."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray):
        self.n, self.sums, self.scatter = n, sums, scatter

    @property
    def mean(self) -> list[tuple[int, int]]:
        """Whole part and rest of each mean, over n: differences of means lose no digits."""
        return [divmod(s, self.n) for s in self.sums]

    def merge(self, other: Moments) -> Moments:
        """Both together: scatters add up, and so does what the distance of the two means makes."""
        a, b = self.mean, other.mean
        apart = np.array([(q - p) + (s / other.n - r / self.n) for (p, r), (q, s) in zip(a, b, strict=True)])
        n = self.n + other.n
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [x + y for x, y in zip(self.sums, other.sums, strict=True)], scatter)


def moments(x: np.ndarray) -> Moments:
    """Of the rows of a matrix of longs."""
    n = len(x)
    safe = abs(int(x.max())) < _SAFE // n and abs(int(x.min())) < _SAFE // n
    sums = x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist()
    apart = (x * n - np.array(sums)) / n if safe else ((x.astype(object) * n - np.array(sums, object)) / n).astype(float)
    return Moments(n, sums, apart.T @ apart)


class Spread:
    """Count, mean and centred scatter of vectors of doubles."""

    def __init__(self, n: int, mean: np.ndarray, scatter: np.ndarray):
        self.n, self.mean, self.scatter = n, mean, scatter

    def merge(self, other: Spread) -> Spread:
        n, apart = self.n + other.n, other.mean - self.mean
        return Spread(n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


def spread(x: np.ndarray) -> Spread:
    mean = x.mean(axis=0)
    apart = x - mean
    return Spread(len(x), mean, apart.T @ apart)


def tree(parts: DataFrame, size: int, merge, most: int = 64 << 20):
    """Merge the pickled rows of ``parts``, one a task at most, in a tree.

    It has as many levels as it takes for the driver to get about ``most`` bytes, with ``size`` each.
    """
    rdd = parts.rdd.map(lambda row: _loads(row[0]))
    reach = max(2, most // max(1, size))
    depth = max(2, math.ceil(math.log(max(2, rdd.getNumPartitions())) / math.log(reach)))
    return rdd.treeReduce(merge, depth)


def _loads(raw: bytes):
    import pickle

    return pickle.loads(bytes(raw))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The whole numbers of a batch of usable vectors."""
    flat = pc.cast(batch.column("x").flatten(), pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _partial(dim: int, of, start):
    """One pickled summary of a whole task: batches are merged as they come."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        whole = None
        for batch in batches:
            if batch.num_rows:
                own = of(start(_matrix(batch, dim)))
                whole = own if whole is None else whole.merge(own)
        if whole is not None:
            yield pa.record_batch([pa.array([pickle.dumps(whole)], pa.binary())], ["part"])

    return work


class Projection:
    """``(n * x - S) / n`` on the components, over the roots of their variances; the deviation beside it."""

    def __init__(self, fit: Moments, vectors: np.ndarray, values: np.ndarray):
        self.n, self.sums = fit.n, fit.sums
        self.turn = vectors / np.sqrt(values)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: longs where they suffice."""
        most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
        if most * self.n + max(map(abs, self.sums)) < _SAFE:
            return x * self.n - np.array(self.sums)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(float) @ self.turn

    def deviation(self, apart: np.ndarray) -> pa.Array:
        """Sums of squares, exact up to 38 digits."""
        kind = pa.decimal128(38, 0)
        if apart.dtype != object and apart.size and math.isqrt(_SAFE // apart.shape[1]) > max(abs(int(apart.max())), abs(int(apart.min()))):
            return pc.cast(pa.array((apart * apart).sum(axis=1)), kind)
        sums = [sum(int(v) ** 2 for v in row) for row in apart]
        return pa.array([_WIDE.create_decimal(s) if s < 10**38 else None for s in sums], kind)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): entries as whole numbers; rows without a usable vector are left out."""
    # a double below 2^63 / 1024 keeps the product in 64 bits
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**52))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("c"))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", fine))
    return rows.select("id", F.transform("c", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x"))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error): one row a vector, with an array entry a component."""
    rows = usable(vectors, id_col, vector_col)
    ddl = f"{id_col} {dict(vectors.dtypes)[id_col]}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], ddl)
    dim = lengths["dim"]
    rows = rows.where(F.size("x") == dim)
    parts = rows.select("x").mapInArrow(_partial(dim, moments, lambda x: x), "part binary")
    fit = tree(parts, 8 * dim * dim, Moments.merge)
    values, axes = np.linalg.eigh(fit.scatter / fit.n)
    trace = float(np.trace(fit.scatter)) / fit.n
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > 1e-12 * trace]
    if not order:
        return spark.createDataFrame([], ddl)
    values, axes = values[order], axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    turn = Projection(fit, axes, values)
    checks = rows.select("x").mapInArrow(_partial(dim, spread, lambda x: turn.whitened(turn.apart(x))), "part binary")
    seen = tree(checks, 8 * len(order) ** 2, Spread.merge)
    error = float(np.abs(seen.scatter / seen.n - np.eye(len(order))).max())
    explained = (values / trace).tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = turn.apart(_matrix(batch, dim))
            white = turn.whitened(apart)
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), white.ravel())
            yield pa.record_batch([batch.column("id"), turn.deviation(apart), lists], ["id", "deviation", "whitened"])

    out = rows.mapInArrow(work, f"id {dict(vectors.dtypes)[id_col]}, deviation decimal(38,0), whitened array<double>")
    return out.select(
        F.col("id").alias(id_col), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).alias("identity_error"),
    )


def by_component(white: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row a vector and component, numbered from 1; a deviation beyond 64 bits is null."""
    each = white.select(id_col, "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("k", "value"))
    return each.select(id_col, (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.col("explained")[F.col("k")].alias("explained"), "identity_error")
