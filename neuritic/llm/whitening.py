"""Embedding whitening: leading components of a covariance by matrix-free block subspace iteration.

The covariance V of the vectors is never formed. Each pass over the table computes V Q = Xᵀ(XQ)/n for a block Q of orthonormal
columns on centred rows; sums over a task's rows are a matrix of dimension by block, and Spark adds these up. Rayleigh-Ritz
on the block gives estimates of components and eigenvalues, and the product itself gives their residuals |Vu - eu|; the next block is the
Rayleigh-Ritz vectors, multiplied by V and made orthonormal by QR. It ends when all components' residuals
are below the tolerance. Where the eigenvalues say that this takes too many passes, the block is widened by random columns, up to
the whole space, where one pass suffices.

Means are exact: vectors are whole numbers, their sums are decimal, and a row is centred as the whole number (x - mean rounded
down) less a fraction. What goes through the driver has the size of a block.

Results in corner cases: vectors that are null or hold null or non-finite entries are dropped; short vectors count as
filled up with zeros; null and repeated ids are rows like others; components whose eigenvalue isn't above 1e-12 of the
largest are none (as many vectors as dimensions or fewer, constant entries), so equal vectors or one alone give no rows; an
empty table gives an empty result; other columns are ignored. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense, drop_stored, finite, pick, stored, table

#: Rows that are multiplied together in a task.
ROWS = 4096
#: Eigenvalues up to this share of the largest count as 0.
NONE = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Centre:
    """Number of vectors, dimension, largest magnitude of an entry, and of each dimension the mean rounded down, the rest
    of the sum over n, and the variance's sum n * sum(x*x) - sum(x)**2."""

    n: int
    width: int
    top: int
    low: tuple[int, ...]
    rest: tuple[int, ...]
    spread: tuple[int, ...]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean."""
        return (x - np.array(self.low, dtype=np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n*x - sum)**2, exactly."""
        most = self.n * 2 * (self.top + 1)
        kind = np.int64 if most * most * max(1, self.width) < 1 << 63 else object
        away = self.n * (x - np.array(self.low, dtype=np.int64)).astype(kind) - np.array(self.rest, dtype=kind)
        return [int(v) if int(v) < 1 << 63 else None for v in (away * away).sum(axis=1)]

    @property
    def trace(self) -> float:
        return sum(self.spread) / self.n**2


@dataclass(frozen=True)
class Basis:
    """Eigenvalues (falling), eigenvectors (columns), the largest residual over the largest eigenvalue after each pass, and the width of each pass's block."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: tuple[float, ...]
    widths: tuple[int, ...]


def whole_numbers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, x: the vectors that take part, as arrays of floor(scale * entry), in a stored table."""
    rows = pick(vectors, "vec_id", "embedding").filter(finite("embedding"))
    return stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")), "vectors")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A task's rows, and their vectors as matrices of about ROWS rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            part = pa.Table.from_batches(held)
            yield part, dense(part["x"], width)
            held, n = [], 0
    if n:
        part = pa.Table.from_batches(held)
        yield part, dense(part["x"], width)


def centre(x: DataFrame) -> Centre | None:
    """Exact sums of a table of whole_numbers(); None if it has no rows or no entries."""
    magnitude = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: F.greatest(a, F.abs(v)))
    n, width, top = x.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(magnitude)).first()
    if not n or not width:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = [0] * width, [0] * width
        for _, m in _matrices(batches, width):
            m = m if (top + 1) ** 2 * len(m) < 1 << 63 else m.astype(object)
            sums = [a + int(b) for a, b in zip(sums, m.sum(axis=0), strict=True)]
            squares = [a + int(b) for a, b in zip(squares, (m * m).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "s": [str(v) for v in sums], "q": [str(v) for v in squares]})

    parts = x.select("x").mapInArrow(run, "i int, s string, q string")
    found = sorted(parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect())
    s, q = [int(r["s"]) for r in found], [int(r["q"]) for r in found]
    return Centre(n, width, top, tuple(v // n for v in s), tuple(v % n for v in s), tuple(n * b - a * a for a, b in zip(s, q, strict=True)))


def _summed(x: DataFrame, of: Centre, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a matrix that follows from centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, m in _matrices(batches, of.width):
            total += each(of.rows(m))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(shape[0]), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    parts = x.select("x").mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros(shape)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def product(x: DataFrame, of: Centre, q: np.ndarray) -> np.ndarray:
    """V Q, in one pass over the rows."""
    return _summed(x, of, lambda z: z.T @ (z @ q), q.shape) / of.n


def components(x: DataFrame, of: Centre, k: int = 32, block: int | None = None, tolerance: float = 1e-13, patience: int = 12, most: int = 200, seed: int = 5) -> Basis:
    """The k leading eigenvectors of the covariance, or as many as there are.

    block: columns of the first block, 2k by default. patience: passes still to go beyond which the block is doubled.
    """
    d = of.width
    k = min(k, d)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, max(k, block or 2 * k)))))[0]
    residuals, widths = [], []
    for _ in range(most):
        vq = product(x, of, q)
        h = q.T @ vq
        theta, w = np.linalg.eigh((h + h.T) / 2)
        theta, w = theta[::-1], w[:, ::-1]
        u, vu = q @ w, vq @ w
        top = max(float(theta[0]), 0.0)
        if top <= 0:
            return Basis(np.zeros(0), np.zeros((d, 0)), (0.0,), (q.shape[1],))
        have = min(k, int((theta > NONE * top).sum()))
        worst = float(np.linalg.norm(vu[:, :have] - u[:, :have] * theta[:have], axis=0).max()) / top
        residuals.append(worst)
        widths.append(q.shape[1])
        if worst <= tolerance and len(residuals) > 1:  # the last pass started from these components
            sign = np.sign(u[np.abs(u[:, :have]).argmax(axis=0), range(have)])
            return Basis(theta[:have], u[:, :have] * sign, tuple(residuals), tuple(widths))
        if q.shape[1] == d:
            q = np.linalg.qr(u)[0]
            continue
        rate = max(float(theta[-1]), 0.0) / float(theta[have - 1])
        to_go = ceil(log(tolerance / worst) / log(rate)) if 0 < rate < 1 else (1 if rate == 0 else most)
        q = np.linalg.qr(vu)[0]
        if len(residuals) > 1 and to_go > patience:
            more = rng.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1]))
            q = np.linalg.qr(np.hstack([q, more]))[0]
    raise RuntimeError(f"residuals {residuals[-3:]} after {most} passes")


def identity_error(x: DataFrame, of: Centre, basis: Basis) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured in a pass of its own."""
    k = len(basis.values)
    scaled = basis.vectors / np.sqrt(basis.values)

    def each(z: np.ndarray) -> np.ndarray:
        w = z @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _summed(x, of, each, (k + 1, k)) / of.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 32, scale: int = 64, **settings) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, for each vector and each of the k leading
    components. settings: see components()."""
    spark = vectors.sparkSession
    x = whole_numbers(vectors, scale)
    of = centre(x)
    basis = components(x, of, k, **settings) if of else None
    if basis is None or not len(basis.values):
        drop_stored(x)
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(x, of, basis)
    scaled = basis.vectors / np.sqrt(basis.values)
    explained = (basis.values / of.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _matrices(batches, of.width):
            white = of.rows(m) @ scaled
            ids = part["vec_id"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            yield pa.RecordBatch.from_arrays([ids, pa.array(of.deviations(m), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    rows = x.mapInArrow(run, "vec_id long, deviation long, w array<double>")
    rows = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)), F.col("at"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(of.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
ORACLE = {}
