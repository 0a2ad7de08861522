"""Embedding whitening by a one-sided Jacobi SVD.

Vectors become whole numbers, so counts and sums are exact. Each task centres
its blocks of the fit list and folds them into one triangular factor (blockwise
TSQR); the factors meet in a tree of tasks, and only the last, one triangle per
dimension of vectors, reaches the driver. Plane rotations make its columns
orthogonal: their lengths are the standard deviations (times the root of n), and
the rotations together are the components. No covariance matrix is ever formed
to find them, so small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import staged, unstaged

#: Numbers of a block that is factored at once, and of vectors that a task takes up at once; factors that one task of the tree takes.
BLOCK, SLICE, FAN_IN = 1 << 18, 1 << 21, 32


def whole_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of each component; one beyond 64 bits is an error."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose vectors, in the first column, have SLICE numbers together, or of one row."""
    for batch in batches:
        ends, start = np.cumsum(np.asarray(pc.list_value_length(batch.column(0)))), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
            yield batch.slice(start, end - start)
            start = end


def by_dimension(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each dimension."""
    sizes = np.asarray(pc.list_value_length(column))
    values, starts = np.asarray(column.flatten()), np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, values[starts[rows][:, None] + np.arange(dim)]))
    return out


def fold(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """Triangular factor of the rows so far and these."""
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def jacobi(triangle: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, components as rows) of the orthogonal columns that plane rotations lead to.

    A sweep meets every pair of columns, in rounds of disjoint pairs. It ends
    when no pair is further from orthogonal than rounding. Lengths fall; of a
    component the entry of greatest size is positive.
    """
    d = triangle.shape[1]
    a, v = triangle.astype(float).copy(), np.eye(d)
    even = d + d % 2
    players = np.arange(even)
    limit = np.finfo(float).eps * max(triangle.shape[0], 1) ** 0.5
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            p, q = players[: even // 2], players[even // 2 :][::-1]
            pairs = (p < d) & (q < d)
            p, q = p[pairs], q[pairs]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(xx) * np.sqrt(yy)
            turn = np.abs(xy) > limit * scale
            if turn.any():
                worst = max(worst, float((np.abs(xy[turn]) / scale[turn]).max()))
                with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                    zeta = (yy - xx) / (2 * xy)
                    tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                tangent = np.where(turn, tangent, 0.0)
                cosine = 1 / np.hypot(1.0, tangent)
                sine = cosine * tangent
                for m in (a, v):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = cosine * left - sine * right, sine * left + cosine * right
            players = np.concatenate((players[:1], players[-1:], players[1:-1]))
        if worst <= limit:
            break
    lengths = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    components = v.T[order]
    top = np.abs(components).argmax(axis=1)
    return lengths[order], components * np.sign(components[np.arange(d), top])[:, None]


@dataclass
class Whitening:
    """What is known of the fit list of one dimension: n, exact sums, components (rows) and their standard deviations."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the trace of the covariance."""
        return self.deviations**2 / max((self.deviations**2).sum(), np.finfo(float).tiny)

    @property
    def rank(self) -> int:
        """Components along which the fit list varies by more than rounding."""
        d = self.deviations
        return int((d > len(d) * np.finfo(float).eps * d.max(initial=0.0)).sum())

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 2**63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the difference is taken exactly before it is rounded."""
        return self.shifted(x).astype(float) / self.n

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        k = min(k, self.rank)
        return self.centred(x) @ self.components[:k].T / self.deviations[:k]

    def squared(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sums) squared, exactly."""
        far = self.shifted(x)
        if far.dtype != object and float(np.abs(far).max(initial=0)) ** 2 * far.shape[1] >= 2**62:
            far = far.astype(object)
        return (far * far).sum(axis=1).tolist()


def _added(partials: DataFrame, kind: str) -> dict[int, list]:
    """Sums, by dimension and place, of arrays that tasks have made: one row (dim, n, sums) of each."""
    placed = partials.select("dim", "n", F.posexplode("sums").alias("at", "x"))
    rows = placed.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast(kind)).alias("x")).collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.dim, r["at"])):
        out.setdefault(r.dim, [r.n, []])[1].append(r.x)
    return out


def _folded(fit: DataFrame, of: Callable[[int, np.ndarray], tuple[np.ndarray, str]], kind: str) -> DataFrame:
    """(dim, n, sums): per task and dimension, counts and sums over the rows of what ``of`` makes of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in in_slices(batches):
            for rows, x in by_dimension(batch.column(0)):
                n, sums = held.get(x.shape[1], (0, 0))
                held[x.shape[1]] = n + len(rows), sums + of(x.shape[1], x)
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "n": n, "sums": [str(s) for s in sums.tolist()] if kind == "string" else sums.tolist()}], schema)

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string() if kind == "string" else pa.float64()))])
    return fit.select("x").mapInArrow(run, f"dim int, n long, sums array<{kind}>")


def fit_list(vectors: DataFrame, column: str = "x") -> DataFrame:
    """Staged table of each distinct vector of whole numbers, once."""
    return staged(vectors.select(F.col(column).alias("x")).distinct())


def fitted(fit: DataFrame) -> dict[int, Whitening]:
    """The whitening of each dimension, fitted on the vectors ``x`` of a fit list.

    ``x`` is an array of long without nulls. Vectors of different dimension have
    no common covariance: each dimension is fitted by itself.
    """

    def sums(dim: int, x: np.ndarray) -> np.ndarray:
        return x.astype(object).sum(axis=0) if int(np.abs(x).max()) > 2**31 else x.sum(axis=0).astype(object)

    known = {dim: (int(n), [int(s) for s in x]) for dim, (n, x) in _added(_folded(fit, sums, "string"), "decimal(38,0)").items()}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in in_slices(batches):
            for _, x in by_dimension(batch.column(0)):
                dim = x.shape[1]
                centre, step = Whitening(*known[dim], np.empty(0), np.empty(0)), max(dim, BLOCK // dim)
                for start in range(0, len(x), step):
                    held[dim] = fold(held.get(dim), centre.centred(x[start : start + step]))
        yield from _triangles(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[dim] = fold(held.get(dim), np.frombuffer(r).reshape(-1, dim))
        yield from _triangles(held)

    parts, factors = fit.rdd.getNumPartitions(), fit.mapInArrow(local, "dim int, r binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        factors = factors.repartition(parts).mapInArrow(joined, "dim int, r binary")
    out = {}
    for row in factors.collect():  # one triangle a dimension
        n, sums = known[row.dim]
        lengths, components = jacobi(np.frombuffer(row.r).reshape(-1, row.dim))
        out[row.dim] = Whitening(n, sums, components, lengths / np.sqrt(n))
    return out


def _triangles(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for dim, r in held.items():
        yield pa.RecordBatch.from_pylist([{"dim": dim, "r": np.ascontiguousarray(r).tobytes()}], pa.schema([("dim", pa.int32()), ("r", pa.binary())]))


def identity_error(fit: DataFrame, fits: dict[int, Whitening], k: int) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance, centred before it is multiplied, minus the identity."""
    means = {dim: np.array(x) / n for dim, (n, x) in _added(_folded(fit, lambda dim, x: fits[dim].whitened(x, k).sum(axis=0), "double"), "double").items()}

    def products(dim: int, x: np.ndarray) -> np.ndarray:
        w = fits[dim].whitened(x, k) - means.get(dim, 0.0)
        return (w.T @ w).ravel()

    out = {dim: 0.0 for dim in fits}
    for dim, (n, x) in _added(_folded(fit, products, "double"), "double").items():
        side = round(len(x) ** 0.5)
        out[dim] = float(np.abs(np.array(x).reshape(side, side) / n - np.eye(side)).max())
    return out


def whiten(vectors: DataFrame, fits: dict[int, Whitening], k: int, keep: list[str], column: str = "x") -> DataFrame:
    """``keep`` columns, ``dim``, ``deviation`` and ``whitened`` (up to ``k`` values by falling deviation) per row.

    A component along which the fit list doesn't vary has no whitened value.
    A deviation beyond 64 bits is an error.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(fits)
    source = vectors.select(F.col(column).alias("whitened_x"), *keep)
    names = [*keep, "dim", "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for rows, x in by_dimension(batch.column(0)):
                fit = shared.value[x.shape[1]]
                w = fit.whitened(x, k)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                kept = [c.take(pa.array(rows)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(w), x.shape[1], np.int32)), pa.array(fit.squared(x), pa.int64()), lists], names=names)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(run, ", ".join([*fields, "dim int", "deviation long", "whitened array<double>"]))


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, std_deviation) per usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are
    left out; null ids and repeated rows stay, the fit list takes each vector
    of whole numbers once. Vectors of each dimension are whitened by
    themselves. There are fewer components than ``k`` where the fit list has
    fewer dimensions to vary in: none at all for a single vector. An empty
    table gives an empty result.
    """
    whole = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), whole_vector(F.col(vec_col)).alias("x"))
    fit = fit_list(whole)
    fits = fitted(fit)
    errors = identity_error(fit, fits, k)
    unstaged(fit)
    of = {dim: (fit.n, fit.explained[:k].tolist(), errors[dim], fit.deviations[:k].tolist()) for dim, fit in fits.items()}
    known = vectors.sparkSession.createDataFrame([(d, *x) for d, x in of.items()], "dim int, n long, explained array<double>, identity_error double, std_deviations array<double>")
    rows = whiten(whole, fits, k, ["id"]).join(F.broadcast(known), "dim")
    each = rows.select("id", "n", "deviation", "identity_error", "explained", "std_deviations", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error", F.get("std_deviations", "at").alias("std_deviation"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
