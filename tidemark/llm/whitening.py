"""Embedding whitening: rows projected on the principal components of the distinct vectors, scaled to unit variance.

Entries become integers, ``floor(64 * c) + 1000000``, so that sums are exact whatever the order. The first pass over the distinct
vectors sums them; the second sums outer products of the centred ones, one matrix product a batch, and ``treeAggregate`` merges
the tasks' matrices. LAPACK's symmetric solver gives the components on the driver; a matrix has as many rows as a vector
entries, whatever the number of vectors. The projection goes to all tasks. A third pass measures the whitened vectors' covariance.

Defined cases: rows whose vector is null or has null or non-finite entries are dropped, and so are empty vectors and those
of another length than most distinct vectors have (ties: the longer); entries beyond 2**53 / 64 count as that
limit; rows without ``vec_id`` and repeated rows stay; a component without variance has ``whitened`` 0 and is left out of ``identity_error``;
``deviation`` is null where it exceeds a long; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components that are kept at most.
COMPONENTS = 16
#: Scale and shift that make an entry an integer, and the scaled entry's limit.
SCALE, SHIFT, LIMIT = 64.0, 1_000_000, float(2**53)
#: A component has variance if its eigenvalue is at least this part of the largest.
LEAST = 1e-13
#: Rows of one matrix product.
ROWS = 4_096
#: Levels of the tree that merges the tasks' sums.
DEPTH = 3


def integers(vector: Column) -> Column:
    """The vector's entries as integers; null if there is no vector, none of its entries, or one of them is null or not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + F.lit(SHIFT).cast("long")
    return F.when((F.size(vector) > 0) & F.forall(vector, finite), F.transform(vector, whole))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The ``x`` of batches as matrices of at most ``ROWS`` rows; all have one length."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            x = batch.column(batch.schema.get_field_index("x")).slice(at, ROWS)
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _tree(partials: DataFrame, dtype: type) -> np.ndarray | None:
    """The sum of the tasks' partial arrays (column ``part``, bytes), merged on the executors."""
    add = lambda a, b: b if a is None else a if b is None else a + b
    return partials.rdd.map(lambda r: np.frombuffer(r["part"], dtype)).treeAggregate(None, add, add, DEPTH)


def _partials(fit: DataFrame, of: object) -> DataFrame:
    """One row a task with the sum of ``of`` over its matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return fit.mapInArrow(run, "part binary")


@dataclass
class Whitening:
    """What the passes over the distinct vectors give; ``axes`` has a unit eigenvector a row."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean, of whose exact numerator nothing is lost where it has at most 53 bits."""
        if self.n * (2 * SHIFT + int(np.abs(x).max(initial=0))) < 2**62:
            return (self.n * x - self.sums) / self.n
        return np.array((self.n * x.astype(object) - self.sums.astype(object)) / self.n, float)

    def varies(self) -> np.ndarray:
        return (self.values > LEAST * self.values[:1]) & (self.values > 0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        varies = self.varies()
        return (self.centred(x) @ self.axes.T) * np.where(varies, 1 / np.sqrt(np.where(varies, self.values, 1)), 0)

    def explained(self) -> np.ndarray:
        return np.where(self.varies(), self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n * x - S) ** 2``, exact."""
        most = self.n * (2 * SHIFT + int(np.abs(x).max(initial=0)))
        if most < 2**62:
            d = self.n * x - self.sums
            if float((d.astype(float) ** 2).sum(1).max(initial=0)) < 2**62:
                return (d * d).sum(1).tolist()
        sums = [int(s) for s in self.sums]
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
        return [v if v < 2**63 else None for v in exact]


def vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id_column, x``: the rows that have a usable vector, as integers."""
    return rows.select(id_column, integers(F.col(vector)).alias("x")).where("x is not null")


def fit(usable: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """Whitening of the distinct ``x`` of ``usable``, and their length. Without any, none."""
    distinct = written(usable.select("x").distinct(), "distinct-vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).count()
    most = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    if most is None:
        return None, 0
    n, d = most["count"], most["d"]
    distinct = distinct.where(F.size("x") == d)
    sums = _tree(_partials(distinct, lambda x: x.sum(0, dtype=np.int64)), np.int64)
    model = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)

    def outer(x: np.ndarray) -> np.ndarray:
        c = model.centred(x)
        return c.T @ c

    covariance = _tree(_partials(distinct, outer), float).reshape(d, d) / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    model = Whitening(n, sums, np.ascontiguousarray(axes.T[order]), np.maximum(values[order], 0), float(np.trace(covariance)))
    varies = model.varies()

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)[:, varies]
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    if varies.any():
        total = _tree(_partials(distinct, whitened_products), float) / n
        k = int(varies.sum())
        mean, product = total[:k], total[k:].reshape(k, k)
        model.identity_error = float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())
    return model, d


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component from 1: ``id_column, component, n, deviation, whitened, explained,
    identity_error``; ``n`` counts the distinct vectors, ``explained`` is the component's part of all variance."""
    if components < 1:
        raise ValueError("at least one component")
    usable = vectors(rows, id_column, vector)
    model, d = fit(usable, components)
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = next(_matrices(iter([part])))
                m, w = len(x), model.whitened(x)
                arrays = [part.column(0), pa.array([model.n] * m, pa.int64()), pa.array(model.deviation(x), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))]
                arrays += [pa.array([model.explained()] * m, pa.list_(pa.float64())), pa.array([model.identity_error] * m, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [id_column, "n", "deviation", "whitened", "explained", "identity_error"])

    out = usable.where(F.size("x") == d).mapInArrow(run, schema)
    scores = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "score")
    out = out.select(id_column, "n", "deviation", "identity_error", scores)
    return out.select(id_column, (F.col("at") + 1).alias("component"), "n", "deviation", "score.whitened", "score.explained", "identity_error")
