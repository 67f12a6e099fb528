"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers ``x = floor(1024 * c) + 100000``, so sums and distances from
the mean are exact. With ``X`` the rows less their mean, a step multiplies a vector by ``X``
and the result by its transpose, both in the tasks that read the rows. A left vector
``u = X p`` is as long as the table; it is never stored but kept as its short ``p``, and its
products with earlier ones are those of ``p`` with ``X'u``, which the step brings home.
Both sides are fully orthogonalised, twice. What returns to the driver per step is one sum
per dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from marquee.llm.common import Tables, by_arrow

SCALE, SHIFT = 1024, 100_000
# An entry whose whole number is beyond this is taken for infinite.
MOST = float(1 << 61)
LOW_BITS = 24
# A triplet has settled once its residual is this part of the largest singular value.
SETTLED = 1e-14
# A further Krylov space has shown its largest value.
SHOWN = 1e-6
# Smaller parts of the largest singular value are rounding: no direction of the rows.
NOTHING = 1e-11
ROWS, WHITENED = "\x01x", ("n", "deviation", "whitened")


@dataclass(frozen=True)
class Centre:
    """Number of rows, sums per dimension, and the largest absolute entry."""

    n: int
    sums: list[int]
    most: int

    def distances(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: Python integers where 64 bits might not do."""
        if 2 * self.n * self.most < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.distances(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of the squared distances, exact."""
        far = self.distances(x)
        if len(self.sums) * (2 * self.n * self.most) ** 2 >= 1 << 63:
            far = far.astype(object)
        total = (far * far).sum(axis=1)
        if total.dtype == object:
            # Beyond 38 digits there is no number to give.
            return pa.array([str(t) if t < 10**38 else None for t in total], pa.string()).cast(pa.decimal128(38, 0))
        return pa.array(total, pa.int64()).cast(pa.decimal128(38, 0))


@dataclass(frozen=True)
class Whitening:
    """Components (columns), their deviations and parts of the whole variance."""

    centre: Centre
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / self.deviations


def whole_numbers(vector: Column) -> tuple[Column, Column]:
    """Whether every entry is a finite number, and the entries' whole numbers."""
    scaled = lambda c: F.floor(c.cast("double") * SCALE)
    fits = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < MOST))
    return vector.isNotNull() & fits, F.transform(vector, lambda c: scaled(c) + SHIFT)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The vector that ``make`` gives for some rows, summed over all rows by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            places = pa.array(np.arange(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array(total)], names=["i", "part"])

    parts = rows.select(F.col(f"`{ROWS}`").alias("x")).transform(by_arrow(run, "i int, part double"))
    found = parts.groupBy("i").agg(F.sum("part")).collect()
    return np.array([value for _, value in sorted(found)])


def centre_of(rows: DataFrame) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                high, low = (x >> LOW_BITS).sum(axis=0), (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(-1, x.shape[1]), pa.int32()),
                        pa.array(np.append(len(x), high)),
                        pa.array(np.append(np.abs(x).max(), low)),
                    ],
                    names=["i", "high", "low"],
                )

    parts = rows.select(F.col(f"`{ROWS}`").alias("x")).transform(by_arrow(run, "i int, high long, low long"))
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = {r["i"]: r for r in parts.groupBy("i").agg(*wide, F.max("low").alias("most")).collect()}
    head = found.pop(-1)
    sums = [(int(found[i]["high"]) << LOW_BITS) + int(found[i]["low"]) for i in sorted(found)]
    return Centre(int(head["high"]), sums, int(head["most"]))


def orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` less its parts along the basis, taken off twice."""
    if basis:
        rows = np.array(basis)
        for _ in range(2):
            v = v - rows.T @ (rows @ v)
    return v


def bidiagonalised(product: Callable[[np.ndarray], np.ndarray], dims: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of ``X`` and their right vectors (columns).

    ``product(q)`` gives ``X'(Xq)``. One start vector finds one direction of each singular
    value, so once the ``count`` leading ones have settled a fresh vector opens another
    Krylov space beside the first, until one has shown nothing larger than what is kept; after
    ``dims`` steps there is nothing left to find.
    """
    random = np.random.default_rng(7)

    def fresh() -> np.ndarray:
        v = orthogonal(random.standard_normal(dims), rights)
        return v / np.linalg.norm(v)

    rights: list[np.ndarray] = []
    coefficients: list[np.ndarray] = []  # p of each left vector u = Xp
    images: list[np.ndarray] = []  # and X'u
    diagonal: list[float] = []
    above: list[float] = []  # beta between a step and the next
    opened = 0
    v, q, scale = fresh(), None, 0.0
    while True:
        q = v.copy() if q is None else q
        z = product(q)
        if coefficients:
            p, g = np.array(coefficients), np.array(images)
            for _ in range(2):
                h = p @ z
                q, z = q - p.T @ h, z - g.T @ h
        alpha = float(np.sqrt(max(q @ z, 0.0)))
        scale = max(scale, alpha)
        rights.append(v)
        if alpha > NOTHING * scale:
            coefficients.append(q / alpha)
            images.append(z / alpha)
            rest = orthogonal(z / alpha - alpha * v, rights)
            beta = float(np.linalg.norm(rest))
        else:
            alpha, rest, beta = 0.0, np.zeros(dims), 0.0
        diagonal.append(alpha)
        if beta <= NOTHING * scale:
            beta = 0.0
        k = len(diagonal)
        small = np.diag(diagonal) + np.diag(above, 1)
        left, values, right = np.linalg.svd(small)
        leading = min(count, k)
        settled = beta * np.abs(left[-1, :leading]).max() <= SETTLED * values[0]
        if k == dims:
            break
        if settled and k >= count:
            own_left, own, _ = np.linalg.svd(small[opened:, opened:])
            if opened and beta * abs(own_left[-1, 0]) <= SHOWN * values[0] and own[0] < values[count - 1]:
                break
            beta = 0.0 if not opened or own[0] >= values[count - 1] else beta
        if beta:
            above.append(beta)
            v = rest / beta
            q = v - beta * coefficients[-1]
        else:
            above.append(0.0)
            opened = k
            v, q = fresh(), None
    return values[:count], (np.array(rights).T @ right.T)[:, :count]


def fit(rows: DataFrame, count: int) -> Whitening | None:
    """The leading components of the rows' covariance; fewer where the rows span fewer."""
    head = rows.select(F.size(f"`{ROWS}`")).first()
    if head is None or head[0] == 0:
        return None
    centre = centre_of(rows)
    dims = len(centre.sums)

    def product(q: np.ndarray) -> np.ndarray:
        def make(x: np.ndarray) -> np.ndarray:
            part = centre.centred(x)
            return part.T @ (part @ q)

        return summed(rows, make)

    trace = float(summed(rows, lambda x: np.array([np.square(centre.centred(x)).sum()]))[0]) / centre.n
    if trace == 0:
        return None
    values, components = bidiagonalised(product, dims, min(count, dims))
    there = values > NOTHING * values[0]
    values, components = values[there], components[:, there]
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(values))])
    variances = values**2 / centre.n
    return Whitening(centre, components * signs, np.sqrt(variances), variances / trace)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, sign aside, of the whitened rows' covariance less the identity."""
    k = len(model.deviations)

    def make(x: np.ndarray) -> np.ndarray:
        y = model.apply(x)
        return np.append((y.T @ y).ravel(), y.sum(axis=0))

    total = summed(rows, make) / model.centre.n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(frame: DataFrame, vector: str = "embedding", count: int = 8) -> tuple[DataFrame, Whitening | None, float]:
    """The rows with ``n``, ``deviation`` and ``whitened`` in the place of their vector, the
    model, and the error of the whitened covariance.

    ``n`` is the number of rows, ``deviation`` (DECIMAL(38, 0), null beyond it) the exact sum
    over dimensions of ``(n * x - sum of x) ** 2``, ``whitened`` an array with the distance
    from the mean along each component over its deviation. Rows go whose vector is null or
    holds a null or an entry that is not finite (or beyond 2**61 / 1024), or has another length
    than most rows' (of equally common ones the greater). All others are fitted and returned, repeated
    ones as often as they come. There are fewer than ``count`` components where the
    rows span fewer directions, and no row at all comes back where they span none (all
    equal, or empty vectors, or an empty table; the model is None then). Further columns
    stay, but for those named like an added one.
    """
    spark = frame.sparkSession
    added = [StructField("n", LongType()), StructField("deviation", DecimalType(38, 0))]
    added.append(StructField("whitened", ArrayType(DoubleType())))
    kept = [c for c in frame.columns if c.lower() not in (*WHITENED, vector.lower())]
    usable, numbers = whole_numbers(F.col(f"`{vector}`"))
    fine = frame.where(usable).select(*[f"`{c}`" for c in kept], numbers.alias(ROWS))
    table = Tables().written(fine, "vectors")
    size = F.size(f"`{ROWS}`")
    common = table.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = table if common is None else table.where(size == common["size"])
    schema = StructType([*rows.drop(ROWS).schema.fields, *added])
    model = fit(rows, count)
    if model is None:
        return spark.createDataFrame([], schema), None, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(len(kept)))
                y = model.apply(x)
                offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(kept)],
                        pa.array(np.full(len(x), model.centre.n)),
                        model.centre.deviations(x),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel())),
                    ],
                    names=[f.name for f in schema],
                )

    return rows.transform(by_arrow(run, schema)), model, identity_error(rows, model)
