"""Whitening of embeddings: leading eigenpairs of their covariance by spectrum slicing.

Entries become integers ``x = floor(64 c) + 1000000``. Sums and products are those of ``x`` less the integer nearest below its
mean; they are exact, so the covariance is that of the centred entries, rounded once. It has one entry per pair of
dimensions, which is all the driver sees.

There the signs of the diagonal of an LDL' factorisation of the shifted covariance count the eigenvalues below the shift
(Sylvester's law of inertia). Halving by such counts isolates an eigenvalue, Rayleigh quotient iteration from inside its
interval converges cubically, and the counts just below and above what it converged to certify the eigenvalue's number; if
it went to another one, the interval is halved on. Eigenvalues nearer than ``CLUSTER`` of the largest
are taken together: iteration with all their vectors at once, then rotation within their space, gives orthogonal ones.

Defined results: vectors that are null, or hold null or non-finite components, or ones of ``2**44`` and more, take no part. Vectors
of different dimensions are fitted each with their own. Rows repeated are rows of their own, null ids stay null. A component whose
variance is below ``ZERO`` of the largest is rounding only; it has no whitened form and is left out, so equal vectors or a single one give no
rows, nor do empty vectors or an empty table. A deviation that no long holds is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stage

SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**44
COMPONENTS = 32
#: Eigenvalues nearer than this share of the largest are found together; smaller ones than ``ZERO`` times it are zero.
CLUSTER, ZERO = 1e-9, 1e-11
#: What rounding makes of an eigenvalue, as a share of the largest; an interval so narrow is not halved.
NARROW = 1e-13
#: Rows that a task multiplies together.
ROWS = 4096
_ALPHA = (1 + 17**0.5) / 8


# Eigenpairs

def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix below ``shift``: negative pivots of LDL' with diagonal pivoting.

    Pivots are single entries or, where the diagonal is too small beside the rest, blocks of two with a negative
    determinant, which count one eigenvalue of each sign. An exact zero counts as not below.
    """
    a = matrix - shift * np.eye(len(matrix))
    below = 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        at = int(off.argmax())
        i, j = divmod(at, len(a))
        if diagonal[p] >= _ALPHA * off[i, j]:
            pivot = a[p, p]
            if pivot == 0:
                return below
            below += pivot < 0
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:
            below += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            block = a[np.ix_([i, j], [i, j])]
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
            a = (a + a.T) / 2
    return below


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
        nudge = np.spacing(np.abs(matrix).max()) * 4
        return np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), right)


def _iterated(matrix: np.ndarray, low: float, high: float, many: int, start: np.ndarray, found: np.ndarray, fixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """``many`` eigenpairs from within an interval by Rayleigh quotient iteration, orthogonal to those found before.

    ``fixed`` keeps the shift in the interval, where that is too narrow to tell its eigenvalues from each other.
    """
    space = lambda y: np.linalg.qr(y - found @ (found.T @ y))[0]
    shift = (low + high) / 2
    vectors = space(_solved(matrix, shift, space(start[:, :many])))
    for _ in range(40):
        values, turn = np.linalg.eigh(vectors.T @ matrix @ vectors) if many > 1 else ((vectors * (matrix @ vectors)).sum(axis=0), None)
        vectors = vectors if turn is None else vectors @ turn
        if np.abs(matrix @ vectors - vectors * values).max() <= 8 * np.spacing(np.abs(matrix).max()) * len(matrix) ** 0.5:
            break
        # A cluster keeps one shift, as its values differ by less than the iteration can use.
        vectors = space(_solved(matrix, shift if fixed else float(np.mean(values)), vectors))
    order = np.argsort(-values)
    return values[order], vectors[:, order]


def leading_eigenpairs(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues that are not zero, falling, and their unit eigenvectors as columns."""
    size = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max())
    if not size or top == 0:
        return np.zeros(0), np.zeros((size, 0))
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = size - inertia(matrix, shift)
        return counts[shift]

    floor = ZERO * top
    many = min(many, above(floor))
    start = np.random.default_rng(size).standard_normal((size, size))
    values, vectors = np.zeros(0), np.zeros((size, 0))
    counts[2 * top] = 0
    while len(values) < many:
        k = len(values)
        # Known shifts with at most k eigenvalues above, and with more.
        high = min(s for s, c in counts.items() if c <= k)
        low = max(s for s, c in counts.items() if c > k and s < high)
        while True:
            within, width = above(low) - k, high - low
            narrow = width <= NARROW * top
            if above(high) == k and (within == 1 or width <= CLUSTER * top):
                got, columns = _iterated(matrix, low, high, within, start, vectors, narrow)
                # The counts around what was found certify that these are the next ones.
                margin = NARROW * top
                if narrow or above(got[0] + margin) <= k and above(got[-1] - margin) >= k + within:
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > k else (low, middle)
        values, vectors = np.append(values, got), np.column_stack([vectors, columns])
    # A cluster may have given more than were asked for.
    return values[:many], vectors[:, :many]


# Exact sums

@dataclass
class Fit:
    """What whitening needs of the vectors of one dimension."""

    rows: int
    whole: np.ndarray  #: Integer part of the mean per dimension.
    rest: np.ndarray  #: Sum less ``rows`` times that.
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.rows

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(rows * x - sum)**2`` of each vector."""
        near = x - self.whole
        far = float(np.abs(near).max(initial=0) + 1) * self.rows
        kind = np.int64 if far * far * x.shape[1] < 2**62 else object
        own = (near.astype(kind) * self.rows - self.rest.astype(kind)) ** 2
        return [d if d < 2**63 else None for d in own.sum(axis=1).tolist()]


def integers(vector: Column) -> Column:
    """``x`` of each entry as an array of long, null if the vector takes no part."""
    c = vector.cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= LARGEST))
    x = F.transform(F.when(~bad & (F.size(c) > 0), c), lambda v: F.floor(v * SCALE).cast("long") + OFFSET)
    return x


def _matrices(batch: pa.RecordBatch):
    """Slices of rows of one dimension: ``(dimension, ids, x)``."""
    lists = batch.column("x")
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            yield int(size), part, flat[ends[part][:, None] + np.arange(size)]


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` of integers, exactly."""
    if np.abs(x).max(initial=0).astype(float) * np.abs(y).max(initial=0) * len(x) < 2**53:
        return (x.T.astype(float) @ y.astype(float)).astype(np.int64)
    return x.T.astype(object) @ y.astype(object)


def _summed(rows: DataFrame, parts, names: list[str]) -> DataFrame:
    """Exact sums over all rows of what ``parts(dimension, x)`` gives per slice: ``(names, value)``, integers as digits."""

    def sums(batches):
        total: dict[tuple, int] = {}
        for batch in batches:
            for size, _, x in _matrices(batch):
                for key, value in parts(size, x):
                    total[key] = total.get(key, 0) + value
        columns = list(zip(*[(*k, str(v)) for k, v in total.items()])) or [[]] * (len(names) + 1)
        yield pa.record_batch([*[pa.array(c, pa.int32()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*names, "value"])

    schema = ", ".join([*[f"{n} int" for n in names], "value string"])
    made = rows.mapInArrow(sums, schema).withColumn("value", F.col("value").cast("decimal(38,0)"))
    return made.groupBy(*names).agg(F.sum("value").alias("value"))


def fit(rows: DataFrame, many: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each dimension over ``rows`` with a column ``x``; a row for each pair of dimensions reaches the driver."""

    def first(size, x):
        yield (size, -1), len(x)
        # High and low halves, as a sum of longs may be none.
        yield from (((size, i), int(h << 24) + int(low)) for i, (h, low) in enumerate(zip((x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0))))

    sums: dict[int, dict[int, int]] = {}
    for r in _summed(rows.select("x"), first, ["size", "i"]).collect():
        sums.setdefault(r["size"], {})[r["i"]] = int(r["value"])
    means = {}
    for size, s in sums.items():
        n, total = s[-1], [s[i] for i in range(size)]
        means[size] = (n, np.array([t // n for t in total], dtype=np.int64), np.array([t % n for t in total], dtype=np.int64))

    def second(size, x):
        z = x - means[size][1]
        products = _product(z, z)
        for i in range(size):
            yield from (((size, i, i + j), v) for j, v in enumerate(products[i, i:].tolist()))

    products: dict[int, np.ndarray] = {size: np.zeros((size, size), dtype=object) for size in means}
    for r in _summed(rows.select("x"), second, ["size", "i", "j"]).collect():
        products[r["size"]][r["i"], r["j"]] = products[r["size"]][r["j"], r["i"]] = int(r["value"])
    fits = {}
    for size, (n, whole, rest) in means.items():
        exact = n * products[size] - np.outer(rest.astype(object), rest.astype(object))
        covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in exact]).reshape(size, size)
        values, vectors = leading_eigenpairs(covariance, many)
        fits[size] = Fit(n, whole, rest, values, vectors, float(Fraction(int(exact.trace()), n * n)))
    return fits


def _identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _matrices(batch):
                # The entries are centred; a column of ones keeps what rounding left of their mean.
                w = np.column_stack([fits[size].whitened(x), np.ones(len(x))])
                total[size] = total.get(size, 0) + w.T @ w
        out = [(size, i, j, float(t[i, j])) for size, t in total.items() for i in range(len(t)) for j in range(i, len(t))]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.float64()])],
                              names=["size", "i", "j", "value"])

    errors = {}
    found = rows.select("x").mapInArrow(sums, "size int, i int, j int, value double")
    by_size: dict[int, np.ndarray] = {size: np.zeros((len(f.values) + 1,) * 2) for size, f in fits.items()}
    for r in found.groupBy("size", "i", "j").agg(F.sum("value").alias("value")).collect():
        by_size[r["size"]][r["i"], r["j"]] = by_size[r["size"]][r["j"], r["i"]] = r["value"]
    for size, f in fits.items():
        k = len(f.values)
        products, mean = by_size[size][:k, :k] / f.rows, by_size[size][:k, k] / f.rows
        errors[size] = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return errors


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", many: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per vector and component."""
    given = table.select(F.col(key).cast("long").alias("id"), integers(F.col(vector)).alias("x"))
    rows = stage(given.where("x is not null"), "whitening")
    fits = fit(rows, many)
    errors = _identity_errors(rows, fits)

    def out(batches):
        for batch in batches:
            for size, at, x in _matrices(batch):
                f = fits[size]
                k = len(f.values)
                yield pa.record_batch(
                    [
                        batch.column("id").take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(k * len(x), f.rows)),
                        pa.array(f.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(f.whitened(x).reshape(-1)),
                        pa.array(np.tile(f.values / f.trace if f.trace else f.values, len(x))),
                        pa.array(np.full(k * len(x), errors[size])),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(out, schema)
