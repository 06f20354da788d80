"""Whitening of embeddings on eigenvectors refined in mixed precision.

Entries become integers, x = floor(64 * c) + 1000000, so counts, sums and products of whole vectors are exact and do
not depend on how Spark deals the rows. A first job sums each dimension; a second one sums the products of what is
left after the whole part of the mean is taken off, and the rest of the centring is done on the sums, in integers.

The covariance's eigenvectors are found in float32 and refined by the iterations of Ogita and Aishima: a few matrix
products in extended precision give the residual of orthogonality and of diagonality, and from these a correction
that squares the error. Eigenvalues nearer to each other than the residuals are large cannot be told apart by it; such a
cluster is corrected for orthogonality only and solved by itself, as the small matrix of its own subspace with its
mean taken off.

A third job measures the covariance of the whitened rows, the last one returns them. Tasks return sums of d numbers
each; the driver holds matrices of d by d numbers for each length d of vectors, whatever the number of rows.

Defined cases: vectors that are null, empty, or hold a null or non-finite entry are dropped; a null id stays an id;
repeated rows are rows of their own; vectors of different lengths are whitened apart, each length with its own n;
entries beyond 2^62 count as 2^62; a deviation beyond the range of long is null; a component without variance (at
most ``NO_VARIANCE`` of the whole) has a null ``whitened`` and takes no part in ``identity_error``, and ``explained`` is
null if nothing varies; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Share of the whole variance below which a component has none.
NO_VARIANCE = 1e-15
LARGEST = 1 << 62
#: Refinement squares the error of float32 each time; this many steps are never needed.
STEPS = 12
#: Rows taken at a time.
ROWS = 1024
#: Integers that doubles, and longs, hold exactly.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 63
WIDE = np.longdouble


def usable(vectors: DataFrame, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(vec_id).alias("vec_id"), v.alias("v"))


def _integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers, and floor(SCALE * c) as longs, by length of the vectors and at most ``ROWS`` rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        column = batch["v"].slice(at, ROWS)
        starts, lengths = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py(), np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            scaled = np.floor(SCALE * values[starts[rows][:, None] + np.arange(size)])
            # The nearest double below 2^62 in size; what is larger is cut to 2^62 itself.
            yield at + rows, np.where(np.abs(scaled) < LARGEST, scaled, np.sign(scaled) * LARGEST).astype(np.int64)


def _largest(values: np.ndarray) -> int:
    return int(max(-int(values.min()), int(values.max()), 1)) if values.size else 1


def exact_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    wide = rows if _largest(rows) * len(rows) < EXACT_LONG else rows.astype(object)
    return wide.sum(axis=0).astype(object)


def exact_products(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows as Python integers."""
    if _largest(rows) ** 2 * len(rows) < EXACT_DOUBLE:
        rows = rows.astype(np.float64)
        return (rows.T @ rows).astype(np.int64).astype(object)
    if len(rows) > 1:
        half = len(rows) // 2
        return exact_products(rows[:half]) + exact_products(rows[half:])
    wide = rows.astype(object)
    return wide.T @ wide


def _sums(rows: DataFrame, lines_of: Callable[[np.ndarray], list], number: Callable, add: Callable) -> dict[int, list[list]]:
    """By length of the vectors, the sums over all rows of the lists of numbers that ``lines_of`` gives for some rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, values in _integers(batch):
                found = lines_of(values)
                old = held.get(values.shape[1])
                held[values.shape[1]] = found if old is None else [a + b for a, b in zip(old, found)]
        for size, lines in held.items():
            for k, line in enumerate(lines):
                texts = pa.array([[repr(x) for x in line.tolist()]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([k], pa.int32()), texts], ["dim", "line", "numbers"])

    def whole(group: pa.Table) -> pa.Table:
        columns = zip(*([number(x) for x in line] for line in group["numbers"].to_pylist()))
        texts = pa.array([[repr(add(c)) for c in columns]], pa.list_(pa.string()))
        return pa.table({"dim": group["dim"].slice(0, 1), "line": group["line"].slice(0, 1), "numbers": texts})

    schema = "dim int, line int, numbers array<string>"
    found = rows.mapInArrow(partial, schema).groupBy("dim", "line").applyInArrow(whole, schema)
    out: dict[int, list[list]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["dim"], r["line"])):
        out.setdefault(r["dim"], []).append([number(x) for x in r["numbers"]])
    return out


def _clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Runs of neighbours in a falling list that are at most ``width`` apart."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > width) + 1
    return [run for run in np.split(np.arange(len(values)), cuts) if len(run) > 1]


def _solved_apart(a: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The eigenvectors of ``a`` within the space of a cluster's vectors."""
    own = vectors.T @ (a @ vectors)
    own = own - np.trace(own) / len(own) * (vectors.T @ vectors)
    size = np.abs(own).max()
    if not size:
        return vectors
    turn = np.linalg.eigh(((own + own.T) / (2 * size)).astype(np.float64))[1][:, ::-1]
    return vectors @ turn.astype(WIDE)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, of a symmetric matrix in extended precision."""
    size = np.abs(covariance).max() if covariance.size else WIDE(0)
    one = np.eye(len(covariance), dtype=WIDE)
    if not size:
        return np.zeros(len(covariance), WIDE), one
    a = covariance / size
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(WIDE)
    norm, enough = np.linalg.norm(a.astype(np.float64)), 2 * len(a) * np.finfo(WIDE).eps
    for _ in range(STEPS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        width = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + norm * np.linalg.norm(r.astype(np.float64)))
        gaps = values[None, :] - values[:, None]
        together = np.abs(gaps) <= width
        clusters = _clusters(values, width)
        for run in clusters:
            together[np.ix_(run, run)] = True
        off = s + r * values[None, :]
        x = x + x @ np.where(together, r / 2, off / np.where(together, 1, gaps))
        if max(np.abs(r).max(), np.abs(off - np.diag(np.diag(off))).max()) <= enough:
            break
        for run in clusters:
            x[:, run] = _solved_apart(a, x[:, run])
    x = x + x @ (one - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    # Either sign will do: the largest entry is positive.
    return values * size, x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])


class Fit:
    """What whitens the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * (s // n) for s in sums]
        self.error = 0.0

    def solve(self, products: list[list[int]], count: int) -> None:
        d, n = len(self.rest), self.n
        v = np.zeros((d, d), WIDE)
        for i in range(d):
            for j in range(d):
                v[i, j] = WIDE(n * products[i][j] - self.rest[i] * self.rest[j]) / WIDE(n * n)
        values, vectors = eigen(v)
        trace = np.trace(v)
        self.explained = [float(e / trace) if trace else None for e in values[:count]]
        self.varies = np.array([bool(e > NO_VARIANCE * trace) for e in values[:count]], bool)
        shrink = np.where(self.varies, np.sqrt(np.where(values[:count] > 0, values[:count], 1)), 1)
        self.turn = (vectors[:, :count] / shrink).astype(np.float64)

    def whitened(self, values: np.ndarray) -> np.ndarray:
        return ((values - self.whole).astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.turn

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact."""
        left = values - self.whole
        bound = self.n * (_largest(left) + 1)
        exact = left if bound**2 * left.shape[1] < EXACT_LONG else left.astype(object)
        apart = exact * self.n - np.array(self.rest, exact.dtype)
        return [x if x < EXACT_LONG else None for x in (apart * apart).sum(axis=1).tolist()]


def fit(rows: DataFrame, count: int = COMPONENTS) -> dict[int, Fit]:
    """What whitens the usable ``rows``, by length of their vectors."""
    totals = _sums(rows, lambda v: [np.array([len(v), *exact_sums(v)], object)], int, sum)
    fits = {size: Fit(lines[0][0], lines[0][1:]) for size, lines in totals.items()}
    for size, lines in _sums(rows, lambda v: list(exact_products(v - fits[v.shape[1]].whole)), int, sum).items():
        fits[size].solve(lines, count)

    def moments(values: np.ndarray) -> list[np.ndarray]:
        w = fits[values.shape[1]].whitened(values)
        return [w.sum(axis=0), *(w.T @ w)]

    for size, (means, *products) in _sums(rows, moments, float, math.fsum).items():
        own = fits[size]
        means, products = np.array(means) / own.n, np.array(products) / own.n
        wrong = np.abs(products - np.outer(means, means) - np.eye(len(means)))[np.ix_(own.varies, own.varies)]
        own.error = float(wrong.max()) if wrong.size else 0.0
    return fits


def whiten(vectors: DataFrame, vec_id="vec_id", embedding="embedding", count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    rows = usable(vectors, vec_id, embedding)
    fits = fit(rows, count)
    error = max((f.error for f in fits.values()), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, values in _integers(batch):
                own = fits[values.shape[1]]
                k = len(own.explained)
                whitened = np.where(own.varies, own.whitened(values), np.nan).ravel()
                columns = [
                    batch["vec_id"].take(pa.array(np.repeat(numbers, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(numbers))),
                    pa.array(np.full(k * len(numbers), own.n, np.int64)),
                    pa.array(own.deviations(values), pa.int64()).take(pa.array(np.repeat(np.arange(len(numbers)), k))),
                    pa.array(whitened, from_pandas=True),
                    pa.array(own.explained * len(numbers), pa.float64()),
                    pa.array(np.full(k * len(numbers), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, OUT)

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


OUT = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
