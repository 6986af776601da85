"""Linear models of fingerprints on rows: principal components, logistic regression and partial least squares for many targets at once.

Rows are summed by executors in one pass into products of columns (or a gradient), which are small: columns by columns or
by targets. Products are cut into blocks of rows, so that a task sums one block of all parts, batch by batch, in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST = 8192  # columns and targets: a product of two sides this wide takes 512 MB on the driver
BLOCK = 256  # rows of a product in a block


def _stacked(column: pa.Array) -> np.ndarray:
    """The arrays of a column, all of one length, as rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, product: Callable[..., np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of product(matrices of the array columns of a batch), a matrix of this shape."""
    n, m = shape
    if max(n, m) > WIDEST:
        raise ValueError(f"more than {WIDEST} columns")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(shape)
        some = False
        for b in batches:
            if b.num_rows:
                whole += product(*[_stacked(c) for c in b.columns])
                some = True
        if some:
            for k in range(0, n, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([whole[k : k + BLOCK].tobytes()], pa.binary())], ["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), float)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "data"])

    kind = "block int, data binary"
    parts = rows.mapInArrow(part, kind)
    width = max(1, math.isqrt(rows.sparkSession.sparkContext.defaultParallelism))
    parts = parts.repartition(width * math.ceil(n / BLOCK), "block", F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.shiftright(F.monotonically_increasing_id(), 33)), F.lit(width))).mapInArrow(add, kind)
    parts = parts.repartition(math.ceil(n / BLOCK), "block").mapInArrow(add, kind)
    out = np.zeros(shape)
    for k, data in parts.toLocalIterator():
        x = np.frombuffer(bytes(data), float).reshape(-1, m)
        out[k : k + len(x)] += x
    return out


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def _width(rows: DataFrame, column: str) -> int:
    first = rows.select(F.min(F.size(column)), F.max(F.size(column))).first()
    if first[0] != first[1]:
        raise ValueError(f"arrays of {column} differ in length")
    return int(first[0] or 0)


def principal_components(rows: DataFrame, column: str = "vec", k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components [k, d], variances): from one pass over the rows (L7). A component's largest entry (the first of equals) is positive."""
    d = _width(rows, column)
    g = summed(rows.select(column), lambda x: _with_one(x).T @ _with_one(x), (d + 1, d + 1))
    n, mean = g[d, d], g[d, :d] / g[d, d]
    value, vector = np.linalg.eigh((g[:d, :d] - n * np.outer(mean, mean)) / max(n - 1, 1))
    best = vector[:, ::-1][:, :k].T
    return mean, best * np.sign(best[np.arange(len(best)), np.abs(best).argmax(1)])[:, None], value[::-1][:k]


def projected(column: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """The array of a row's coordinates on the components, as an expression."""
    dot = lambda w: F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) - F.lit(float(w @ mean))
    return F.array(*[dot(w) for w in components])


def logistic(rows: DataFrame, x: str = "vec", y: str = "bits", penalty: float = 1.0, rounds: int = 300, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients [t, d + 1], rounds [t]): logistic regressions of every 0/1 target in the arrays `y` on the arrays `x`, the constant last (L3).

    Minimises the summed logistic loss plus penalty / 2 times the squared coefficients (not the constant) of all targets
    at once: one pass over the rows a round gives everyone's gradient, with accelerated steps that start anew where they
    go uphill; the step is set by the largest eigenvalue of the products of x. A target whose gradient is below `least`
    a row leaves, so later passes carry fewer. rounds says when it left; one more than `rounds` if it never did.
    """
    d, t = _width(rows, x), _width(rows, y)
    rows = rows.select(x, y)
    g = summed(rows.select(x), lambda a: _with_one(a).T @ _with_one(a), (d + 1, d + 1))
    n, step = g[d, d], 1 / (np.linalg.eigvalsh(g)[-1] / 4 + penalty)
    ridge = np.append(np.full(d, penalty), 0.0)
    out, when = np.zeros((t, d + 1)), np.full(t, rounds + 1)
    here, ahead, speed, own = out.copy(), out.copy(), np.ones(t), np.arange(t)
    for k in range(1, rounds + 1):
        w, some = ahead[own], own.copy()
        gradient = summed(rows, lambda a, b: (1 / (1 + np.exp(-_with_one(a) @ w.T)) - b[:, some]).T @ _with_one(a), (len(own), d + 1)) + w * ridge
        new = w - step * gradient
        uphill = (gradient * (new - here[own])).sum(1) > 0
        follow = (1 + np.sqrt(1 + 4 * speed[own] ** 2)) / 2
        push = np.where(uphill, 0, (speed[own] - 1) / follow)[:, None]
        ahead[own], speed[own] = new + push * (new - here[own]), np.where(uphill, 1, follow)
        here[own] = new
        done = np.abs(gradient).max(1) < least * n
        out[own[done]], when[own[done]] = w[done], k
        own = own[~done]
        if not len(own):
            break
    out[own] = here[own]
    return out, when


def least_squares_components(rows: DataFrame, x: str = "vec", y: str = "bits", components: int = 2) -> np.ndarray:
    """Coefficients [t, d + 1], the constant last, of a partial least squares regression of each target in `y` on `x` with this many components (L3).

    One pass over the rows sums the products of x with x and with all targets; each target's components come from these.
    """
    d, t = _width(rows, x), _width(rows, y)
    both = lambda a, b: _with_one(a).T @ np.concatenate([_with_one(a), b], 1)
    return _from_products(summed(rows.select(x, y), both, (d + 1, d + 1 + t)), d, t, components)


def _from_products(g: np.ndarray, d: int, t: int, components: int) -> np.ndarray:
    """The coefficients from the products of (x, 1) with (x, 1, y)."""
    n, mean, y_mean = g[d, d], g[d, :d] / g[d, d], g[d, d + 1 :] / g[d, d]
    xx, xy = g[:d, :d] - n * np.outer(mean, mean), g[:d, d + 1 :] - n * np.outer(mean, y_mean)
    out = np.zeros((t, d + 1))
    for k in range(t):
        left, weights, loads, inner = xy[:, k].copy(), [], [], []
        for _ in range(components):
            norm = np.linalg.norm(left)
            if norm < 1e-12 * max(1.0, np.linalg.norm(xy[:, k])):
                break
            r = w = left / norm
            for old, load in zip(weights, loads):
                r = r - (load @ w) * old
            size = r @ xx @ r
            if size <= 0:
                break
            weights.append(r)
            loads.append(xx @ r / size)
            inner.append(r @ xy[:, k] / size)
            left = left - loads[-1] * inner[-1] * size
        if weights:
            out[k, :d] = np.array(weights).T @ np.array(inner)
        out[k, d] = y_mean[k] - out[k, :d] @ mean
    return out


def chosen_components(train: DataFrame, dev: DataFrame, x: str = "vec", y: str = "bits", least: int = 2, most: int = 8, cut: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients [t, d + 1], components [t]): for each target the partial least squares regression on `train` whose number
    of components, from `least` to `most`, is right most often on `dev`; of equals the fewest (L3).

    One pass over train sums the products that all numbers of components share, one over dev counts what each gets right.
    """
    d, t = _width(train, x), _width(train, y)
    both = lambda a, b: _with_one(a).T @ np.concatenate([_with_one(a), b], 1)
    products = summed(train.select(x, y), both, (d + 1, d + 1 + t))
    fits = np.stack([_from_products(products, d, t, k) for k in range(least, most + 1)])
    right = summed(dev.select(x, y), lambda a, b: np.stack([((_with_one(a) @ w.T > cut) == (b > 0)).sum(0) for w in fits]).astype(float), (len(fits), t))
    best = right.argmax(0)
    return fits[best, np.arange(t)], best + least


def scored_bits(column: Column, coefficients: np.ndarray, cut: float) -> Column:
    """For each target whether the linear score of a row is above `cut` (0 for logistic regression, a half for least squares), as an array of 0 and 1."""
    d = coefficients.shape[1] - 1
    return F.array(*[(projected(column, np.zeros(d), w[None, :d])[0] + float(w[d]) > cut).cast("int") for w in coefficients])
