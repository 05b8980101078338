"""Operator 11: whitening of embeddings along the leading components of their covariance, found by LOBPCG.

Each entry c of a vector becomes the whole number x = floor(1024 * c) + 100000, and all statistics are of these. The covariance V itself is
never built: each round multiplies it with a block of directions, V W = mean of r (r' W) over the centred rows r, by one distributed pass
over all rows. Rayleigh-Ritz on the span of the iterates, their residuals and the previous directions gives the next iterates. Rounds go on
until the residual |V v - e v| of each wanted component, computed by a fresh pass, is at most TOLERANCE times the largest eigenvalue, or
as small as the rounding of the passes lets it be; the residuals are part of the result.

Rows are centred before they are multiplied: n * x - S (S: the sums of a dimension) is computed in whole numbers, then divided by n.

Vectors that are null, empty, or hold null, NaN or infinite entries are left out; so are vectors of another length than most have. Entries
with |1024 * c| over 2^53 count as 2^53. Repeated rows count each, a null id stays, other columns are ignored, an empty table gives an
empty one. A vector of d entries has at most d components. Along a component without variance (equal rows, one row) `whitened` is null;
`explained` is null if there is no variance at all, and `deviation` where it exceeds a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import save
from spanloom.llm.vectors import matrix, summed, usable

SCALE, OFFSET, MOST = 1024, 100_000, float(2**53)
COMPONENTS = 8
#: Directions iterated beside the wanted ones: the wanted ones then converge at the gap to the first that is not iterated.
GUARD = 12
TOLERANCE, ROUNDS = 1e-14, 500
#: A component with less than this share of the total variance has none.
FLAT = 1e-13


@dataclass(frozen=True)
class Whitening:
    """n rows, their sums of each dimension, eigenvalues (falling), unit eigenvectors as columns, residuals relative to the largest eigenvalue, total variance, and how many products were made."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    products: int

    def kept(self) -> np.ndarray:
        return self.values > FLAT * max(self.trace, 0.0)


def whole_numbers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x: the usable vectors as whole numbers."""
    one = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-MOST)), F.lit(MOST))) + OFFSET
    return usable(rows, key, vector).select(key, F.transform(vector, one).cast("array<bigint>").alias("x"))


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers, or Python's where those are too short."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 2**61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(batch: pa.RecordBatch, n: int, sums: list[int]) -> np.ndarray:
    return from_mean(matrix(batch.column("x"), np.int64), n, sums).astype(np.float64) / n


def squares(off: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None beyond 64 bits."""
    if (int(np.abs(off).max(initial=0)) + 1) ** 2 * off.shape[1] < 2**63:
        return (off * off).sum(axis=1).tolist()
    exact = (off.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def _orthonormal(block: np.ndarray, against: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of the block's part that is orthogonal to `against`; directions shorter than `least` before they are scaled are left out."""
    for again in range(2):
        block = block - against @ (against.T @ block)
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > (0.5 if again else least)]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residuals, products) of the `wanted` greatest eigenvalues of a symmetric matrix that is known by its products with blocks of columns.

    All directions are held orthonormal, the previous ones by turning the small Ritz vectors rather than long ones, so that their
    products follow by the same turn and only residuals need a pass. What that loses in digits is made good by fresh products of the
    iterates whenever these seem to have converged: only fresh residuals end the search.
    """
    block = min(d, wanted + guard)
    tolerance = max(tolerance, 8 * np.finfo(float).eps * d**0.5)  # the rounding of a product of d entries
    none = np.zeros((d, 0))
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((d, block)))[0]
    ax, p, ap, made, fresh = product(x), none, none, 1, True
    best, stale, slow, least = None, 0, 0, np.inf
    for _ in range(rounds):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        off = ax - x * values
        size = max(abs(values[0]), np.finfo(float).tiny)
        residuals = np.linalg.norm(off, axis=0)[:wanted] / size
        worst = residuals.max()
        slow, least = (0, worst) if worst < least / 2 else (slow + 1, least)
        if fresh:
            better = best is None or worst < best[2].max()
            best, stale = ((values[:wanted], x[:, :wanted], residuals), 0) if better else (best, stale + 1)
            if best[2].max() <= tolerance or stale >= 2 or block == d:
                break
        w = none if not fresh and (worst <= tolerance or (slow >= 12 and worst < 1e-9)) else _orthonormal(off / size, np.hstack([x, p]), np.finfo(float).eps)
        if w.shape[1]:
            aw, made, fresh = product(w), made + 1, False
            basis, ab = np.hstack([x, p, w]), np.hstack([ax, ap, aw])
            c = np.linalg.eigh((basis.T @ ab + ab.T @ basis) / 2)[1][:, ::-1][:, :block]
            # The previous directions: what the new iterates have outside the old ones, made orthogonal to the new ones.
            outside = c.copy()
            outside[:block] = 0
            back = _orthonormal(outside, c, 1e-10)
            x, ax, p, ap = basis @ c, ab @ c, basis @ back, ab @ back
        elif fresh:
            break  # nothing is left to add
        else:  # it seems to have converged, or goes no further: look again with fresh products
            x = np.linalg.qr(x)[0]
            ax, p, ap, made, fresh, slow, least = product(x), none, none, made + 1, True, 0, np.inf
    else:  # out of rounds: what there is, with its true residuals
        x = np.linalg.qr(x)[0][:, :wanted]
        ax, made = product(x), made + 1
        values = np.einsum("ij,ij->j", x, ax)
        residuals = np.linalg.norm(ax - x * values, axis=0) / max(abs(values).max(), np.finfo(float).tiny)
        best = min(best, (values, x, residuals), key=lambda b: b[2].max())
    return *best, made


def fit(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD) -> Whitening | None:
    """rows(x: whole numbers of one length, from whole_numbers and saved) -> the model; None without rows."""
    first = rows.limit(1).collect()
    if not first:
        return None
    d = len(first[0]["x"])

    def sums_of(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"), np.int64)
        return np.vstack([np.full(d, len(x)), (x >> 24).sum(axis=0), (x & (2**24 - 1)).sum(axis=0)])

    count, high, low = summed(rows, (3, d), sums_of, np.int64)
    n, sums = int(count[0]), [int(h) * 2**24 + int(x) for h, x in zip(high, low, strict=True)]
    trace = float(summed(rows, (d,), lambda batch: (centred(batch, n, sums) ** 2).sum(axis=0)).sum() / n)

    def product(w: np.ndarray) -> np.ndarray:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            r = centred(batch, n, sums)
            return r.T @ (r @ w)

        return summed(rows, w.shape, of) / n

    values, vectors, residuals, products = lobpcg(product, d, min(d, components), guard)
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return Whitening(n, sums, values, vectors * np.where(lead < 0, -1.0, 1.0), residuals, trace, products)


def whitened_of(batch: pa.RecordBatch, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, whitened rows): one column for each component with variance."""
    off = from_mean(matrix(batch.column("x"), np.int64), model.n, model.sums)
    kept = model.kept()
    return off, off.astype(np.float64) / model.n @ (model.vectors[:, kept] / np.sqrt(model.values[kept]))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = int(model.kept().sum())
    if not k:
        return None
    mean = summed(rows, (k,), lambda batch: whitened_of(batch, model)[1].sum(axis=0)) / model.n

    def of(batch: pa.RecordBatch) -> np.ndarray:
        w = whitened_of(batch, model)[1] - mean
        return w.T @ w

    return float(np.abs(summed(rows, (k, k), of) / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, key: str, model: Whitening, error: float | None) -> DataFrame:
    """rows(key, x) -> a row for each one and component: key, component (from 1), n, deviation, whitened, explained, identity_error, residual."""
    kind = rows.schema[key].dataType.simpleString()
    k, kept = len(model.values), model.kept()
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, w = whitened_of(batch, model)
            m = len(off)
            out = np.full((m, k), np.nan)
            out[:, kept] = w
            repeat = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict({
                key: batch.column(key).take(pa.array(repeat)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n, np.int64)),
                "deviation": pa.array(squares(off), pa.int64()).take(pa.array(repeat)),
                "whitened": pa.array(out.reshape(-1), mask=np.isnan(out.reshape(-1))),
                "explained": pa.array(explained * m, pa.float64()),
                "identity_error": pa.array([error] * (m * k), pa.float64()),
                "residual": pa.array(np.tile(model.residuals.astype(np.float64), m)),
            })

    return rows.select(key, "x").mapInArrow(run, f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double")


def whiten_embeddings(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """embeddings(key, vector, ...) -> whiten()'s rows: all usable vectors are fitted and whitened."""
    rows = save(whole_numbers(embeddings, key, vector), "whole")
    model = fit(rows, components)
    if model is None:
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
        return whiten(rows.where("false"), key, model, None)
    return whiten(rows, key, model, identity_error(rows, model))
