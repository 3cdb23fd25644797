"""Eigenvectors of a symmetric matrix by divide and conquer on polar factors.

For a shift s between the eigenvalues, the orthogonal polar factor U of A - sI has
the value 1 on the eigenvectors above s and -1 on those below, so (U + I) / 2 is the
projector on the upper ones. Bases of its range and of the rest cut A in two
blocks without a coupling, and each block is treated alike, until it is one value,
or as good as a multiple of the identity. The polar factor comes from the QDWH iteration: Halley steps with
weights that follow the smallest singular value, which needs six steps at most
for any condition, each a QR or a Cholesky factorisation.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = np.finfo(float).eps
#: From this weight on a step may use the normal equations without loss.
_CHOLESKY = 100.0
_STEPS = 40
#: Coupling of two blocks, for the norm of the whole matrix, that the polishing step takes away.
_COUPLING = 1e-13
#: Places between the values of the diagonal where a matrix is cut if the median and the mean do not do.
_QUANTILES = (0.25, 0.75, 0.1, 0.9)


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix."""
    size = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(size)
    x = a / norm
    # A lower bound of the smallest singular value: too small a one costs a step, no more.
    low = max(1 / (np.linalg.norm(_inverse(x)) + 1e-300) / math.sqrt(size), _EPS / 8)
    low = min(low, 1.0)
    identity = np.eye(size)
    for _ in range(_STEPS):
        l2 = low * low
        d = (4 * max(1 - l2, 0.0) / (l2 * l2)) ** (1 / 3)
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - l2) / (l2 * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > _CHOLESKY:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, identity]))
            new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:size] @ q[size:].T)
        else:
            half = np.linalg.cholesky(identity + wc * (x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(low * (wa + wb * l2) / (1 + wc * l2), 1.0)
        if abs(1 - low) < 10 * _EPS and moved < (10 * _EPS) ** (1 / 3):
            break
    return x


def _inverse(x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return np.full_like(x, 1 / _EPS)


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the eigenspaces of ``a`` above and below the shift."""
    size = len(a)
    projector = (polar(a - shift * np.eye(size)) + np.eye(size)) / 2
    rank = int(round(np.trace(projector)))
    # Subspace iteration; the start is fixed and general, the projector alone decides the range.
    start = np.random.default_rng(size).standard_normal((size, size))
    upper, _ = np.linalg.qr(projector @ start[:, :rank]) if rank else (np.empty((size, 0)), None)
    if rank:
        upper, _ = np.linalg.qr(projector @ upper)
    rest = start[:, rank:] - upper @ (upper.T @ start[:, rank:])
    lower, _ = np.linalg.qr(rest) if rank < size else (np.empty((size, 0)), None)
    if rank < size:
        lower = lower - projector @ lower
        lower, _ = np.linalg.qr(lower - upper @ (upper.T @ lower))
    return upper, lower


def _divide(a: np.ndarray, scale: float) -> np.ndarray:
    size = len(a)
    if size == 1:
        return np.ones((1, 1))
    middle = np.diag(a)
    off = np.linalg.norm(a - np.diag(middle))
    if off <= _EPS * scale:
        return np.eye(size)
    # The mean lies strictly between the extreme values, the median of the diagonal halves the work more evenly.
    # A shift that meets a value leaves its vectors on both sides; the coupling tells, and other shifts are tried.
    median, mean = float(np.median(middle)), float(np.mean(middle))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for shift in (median, mean, (median + mean) / 2, *(float(q) for q in np.quantile(middle, _QUANTILES))):
        upper, lower = split(a, shift)
        if not (upper.shape[1] and lower.shape[1]):
            continue
        coupling = float(np.linalg.norm(upper.T @ a @ lower))
        if best is None or coupling < best[0]:
            best = coupling, upper, lower
        if coupling <= _COUPLING * scale:
            break
    if best is None:
        return np.eye(size)
    return np.hstack([base @ _divide(_within(a, base), scale) for base in best[1:]])


def _within(a: np.ndarray, base: np.ndarray) -> np.ndarray:
    found = base.T @ a @ base
    return (found + found.T) / 2


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and unit vectors as columns of a symmetric matrix."""
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    vectors = _divide(a, scale)
    vectors, _ = np.linalg.qr(vectors)
    # One polishing step: what rounding left between two components is turned back, which leaves second order only.
    inner = vectors.T @ a @ vectors
    values = np.diag(inner).copy()
    gap = values[None, :] - values[:, None]
    clear = np.abs(gap) > 1e-6 * scale
    turn = np.where(clear, (inner + inner.T) / 2 / np.where(clear, gap, 1.0), 0.0)
    np.fill_diagonal(turn, 0.0)
    vectors, upper = np.linalg.qr(vectors + vectors @ turn)
    vectors = vectors * np.where(np.diag(upper) < 0, -1.0, 1.0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
