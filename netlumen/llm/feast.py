"""Eigenpairs of a symmetric matrix in chosen intervals, by contour integration.

``count_above`` is the inertia of a shifted matrix from its LDL' factors, ``intervals``
cuts the upper spectrum where inertia says how many eigenvalues lie between, and ``solve``
finds those of one interval: a quadrature of complex shifted solves along a circle round
it projects a block of vectors onto the wanted eigenvectors, and Rayleigh-Ritz in what is
left gives the pairs. It ends when as many as inertia counts are inside, with residuals at
rounding level. Matrices are as wide as a vector, never as long as the data.
"""

from __future__ import annotations

import numpy as np

NODES = 8
_PIVOT = (1 + 17 ** 0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: the positive part of the inertia of matrix - shift I,
    read from LDL' with one- and two-row pivots."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[p] == 0 and off[i, j] == 0:
            break
        pivot = [p] if diagonal[p] >= _PIVOT * off[i, j] else [int(i), int(j)]
        # A two-row pivot has a negative determinant: one eigenvalue of either sign.
        positive += int(a[p, p] > 0) if len(pivot) == 1 else 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        column = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - column @ np.linalg.solve(a[np.ix_(pivot, pivot)], column.T)
        a = (a + a.T) / 2
    return positive


def intervals(matrix: np.ndarray, k: int, width: int, jitter: float = 0.0) -> list[tuple[float, float, int]]:
    """(low, high, count) that cover the k greatest eigenvalues, about ``width`` in each."""
    size = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    if size == 0 or top == 0:
        return []
    middle = 0.5 + jitter
    low, high = -top * (1 + 1e-9), top
    count = size
    while count > k + width // 2 and high - low > 1e-13 * top:
        mid = low + (high - low) * middle
        c = count_above(matrix, mid)
        if c >= k:
            low, count = mid, c
        else:
            high = mid
    out, stack = [], [(low, top, count, 0)]
    while stack:
        lo, hi, above_lo, above_hi = stack.pop()
        if above_lo - above_hi <= width or hi - lo < 1e-9 * top:
            if above_lo > above_hi:
                out.append((lo, hi, above_lo - above_hi))
            continue
        mid = lo + (hi - lo) * middle
        c = count_above(matrix, mid)
        stack += [(lo, mid, above_lo, c), (mid, hi, c, above_hi)]
    return out


def solve(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between low and high, vectors as columns; fewer or more if
    the contour does not settle on as many."""
    size = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max())
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * (np.pi / 2) * (1 - x))               # the upper half circle
    centre, radius = (low + high) / 2, (high - low) / 2
    width = min(size, count + count // 2 + 4)
    values, vectors = np.zeros(0), np.zeros((size, 0))
    while True:
        block = np.random.default_rng(20240611).standard_normal((size, width))
        worst = np.inf
        for _ in range(rounds):
            moved = np.zeros((size, width))
            for t, weight in zip(turn, w):
                shifted = (centre + radius * t) * np.eye(size) - matrix
                moved += (weight * radius / 2) * np.real(t * np.linalg.solve(shifted, block.astype(complex)))
            # Directions that the contour leaves nothing of fall away.
            u, s, _ = np.linalg.svd(moved, full_matrices=False)
            q = u[:, s > 1e-14 * s[0]]
            ritz, y = np.linalg.eigh(q.T @ matrix @ q)
            block = q @ y
            inside = (ritz > low) & (ritz <= high)
            values, vectors = ritz[inside], block[:, inside]
            if len(values) == count:
                left = np.abs(matrix @ vectors - vectors * values).max(initial=0.0)
                if left <= 1e-15 * scale or left >= worst / 2 and left <= 1e-12 * scale:
                    return values, vectors
                worst = min(worst, left)
            if block.shape[1] < width:
                fresh = np.random.default_rng(block.shape[1]).standard_normal((size, width - block.shape[1]))
                block = np.concatenate([block, fresh], axis=1)
        if width == size:
            return values, vectors
        width = min(size, 2 * width)
