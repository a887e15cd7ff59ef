"""Smallest eigenpairs of one cloud's matrix in one task, without an exchange.

Block Lanczos on a Chebyshev polynomial of the matrix, which is large on the wanted
values and at most 1 on the others. A count of the values by random vectors says
where the wanted ones end. The basis stays orthogonal to the last digit, so what
is left of the vectors in each step tells how far off the pairs are. As a
block finds a repeated value no oftener than it has vectors, fresh random ones
must find nothing more before a cloud is done.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: vectors of a block, rows of the matrix that go through all passes while they are in a core's cache
BLOCK, TILE = 16, 2048
#: steps of the count, and how far below 1 the polynomial's values are beside those of the smallest value, as a logarithm
COUNT_STEPS, SHARP = 80, 10.0
#: residuals of the polynomial's pairs beside their values, and of the matrix's pairs at most
SETTLED, RESIDUAL = 1e-7, 1e-6
#: steps that fresh vectors get to find what was missed, and steps of a basis at most
FRESH_STEPS, STEPS = 2, 400


class Matrix:
    """A symmetric matrix by tiles of rows, for products with a few vectors: a pass over the rows' first entries beside the diagonal, one over the second and so on.

    Rows and columns are renamed: place i is row ``order[i]``, as in a tile rows of many entries come first.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int):
        own = row == col
        self.n, diagonal = n, np.zeros(n)
        diagonal[row[own]] = value[own]
        row, col, self.value = row[~own], col[~own], value[~own]
        count = np.bincount(row, minlength=n)
        starts = np.cumsum(count) - count
        self.order = np.concatenate([low + np.argsort(-count[low : low + TILE], kind="stable") for low in range(0, n, TILE)])
        self.diagonal = diagonal[self.order, None]
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        self.tiles, values, at = [], [], 0
        for low in range(0, n, TILE):
            rows, passes = self.order[low : low + TILE], []
            for k, m in enumerate(np.searchsorted(-count[rows], -np.arange(count[rows[0]]), side="left")):
                entries = starts[rows[:m]] + k
                passes.append((place[col[entries]], slice(at, at + m)))
                values.append(self.value[entries])
                at += m
            self.tiles.append((slice(low, low + len(rows)), passes))
        self.value = np.concatenate(values)[:, None] if values else np.zeros((0, 1))
        self.held = np.empty((2, min(n, TILE), BLOCK))

    def _product(self, x: np.ndarray, diagonal: np.ndarray, value: np.ndarray, out: np.ndarray, less: bool) -> None:
        """Rows of the matrix times ``x`` into ``out``, less what is there where asked for; a tile's sums stay in a core's cache."""
        width = x.shape[1]
        for rows, passes in self.tiles:
            total = np.multiply(x[rows], diagonal[rows], out=self.held[0, : rows.stop - rows.start, :width])
            for col, entries in passes:
                term = np.take(x, col, axis=0, out=self.held[1, : len(col), :width], mode="clip")
                term *= value[entries]
                total[: len(col)] += term
            if less:
                np.subtract(total, out[rows], out=out[rows])
            else:
                out[rows] = total

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        self._product(x, self.diagonal, self.value, out, False)
        return out

    def chebyshev(self, x: np.ndarray, low: float, high: float, degree: int) -> Iterator[np.ndarray]:
        """Chebyshev's polynomials of the matrix, with ``low`` .. ``high`` mapped to -1 .. 1, times ``x``: those of degree 1, 2 and so on. What a step gave is gone two steps later."""
        half, mid = (high - low) / 2.0, (high + low) / 2.0
        diagonal, value = (self.diagonal - mid) / half, self.value / half
        before, now = x.copy(), np.empty_like(x)
        self._product(x, diagonal, value, now, False)
        yield now
        diagonal, value = 2.0 * diagonal, 2.0 * value
        for _ in range(1, degree):
            self._product(now, diagonal, value, before, True)
            before, now = now, before
            yield now


def _end(matrix: Matrix, wanted: int, rng: np.random.Generator) -> float:
    """About where the ``wanted`` smallest values end, by the moments of random vectors."""
    n = matrix.n
    before = rng.standard_normal((n, BLOCK))
    before /= np.linalg.norm(before, axis=0)
    moments = [1.0]
    dot = lambda a, b: float(np.einsum("ij,ij->", a, b)) / BLOCK
    for now in matrix.chebyshev(before, 0.0, 2.0, COUNT_STEPS):
        moments.append(dot(now, before) * (1.0 if len(moments) == 1 else 2.0) - (0.0 if len(moments) == 1 else moments[1]))
        moments.append(2.0 * dot(now, now) - 1.0)
        before = now
    order = np.arange(len(moments))
    turn = math.pi / (len(moments) + 1)
    damped = ((len(moments) - order + 1) * np.cos(turn * order) + np.sin(turn * order) / math.tan(turn)) / (len(moments) + 1) * moments
    low, high = 0.0, math.pi  # the angle from the lower end
    for _ in range(50):
        angle = (low + high) / 2
        # the step function that is 1 on angles below, in Chebyshev's polynomials
        terms = 2.0 * np.sin(order[1:] * (math.pi - angle)) / (order[1:] * math.pi)
        below = n * (damped[0] * angle / math.pi - (damped[1:] * terms).sum())
        low, high = (angle, high) if below < wanted else (low, angle)
    return float(np.clip(1.0 - math.cos(high), 1e-7, 1.5))


def _orthogonal(x: np.ndarray, basis: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what of ``x`` is not in the basis, as vectors of length 1 at right angles; their factor; the parts of ``x`` along the basis)."""
    along = np.zeros((sum(v.shape[1] for v in basis), x.shape[1]))
    for _ in range(2):
        at = 0
        for v in basis:
            part = v.T @ x
            x = x - v @ part
            along[at : at + len(part)] += part
            at += len(part)
    q, factor = np.linalg.qr(x)
    for v in basis:  # vectors that nearly vanished keep digits of the basis
        q -= v @ (v.T @ q)
    q, again = np.linalg.qr(q)
    return q, again @ factor, along


def smallest(matrix: Matrix, k: int, seed: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """The ``k`` smallest values in order, and their vectors, by rows of ``TILE`` in the matrix's order."""
    n, rng = matrix.n, np.random.default_rng(seed)
    end = _end(matrix, 2 * k + 10, rng)
    while True:
        basis, turn, enough = _basis(matrix, k, end, rng)
        if enough:
            break
        end = min(1.5 * end, 1.9)
    values, worst, panels = np.zeros(k), 0.0, [slice(at, min(at + BLOCK, k)) for at in range(0, k, BLOCK)]

    def vectors(rows: slice, some: slice) -> np.ndarray:
        out, at = 0.0, 0
        for v in basis:
            out = out + v[rows] @ turn[at : at + v.shape[1], some]
            at += v.shape[1]
        return out

    for some in panels:
        x = np.ascontiguousarray(vectors(slice(None), some))
        y = matrix.times(x)
        values[some] = (x * y).sum(axis=0)
        y -= x * values[some]
        worst = max(worst, float(np.sqrt((y * y).sum(axis=0)).max()))
    if not worst <= RESIDUAL:
        raise ArithmeticError(f"the {k} smallest eigenvalues of {n} points have a residual of {worst:.3g}")
    order = np.argsort(values, kind="stable")
    turn = turn[:, order]
    return values[order], (vectors(slice(at, at + TILE), slice(None)) for at in range(0, n, TILE))


def _basis(matrix: Matrix, k: int, end: float, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray, bool]:
    """(basis, the wanted vectors in it, whether the polynomial tells the wanted values from the others)."""
    degree = max(2, 2 * math.ceil(SHARP / math.acosh((2.0 + end) / (2.0 - end)) / 2))
    n = matrix.n

    def filtered(x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, x.shape[1], BLOCK):
            for now in matrix.chebyshev(np.ascontiguousarray(x[:, at : at + BLOCK]), end, 2.0, degree):
                pass
            out.append(now)
        return np.hstack(out)

    fresh = lambda: filtered(rng.standard_normal((n, BLOCK)))
    basis, projected = [_orthogonal(fresh(), [])[0]], np.zeros((0, 0))
    known, since = None, 0
    for _ in range(STEPS):
        here = basis[-1]
        rest, factor, along = _orthogonal(filtered(here), basis)
        m, wide = len(along), here.shape[1]
        projected = np.pad(projected, (0, m - len(projected)))
        projected[:, m - wide :] = along
        projected[m - wide :, :] = along.T
        projected[m - wide :, m - wide :] = (along[m - wide :] + along[m - wide :].T) / 2
        since += 1
        if m >= k:
            sizes, turn = np.linalg.eigh(projected)
            sizes, turn = sizes[::-1][:k], turn[:, ::-1][:, :k]
            off = np.linalg.norm(factor @ turn[m - wide :], axis=0)
            if (off <= SETTLED * np.abs(sizes)).all():
                if sizes[-1] < 2.0:
                    return basis, turn, end >= 1.9
                if known is not None and since >= FRESH_STEPS and (np.abs(sizes - known) <= 1e-8 * known).all():
                    return basis, turn, True
                if known is None or since >= FRESH_STEPS:
                    known, since = sizes, 0
                    rest = np.hstack([rest, _orthogonal(fresh(), [*basis, rest])[0]])
        basis.append(rest)
    raise ArithmeticError(f"the {k} smallest eigenvalues of {n} points did not settle in {STEPS} steps")
