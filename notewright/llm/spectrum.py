"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs of the pivots of an LDLᵀ factorisation of ``A - s I`` count the eigenvalues above
``s``. Bisection by these counts isolates each leading eigenvalue; inverse iteration from inside
its interval and Rayleigh quotient iteration find the pair, cubically; two more counts, just
above and just below the quotient, certify its number. A quotient that leaves its interval
sends the search back to bisection. Eigenvalues that no interval wider than rounding can part
are taken together, with an orthonormal basis of their space.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
# Fixed value: the pivot threshold (1 + sqrt(17)) / 8 of diagonal pivoting.
_PIVOT = (1 + 17 ** 0.5) / 8
_STEPS = 30


def positive_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive, from the pivots of its LDLᵀ factorisation.

    Pivots are single entries or blocks of two; such a block has one positive eigenvalue.
    """
    a, at, found = matrix.astype(np.float64, copy=True), 0, 0
    size = len(a)
    while at < size:
        column = np.abs(a[at + 1:, at])
        largest = column.max() if len(column) else 0.0
        pivot, block = abs(a[at, at]), 1
        if max(pivot, largest) == 0:
            at += 1
            continue
        if pivot < _PIVOT * largest:
            row = at + 1 + int(column.argmax())
            beside = np.abs(a[row, at:])
            beside[row - at] = 0
            across = beside.max()
            if pivot * across < _PIVOT * largest * largest:
                swap = at
                if abs(a[row, row]) < _PIVOT * across:
                    block, swap = 2, at + 1
                if swap != row:
                    a[[swap, row], at:] = a[[row, swap], at:]
                    a[at:, [swap, row]] = a[at:, [row, swap]]
        if block == 1:
            found += a[at, at] > 0
            side = a[at + 1:, at] / a[at, at]
            a[at + 1:, at + 1:] -= np.outer(side, a[at + 1:, at])
        else:
            found += 1
            side = a[at + 2:, at:at + 2]
            a[at + 2:, at + 2:] -= side @ np.linalg.solve(a[at:at + 2, at:at + 2], side.T)
        at += block
    return int(found)


class _Slices:
    """Counts of the eigenvalues above a shift, each factorised once."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.known = matrix, {}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positive_pivots(self.matrix - shift * np.eye(len(self.matrix)))
        return self.known[shift]


def _shifted_solve(matrix: np.ndarray, shift: float, right: np.ndarray, norm: float) -> np.ndarray:
    """A solution of the shifted system; a shift that is exactly an eigenvalue moves by a rounding."""
    for _ in range(3):
        try:
            found = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        shift += 4 * _EPS * norm
    return right


def _single(matrix: np.ndarray, slices: _Slices, low: float, high: float, number: int, norm: float, small: float):
    """The eigenpair alone in (low, high], the ``number``-th from the top."""
    start = np.random.default_rng(number).standard_normal(len(matrix))
    while True:
        vector, shift = start / np.linalg.norm(start), (low + high) / 2
        for step in range(_STEPS):
            vector = _shifted_solve(matrix, shift, vector, norm)
            vector /= np.linalg.norm(vector)
            image = matrix @ vector
            value = float(vector @ image)
            rest = float(np.linalg.norm(image - value * vector))
            # Two steps with the fixed shift settle the vector in the interval.
            if step > 0:
                if not low - small <= value <= high + small:
                    break
                shift = value
            if step > 1 and rest <= small:
                vector = _shifted_solve(matrix, value, vector, norm)
                vector /= np.linalg.norm(vector)
                value = float(vector @ (matrix @ vector))
                margin = max(4 * rest, small)
                if slices.above(value + margin) == number - 1 and slices.above(value - margin) == number:
                    return value, vector
                if slices.above(value + margin) < number <= slices.above(value - margin):
                    return value, vector  # a neighbour nearer than rounding: the number lies in the group
                break
        if high - low <= small:
            return value, vector
        middle = (low + high) / 2
        low, high = (middle, high) if slices.above(middle) >= number else (low, middle)


def _group(matrix: np.ndarray, low: float, high: float, size: int, number: int, norm: float):
    """An orthonormal basis of the space of ``size`` eigenvalues that rounding doesn't part."""
    basis = np.random.default_rng(number).standard_normal((len(matrix), size))
    for _ in range(4):
        basis = np.linalg.qr(_shifted_solve(matrix, high + 8 * _EPS * norm, basis, norm))[0]
    values = np.einsum("ij,ij->j", basis, matrix @ basis)
    order = np.argsort(-values)
    return values[order], basis[:, order]


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    A vector's entry of the largest size is positive.
    """
    matrix = (matrix + matrix.T) / 2
    size = len(matrix)
    wanted = min(wanted, size)
    norm = float(np.abs(matrix).sum(axis=1).max()) if size else 0.0
    if not wanted or norm == 0:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    small = 8 * _EPS * norm * max(1.0, size ** 0.5)
    slices = _Slices(matrix)
    values, vectors = [], []
    # Intervals (low, high] with the number of eigenvalues above either end, the highest on top.
    open_ = [(-1.01 * norm, 1.01 * norm, size, 0)]
    while open_ and len(values) < wanted:
        low, high, upto, before = open_.pop()
        if upto - before == 1:
            value, vector = _single(matrix, slices, low, high, upto, norm, small)
            values.append(value)
            vectors.append(vector)
        elif high - low <= small:
            some, basis = _group(matrix, low, high, upto - before, upto, norm)
            values.extend(some)
            vectors.extend(basis.T)
        else:
            middle = (low + high) / 2
            inside = min(max(slices.above(middle), before), upto)
            for part in ((low, middle, upto, inside), (middle, high, inside, before)):
                if part[2] > part[3]:
                    open_.append(part)
    basis = np.array(vectors[:wanted]).T
    # Near neighbours are made orthogonal to rounding, in falling order.
    for k in range(basis.shape[1]):
        for _ in range(2):
            basis[:, k] -= basis[:, :k] @ (basis[:, :k].T @ basis[:, k])
            basis[:, k] /= np.linalg.norm(basis[:, k])
    largest = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    return np.array(values[:wanted]), basis * np.where(largest < 0, -1.0, 1.0)
