"""NumPy algebra on small matrices (n x n, n = number of columns) inside tasks."""

from __future__ import annotations

import numpy as np


def positive_r(rows: np.ndarray) -> np.ndarray:
    """R factor with a non-negative diagonal. Unique for full column rank, so it does not depend on row order."""
    r = np.linalg.qr(rows, mode="r")
    signs = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    return np.triu(r * signs[:, None]) + 0.0


def positive_qr(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(rows, mode="reduced")
    signs = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    return q * signs, np.triu(r * signs[:, None]) + 0.0


def solve_named(matrix: np.ndarray, rhs: np.ndarray, lam: float) -> np.ndarray:
    """Linear solve that names the penalty when the system is singular."""
    try:
        return np.linalg.solve(matrix, rhs)
    except np.linalg.LinAlgError as error:
        raise ValueError(f"singular least-squares system for lambda={lam}; use a positive penalty") from error


def ridge_from_gram(gram: np.ndarray, cross: np.ndarray, lam: float) -> np.ndarray:
    """(A'A + lam I) x = A'b. A matrix that is singular to the precision of its own sums is an error, not an answer."""
    if lam < 0:
        raise ValueError(f"the normal equations need a non-negative penalty, got lambda={lam}")
    matrix = gram + lam * np.eye(len(gram))
    if numerical_rank(matrix) < len(matrix):
        raise ValueError(f"singular least-squares system for lambda={lam}; use a positive penalty or the QR route")
    return solve_named(matrix, cross, lam)


def numerical_rank(gram: np.ndarray) -> int:
    """Rank of a Gram matrix by Cholesky with pivoting, each column first scaled to length 1.

    A pivot is the squared distance of its column from those before it, relative to its length. Sums of products carry
    some n rounding errors; pivots below 128 n of them say nothing (condition numbers beyond about 1e6 for n = 10).
    """
    n = len(gram)
    sizes = np.sqrt(np.maximum(np.diagonal(gram), 0.0))
    if n == 0 or not np.all(np.isfinite(gram)):
        return n  # NaN and infinity show in the solution
    if np.any(sizes == 0):
        return int(np.count_nonzero(sizes))
    rest = gram / sizes[:, None] / sizes[None, :]
    for step in range(n):
        pivot = step + int(np.argmax(np.diagonal(rest)[step:]))
        if rest[pivot, pivot] <= 128 * n * np.finfo(float).eps:
            return step
        if pivot != step:
            rest[[step, pivot]] = rest[[pivot, step]]
            rest[:, [step, pivot]] = rest[:, [pivot, step]]
        below = rest[step + 1 :, step] / np.sqrt(rest[step, step])
        rest[step + 1 :, step + 1 :] -= np.outer(below, below)
    return n


def has_dependent_column(r: np.ndarray) -> bool:
    """True when a diagonal entry of R is at rounding level next to its own column (whatever the column's scale)."""
    sizes = np.linalg.norm(r, axis=0)
    return bool(np.any(np.abs(np.diagonal(r)) <= len(r) * np.finfo(float).eps * sizes))


def ridge_from_r(r: np.ndarray, n: int, lam: float) -> np.ndarray:
    """Minimise ||Ax-b||^2 + lam ||x||^2 from the R factor of [A | b]."""
    if lam < 0:
        raise ValueError(f"the QR route needs a non-negative penalty, got lambda={lam}")
    if lam > 0:
        penalty = np.zeros((n, r.shape[1]))
        np.fill_diagonal(penalty, np.sqrt(lam))
        r = positive_r(np.vstack([r, penalty]))
    if len(r) < n or has_dependent_column(r[:n, :n]):
        raise ValueError(f"singular least-squares system for lambda={lam}; use a positive penalty")
    return solve_named(r[:n, :n], r[:n, n:], lam)


def gradient_steps(moments, n: int, steps: int, step_size: float, lam: float) -> np.ndarray:
    """Gradient descent on (1/2m)||Ax-b||^2 + (lam/2)||x||^2 from per-step moments of [A | b | 1].

    ``moments(t)`` returns the Gram matrix of the rows used in step t (1-based), or None for an empty batch,
    which leaves the weights as they are.
    """
    weights = None
    for t in range(1, steps + 1):
        gram = moments(t)
        if gram is None:
            continue
        rhs = gram.shape[0] - n - 1
        if weights is None:
            weights = np.zeros((n, rhs))
        count = gram[-1, -1]
        if count == 0:
            continue
        rate = step_size / np.sqrt(t)
        slope = (gram[:n, :n] @ weights - gram[:n, n:-1]) / count
        weights = weights * (1.0 - rate * lam) - rate * slope
    return weights


def condition_one_norm(r: np.ndarray) -> float:
    """||R||_1 * ||R^-1||_1, infinite for a singular R."""
    if r.shape[0] < r.shape[1] or np.any(np.diagonal(r) == 0.0):
        return float("inf")
    inverse = np.linalg.solve(r, np.eye(len(r)))
    return float(np.abs(r).sum(axis=0).max() * np.abs(inverse).sum(axis=0).max())


def condition_two_norm(r: np.ndarray) -> float:
    sigma = np.linalg.svd(r, compute_uv=False)
    if r.shape[0] < r.shape[1] or sigma[-1] == 0.0:
        return float("inf")
    return float(sigma[0] / sigma[-1])
