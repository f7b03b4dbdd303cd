"""Linear support vector machines for samples of bounded size."""

import numpy as np


def train(
    rows: np.ndarray, signs: np.ndarray, cost: np.ndarray | float = 1.0, rounds: int = 40, tolerance: float = 1e-3, only: np.ndarray | None = None
) -> np.ndarray:
    """Weights w minimising |w|^2 / 2 + sum(cost * hinge loss), by dual coordinate descent.

    ``rows`` carries its own constant column if a bias is wanted; ``signs`` are 1 and
    -1; ``cost`` may differ from row to row. Rows are visited in a fixed random order;
    with ``only``, just these rows, without a copy of them.
    """
    n, width = rows.shape
    used = np.arange(n) if only is None else only
    cost = np.broadcast_to(np.asarray(cost, float), n)
    alpha, w = np.zeros(n), np.zeros(width)
    norms = np.maximum(np.einsum("ij,ij->i", rows, rows), 1e-12)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(used):
            gradient = signs[i] * float(rows[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * signs[i] * rows[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < tolerance:
            break
    return w


def platt(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to the chance of label 1 (Newton steps, light ridge)."""
    a = np.column_stack([margins, np.ones(len(margins))])
    k = np.ones(len(margins)) if weights is None else weights
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (k * (labels - p)) - 1e-3 * b
        hessian = (a * (k * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b += step
        if abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])
