"""Linear members from Gram tiles: X'WX, X'Wy and their like are summed over packed blocks, tile pair by tile pair, and only
these sums come together for an estimator, whatever its number of samples.

Squared losses need one pass; logistic losses are Newton steps, a pass each, with a proximal inner solve where there is an L1
penalty. The variants of a patch are a parameter: an estimator's Gram matrix (variants squared, doubles) is held by one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .estimators import soft
from .packed import TILE, Block, summed, tiles

#: (kind, settings) of members: least squares with penalties alpha (l1 |b| + (1 - l1) / 2 b^2), None being 1 / rows; evidence
#: maximisation; logistic losses with l2 on their sum, or l1 and l2 on their mean.
KINDS = {
    "linear": ("squared", 1e-9, 0.0), "linear_l1": ("squared", 0.05, 1.0), "linear_l2": ("squared", None, 0.0), "elasticnet": ("squared", 0.05, 0.5), "bayesian": ("bayesian",),
    "logistic": ("logistic", 1.0), "logistic_free": ("logistic", 1e-9), "logistic_l1": ("logistic_net", 0.01, 0.0), "logistic_elasticnet": ("logistic_net", 0.005, 0.005),
}
PASSES = 40


def part_of(x: dict[int, np.ndarray], state: dict[int, np.ndarray] | None = None, done: frozenset = frozenset()):
    """part() of packed.summed. Tile (i, j) is number i * tiles + j. With a state (coefficients and intercept) rows are weighted
    by the curvature of the logistic loss there, and y is what is left of it."""

    def part(b: Block):
        e = b.estimator
        if e in done:
            return
        own = np.take_along_axis(x[e], b.codes, axis=1)
        teach = np.where(b.check, 0.0, b.weight)
        w, r = teach, teach * b.y
        if state is not None:
            z = np.clip(state[e][:-1] @ own + state[e][-1], -30, 30)
            p = 1 / (1 + np.exp(-z))
            w, r = teach * p * (1 - p), teach * (b.y - p)
        cut = tiles(len(own), TILE)
        for i, lo, hi in cut:
            yield i * len(cut) + i, 1, np.stack([own[lo:hi] @ w, own[lo:hi] @ r])
            weighted = own[lo:hi] * w
            for j, a, z_ in cut[i:]:
                yield i * len(cut) + j, 0, weighted @ own[a:z_].T
        yield 0, 2, np.array([teach.sum(), w.sum(), r.sum(), (teach * b.y * b.y).sum(), (~b.check).sum()])

    return part


def assembled(rows, m: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(X'WX, X'W1, X'r, [weight, curvature, sum r, sum y squared, rows]) from the tiles of one estimator."""
    t = max(1, -(-m // size))
    g, s, c, one = np.zeros((m, m)), np.zeros(m), np.zeros(m), np.zeros(5)
    for tile, node, v in rows:
        v = np.frombuffer(v, np.float64)
        i, j = divmod(tile, t)
        a, b = slice(i * size, min(m, (i + 1) * size)), slice(j * size, min(m, (j + 1) * size))
        if node == 2:
            one = v
        elif node == 1:
            s[a], c[a] = v.reshape(2, -1)
        else:
            g[a, b] = v.reshape(a.stop - a.start, -1)
            g[b, a] = g[a, b].T
    return g, s, c, one


def descend(g: np.ndarray, c: np.ndarray, l1: np.ndarray, l2: float, b: np.ndarray | None = None, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent for b'gb / 2 - c'b + sum l1 |b| + l2 / 2 b'b; variants without variance stay 0."""
    b = np.zeros(len(c)) if b is None else b.copy()
    left, q = c - g @ b, np.diag(g)
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(q > 1e-12):
            new = soft(left[j] + q[j] * b[j], l1[j]) / (q[j] + l2)
            if new != b[j]:
                left -= g[:, j] * (new - b[j])
                most, b[j] = max(most, abs(new - b[j])), new
        if most < 1e-10:
            break
    return b


def solve(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    try:
        half = np.linalg.cholesky(g)
        return np.linalg.solve(half.T, np.linalg.solve(half, c))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(g, c, rcond=None)[0]


def centred(g, s, c, one):
    """The same about the weighted means, a row of weight 1 on average: (X'X, X'y, mean of X, mean of y, y'y, rows)."""
    w = max(one[0], 1e-300)
    mx, my = s / w, one[2] / w
    return g / w - np.outer(mx, mx), c / w - mx * my, mx, my, one[3] / w - my * my, one[4]


def squared(g, s, c, one, alpha: float | None, l1: float) -> np.ndarray:
    xx, xy, mx, my, _, n = centred(g, s, c, one)
    alpha = 1 / max(n, 1) if alpha is None else alpha
    b = descend(xx, xy, np.full(len(xy), alpha * l1), alpha * (1 - l1)) if l1 else solve(xx + alpha * np.eye(len(xy)), xy)
    return np.append(b, my - mx @ b)


def bayesian(g, s, c, one, rounds: int = 100) -> np.ndarray:
    """Evidence maximisation of the noise and weight precisions, from the Gram matrix's eigenvalues."""
    xx, xy, mx, my, yy, n = centred(g, s, c, one)
    xx, xy, yy = xx * n, xy * n, yy * n
    values, axes = np.linalg.eigh(xx)
    values, along = np.maximum(values, 0.0), axes.T @ xy
    noise, weight = 1 / (yy / max(n, 1) + 1e-12), 1.0
    b = np.zeros(len(xy))
    for _ in range(rounds):
        b = axes @ (along / (values + weight / noise))
        used = (noise * values / (weight + noise * values)).sum()
        old, weight = weight, (used + 2e-6) / ((b**2).sum() + 2e-6)
        noise = (n - used + 2e-6) / (max(yy - 2 * b @ xy + b @ xx @ b, 0.0) + 2e-6)
        if abs(old - weight) < 1e-6 * weight:
            break
    return np.append(b, my - mx @ b)


def newton(kind: tuple, now: np.ndarray, g, s, c, one) -> np.ndarray:
    """The next coefficients and intercept under a logistic loss; g, s, c, one are taken at the present ones."""
    h = np.block([[g, s[:, None]], [s[None, :], np.array([[one[1]]])]])
    slope = np.append(c, one[2])
    if kind[0] == "logistic":
        reg = np.append(np.full(len(c), kind[1]), 1e-9)
        return now + solve(h + np.diag(reg), slope - reg * now)
    n, l1 = max(one[0], 1e-300), np.append(np.full(len(c), kind[1]), 0.0)
    h = h / n + np.diag(np.append(np.full(len(c), kind[2]), 1e-12))
    return descend(h, slope / n - np.append(kind[2] * now[:-1], 0.0) + h @ now, l1, 0.0, now)


def solved(made: DataFrame, x: dict[int, np.ndarray], work, state=None, done: frozenset = frozenset()) -> dict[int, np.ndarray]:
    """work(estimator, (g, s, c, one)) of each estimator, done where its tiles meet; as many doubles as it returns (coefficients
    or ranks) reach the driver."""
    sizes = {e: len(v) for e, v in x.items()}

    def run(rows):
        import pandas as pd

        e = int(rows["estimator_idx"].iloc[0])
        out = np.asarray(work(e, assembled(zip(rows["tile"], rows["node"], rows["sums"]), sizes[e], TILE)), np.float64)
        return pd.DataFrame({"estimator_idx": [e], "out": [out.tobytes()]})

    sums = summed(made, part_of(x, state, done))
    return {r["estimator_idx"]: np.frombuffer(r["out"], np.float64) for r in sums.groupBy("estimator_idx").applyInPandas(run, "estimator_idx int, out binary").collect()}


def fit(made: DataFrame, x: dict[int, np.ndarray], model: str) -> dict[int, np.ndarray]:
    """Coefficients and, last, the intercept of each estimator."""
    kind = KINDS[model]
    if kind[0] == "squared":
        return solved(made, x, lambda e, t: squared(*t, *kind[1:]))
    if kind[0] == "bayesian":
        return solved(made, x, lambda e, t: bayesian(*t))
    state, done = {e: np.zeros(len(v) + 1) for e, v in x.items()}, frozenset()
    for _ in range(PASSES):
        was = dict(state)
        new = solved(made, x, lambda e, t, was=was: newton(kind, was[e], *t), was, done)
        state |= new
        done |= {e for e, b in new.items() if np.abs(b - was[e]).max() < 1e-9}
        if len(done) >= len(new | dict.fromkeys(done)):
            break
    return state


def eliminated(xx: np.ndarray, xy: np.ndarray, keep: int) -> np.ndarray:
    """Recursive elimination by least squares from one inverse of the Gram matrix, down-dated for each variant that goes: the
    one with the smallest absolute coefficient (the last of equals). 1 for the `keep` that stay, 2 for the last to go."""
    m = len(xy)
    inverse = np.linalg.pinv(xx + 1e-12 * np.eye(m), hermitian=True)
    b, left, ranks = inverse @ xy, np.ones(m, bool), np.ones(m)
    for gone in range(m - keep):
        size = np.where(left, np.abs(b), np.inf)
        j = m - 1 - int(np.argmin(size[::-1]))
        left[j] = False
        ranks[j] = m - keep - gone + 1
        pivot = inverse[j, j]
        if pivot > 1e-14:
            b = b - inverse[:, j] * (b[j] / pivot)
            inverse = inverse - np.outer(inverse[:, j], inverse[j] / pivot)
        b[j] = 0.0
    return ranks


def ranks(made: DataFrame, x: dict[int, np.ndarray], keep: int) -> dict[int, np.ndarray]:
    """The elimination's rank of each variant of each estimator."""
    return solved(made, x, lambda e, t: eliminated(*centred(*t)[:2], keep))
