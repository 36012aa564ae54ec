"""Tree members of an ensemble: boosted trees and forests on a patch that fits into a task, kept as plain data; level_trees
grows the same trees over blocks of larger patches.

Three boosted kinds differ in their usual settings only: `lightgbm` and `xgboost` grow greedy trees (the second with a
penalty on leaves), `catboost` symmetric ones, where all nodes of a depth share their split. Genotypes have few distinct
values, so splits are found on counts by value."""

from __future__ import annotations

import math

import numpy as np

SETTINGS = {
    "lightgbm": {"rounds": 60, "rate": 0.1, "depth": 3, "l2": 0.0, "least": 5, "symmetric": False},
    "xgboost": {"rounds": 60, "rate": 0.1, "depth": 4, "l2": 1.0, "least": 1, "symmetric": False},
    "catboost": {"rounds": 60, "rate": 0.1, "depth": 4, "l2": 3.0, "least": 1, "symmetric": True},
    "random_forest": {"rounds": 60, "rate": 1.0, "depth": 8, "l2": 0.0, "least": 2, "symmetric": False},
}
BINS = 16


def _codes(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each value's bin, and the cuts between bins, by variant."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)))
        cuts.append((values[1:] + values[:-1]) / 2)
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1) if cuts else np.zeros(x.shape, int), cuts


def quantum(n: int, most: float) -> float:
    """The power of two to whose multiples n values of at most `most` (by a margin of 4) are rounded, so that sums of them are
    exact in double precision and the same in any order."""
    return 2.0 ** (np.ceil(np.log2(max(n, 1) * max(most, 1e-300) * 4)) - 52)


def rounded(v: np.ndarray, q: float) -> np.ndarray:
    return np.rint(v / q) * q


def largest(y, weight, offset, mean: float, classes: bool) -> float:
    """A bound for the first gradients of rows: the largest weight times the largest distance from the start."""
    if not len(y):
        return 1.0
    far = np.abs(y - (mean if offset is None else offset)).max()
    return float(weight.max() * max(far, 1.0 if classes else 0.0))


def poisson(ids: np.ndarray, seed: int, number: int) -> np.ndarray:
    """How often a tree of a forest draws each sample: Poisson with mean 1 by the hash of the sample, so that a block of
    samples needs no other block to know."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + number) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(below, x / 2.0**64, side="right").astype(float)


def forest_columns(m: int, classes: bool, seed: int, number: int) -> np.ndarray:
    """The variants that a tree of a forest may split on: all for values, the square root of their number for classes."""
    return np.sort(np.random.default_rng([seed, number]).choice(m, int(np.ceil(m**0.5)), replace=False)) if classes else np.arange(m)


def gains(hist: np.ndarray, l2: float, least: float) -> np.ndarray:
    """Gain of a split after each bin of each variant, from sums of gradient, hessian and count (3, variants, bins)."""
    gl, hl, nl = hist.cumsum(axis=2)[:, :, :-1]
    g, h, n = hist.sum(axis=2)[:, :, None]
    gr, hr, nr = g - gl, h - hl, n - nl
    gain = gl**2 / (hl + l2 + 1e-12) + gr**2 / (hr + l2 + 1e-12) - g**2 / (h + l2 + 1e-12)
    return np.where((nl < least) | (nr < least), -np.inf, gain)


def _gains(codes, g, h, l2, least):
    m = codes.shape[1]
    cell = (codes + np.arange(m) * BINS).ravel()
    return gains(np.stack([np.bincount(cell, np.repeat(v, m), m * BINS).reshape(m, BINS) for v in (g, h, np.ones(len(g)))]), l2, least)


def _grow(codes, g, h, depth, l2, least, columns):
    """A nested [variant's place, bin, below, above] or a leaf's value."""
    if depth:
        gain = _gains(codes[:, columns], g, h, l2, least)
        k = int(np.argmax(gain)) if gain.size else 0
        if gain.size and gain.flat[k] > 1e-9:
            j, cut = int(columns[k // gain.shape[1]]), k % gain.shape[1]
            low = codes[:, j] <= cut
            return [j, cut, *(_grow(codes[s], g[s], h[s], depth - 1, l2, least, columns) for s in (low, ~low))]
    return float(g.sum() / (h.sum() + l2 + 1e-12))


def _grow_symmetric(codes, g, h, depth, l2, least):
    leaf, splits = np.zeros(len(g), int), []
    for _ in range(depth):
        gain = sum(_gains(codes[leaf == k], g[leaf == k], h[leaf == k], l2, 0) for k in np.unique(leaf))
        whole = _gains(codes, g, h, l2, least)
        gain = np.where(np.isfinite(whole), gain, -np.inf)
        k = int(np.argmax(gain))
        if gain.flat[k] <= 1e-9:
            break
        j, cut = k // gain.shape[1], k % gain.shape[1]
        splits.append((j, cut))
        leaf = leaf * 2 + (codes[:, j] > cut)

    def nested(level, number):
        if level == len(splits):
            own = leaf == number
            return float(g[own].sum() / (h[own].sum() + l2 + 1e-12)) if own.any() else 0.0
        return [int(splits[level][0]), int(splits[level][1]), nested(level + 1, 2 * number), nested(level + 1, 2 * number + 1)]

    return nested(0, 0)


def _read(tree, codes) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(codes), tree)
    return np.where(codes[:, tree[0]] <= tree[1], _read(tree[2], codes), _read(tree[3], codes))


def fit_trees(x: np.ndarray, y: np.ndarray, kind: str, classes: bool = False, weight: np.ndarray | None = None, offset: np.ndarray | None = None, check: np.ndarray | None = None, patience: int = 10, seed: int = 22, ids: np.ndarray | None = None, settings: dict | None = None) -> dict:
    """The model as plain data. Rows marked in `check` teach nothing and stop the boosting once their loss has not
    fallen for `patience` rounds; an offset is where each row's boosting starts; weights count rows; a forest draws rows by their ids."""
    s = SETTINGS[kind] | (settings or {})
    codes, cuts = _codes(x)
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    teach = np.ones(len(y), bool) if check is None else ~check
    mean = float((y[teach] * w[teach]).sum() / w[teach].sum()) if w[teach].sum() else 0.0
    base = 0.0 if offset is not None else float(np.log((mean + 1e-6) / (1 - mean + 1e-6))) if classes else mean
    z = np.full(len(y), base) if offset is None else offset.astype(float).copy()
    trees, best, every = [], (np.inf, 0), np.arange(x.shape[1])
    ids = np.arange(len(y)) if ids is None else ids
    fine = quantum(int(teach.sum()), largest(y[teach], w[teach], None if offset is None else offset[teach], mean, classes)), quantum(int(teach.sum()), w[teach].max(initial=0.0))
    for k in range(s["rounds"]):
        if kind == "random_forest":
            draw = np.repeat(np.flatnonzero(teach), poisson(ids[teach], seed, k).astype(int))
            rest = rounded((y - (0.0 if offset is None else offset)) * w, fine[0])
            trees.append(_grow(codes[draw], rest[draw], rounded(w, fine[1])[draw], s["depth"], s["l2"], s["least"], forest_columns(len(every), classes, seed, k)))
            continue
        p = 1 / (1 + np.exp(-z)) if classes else z
        g, h = rounded((y - p) * w, fine[0]), rounded((p * (1 - p) if classes else 1.0) * w, fine[1])
        grow = _grow_symmetric(codes[teach], g[teach], h[teach], s["depth"], s["l2"], s["least"]) if s["symmetric"] else _grow(codes[teach], g[teach], h[teach], s["depth"], s["l2"], s["least"], every)
        trees.append(grow)
        z += s["rate"] * _read(grow, codes)
        if check is not None and check.any():
            loss = np.logaddexp(0, z[check]) - y[check] * z[check] if classes else (y[check] - z[check]) ** 2
            if loss.mean() < best[0] - 1e-12:
                best = (float(loss.mean()), k + 1)
            elif k + 1 - best[1] >= patience:
                break
    if check is not None and check.any() and kind != "random_forest":
        trees = trees[: best[1]]
    return {"kind": kind, "classes": classes, "base": base, "rate": s["rate"], "cuts": [c.tolist() for c in cuts], "trees": trees}


def read_trees(model: dict, x: np.ndarray, offset: np.ndarray | float = 0.0) -> np.ndarray:
    """The value, or the probability of class 1."""
    codes = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(model["cuts"])], axis=1) if model["cuts"] else np.zeros((len(x), 0), int)
    if model["kind"] == "random_forest":
        out = offset + (np.mean([_read(t, codes) for t in model["trees"]], axis=0) if model["trees"] else np.zeros(len(x)))
    else:
        z = model["base"] + offset + model["rate"] * sum((_read(t, codes) for t in model["trees"]), np.zeros(len(x)))
        out = 1 / (1 + np.exp(-z)) if model["classes"] and not model.get("margin") else z
    return out * model.get("sd", 1.0) + model.get("mean", 0.0)  # fitted to a scaled label


def splits_of(tree) -> set[int]:
    return {tree[0]} | splits_of(tree[2]) | splits_of(tree[3]) if isinstance(tree, list) else set()


def pruned(model: dict, variants: list[int]) -> tuple[list[int], dict]:
    """The variants that the model's trees split on, and the model over these alone."""
    used = sorted(set().union(*(splits_of(t) for t in model["trees"])))
    at = {j: i for i, j in enumerate(used)}
    move = lambda t: [at[t[0]], t[1], move(t[2]), move(t[3])] if isinstance(t, list) else t
    return [int(variants[j]) for j in used], model | {"cuts": [model["cuts"][j] for j in used], "trees": [move(t) for t in model["trees"]]}
