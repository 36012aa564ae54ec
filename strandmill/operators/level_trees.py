"""Tree members grown level by level over packed blocks: what boosting.fit_trees grows, on patches that no task holds.

The state of a fit is the trees so far. A pass reads the blocks, works out each sample's score and node from the trees, and
sums gradient, hessian and count by (estimator, variant tile, node, variant, bin). The best split of a tile is found where
its sums meet; only split tables reach the driver and go out again with the next pass. Gradients are rounded to a power of
two (boosting.quantum), so sums are exact and don't depend on the order of rows and tasks.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

from . import boosting as B
from .packed import TILE, Block, each_block, pack, summed, tiles, unpacked, values

#: Trees of a forest that grow together, and their nodes in one pass.
TOGETHER, NODES = 16, 1024
SPLITS = "estimator_idx int, tile int, node int, gain double, place int, bin int, left array<double>, all array<double>"


class Patch:
    """An estimator's variants: their ids, cuts between values, and the bin of each code (variants x 4)."""

    def __init__(self, variants: np.ndarray, x: np.ndarray, present: np.ndarray):
        self.variants, self.bins, self.cuts = variants, np.zeros(x.shape, np.uint8), []
        for j in range(len(x)):
            there = np.unique(x[j][present[j]])
            self.cuts.append((there[1:] + there[:-1]) / 2)
            self.bins[j] = np.searchsorted(self.cuts[-1], x[j])
        self.most = max((len(c) + 1 for c in self.cuts), default=1)


def placed(tree: dict[int, tuple], bins: np.ndarray) -> np.ndarray:
    """The open node (heap number, root 1) or leaf of each sample; tree: node -> (place, bin)."""
    at = np.ones(bins.shape[1], np.int64)
    rows = np.arange(bins.shape[1])
    for _ in range(64):
        nodes = np.unique(at)
        todo = [k for k in nodes if k in tree]
        if not todo:
            return at
        for k in todo:
            mine = rows[at == k]
            place, cut = tree[k]
            at[mine] = 2 * k + (bins[place, mine] > cut)
    return at


def grown_value(tree: dict, values: dict[int, float], bins: np.ndarray) -> np.ndarray:
    at = placed(tree, bins)
    out = np.zeros(len(at))
    for k in np.unique(at):
        out[at == k] = values[k]
    return out


def nested(tree: dict[int, tuple], values: dict[int, float], k: int = 1):
    if k not in tree:
        return values[k]
    return [int(tree[k][0]), int(tree[k][1]), nested(tree, values, 2 * k), nested(tree, values, 2 * k + 1)]


class Fit:
    """What is known of one estimator's fit."""

    def __init__(self, patch: Patch, kind: str, classes: bool, seed: int, stats: dict, with_offset: bool, settings: dict | None):
        self.patch, self.kind, self.classes, self.seed, self.s = patch, kind, classes, seed, B.SETTINGS[kind] | (settings or {})
        mean = stats["mean"]
        self.base = 0.0 if with_offset else float(np.log((mean + 1e-6) / (1 - mean + 1e-6))) if classes else mean
        self.quanta = B.quantum(stats["n"], stats["most"]), B.quantum(stats["n"], stats["most_w"])
        self.with_offset, self.done = with_offset, []  # (tree, values) of finished trees
        self.open: dict[int, dict[int, tuple]] = {}  # growing trees by number
        self.totals: dict[int, dict[int, tuple]] = {}
        self.active: dict[int, list[int]] = {}
        self.best, self.stopped = (np.inf, 0), False

    def scores(self, b: Block, bins: np.ndarray) -> np.ndarray:
        z = b.offset.copy() if self.with_offset else np.full(len(b.y), self.base)
        for tree, values in self.done:
            z += self.s["rate"] * grown_value(tree, values, bins)
        return z

    def columns(self, number: int) -> np.ndarray | None:
        if self.kind != "random_forest":
            return None
        return B.forest_columns(len(self.patch.variants), self.classes, self.seed, number)

    def leaf(self, total) -> float:
        return float(total[0] / (total[1] + self.s["l2"] + 1e-12))


def sums_part(fits: dict[int, Fit]):
    """part() of packed.summed: for each open node of each growing tree a histogram (3, bins, variants of the tile); and, as
    tile -1, the loss of the rows that check."""

    def part(b: Block):
        fit = fits.get(b.estimator)
        if fit is None or fit.stopped:
            return
        p = fit.patch
        bins = np.take_along_axis(p.bins, b.codes, axis=1)
        teach = np.flatnonzero(~b.check)
        forest = fit.kind == "random_forest"
        z = b.offset if forest else fit.scores(b, bins)
        if b.check.any() and not forest:
            loss = np.logaddexp(0, z) - b.y * z if fit.classes else (b.y - z) ** 2
            yield -1, 0, np.array([loss[b.check].sum(), b.check.sum()])
        own = bins[:, teach]
        y, w, z = b.y[teach], b.weight[teach], z[teach]
        chance = 1 / (1 + np.exp(-z)) if fit.classes and not forest else z
        g = B.rounded((y - chance) * w, fit.quanta[0])
        h = B.rounded((chance * (1 - chance) if fit.classes and not forest else 1.0) * w, fit.quanta[1])
        is_bin = [(own == c).astype(np.float64) for c in range(p.most)]
        for number, tree in fit.open.items():
            times = B.poisson(b.ids[teach], fit.seed, number) if forest else np.ones(len(y))
            at = placed(tree, own)
            for k in fit.active[number]:
                mine = np.flatnonzero((at == k) & (times > 0))
                v = np.stack([g[mine] * times[mine], h[mine] * times[mine], times[mine]], axis=1)
                hist = np.stack([m[:, mine] @ v for m in is_bin])  # bins, variants, 3
                for t, lo, hi in tiles(len(own), TILE):
                    yield t, number * NODES + k, np.ascontiguousarray(hist[:, lo:hi].transpose(2, 0, 1)).ravel()

    return part


def best_split(fits: dict[int, Fit]):
    """finish() of packed.summed: the best split of each node in a tile; of a symmetric tree the one split of all its nodes."""

    def finish(key, nodes):
        e, tile = key
        if tile < 0:
            loss = nodes[0]
            yield {"estimator_idx": e, "tile": tile, "node": 0, "gain": loss[0] / max(loss[1], 1), "place": 0, "bin": 0, "left": [], "all": []}
            return
        fit = fits[e]
        b = fit.patch.most
        hists = {k: v.reshape(3, b, -1).transpose(0, 2, 1) for k, v in sorted(nodes.items())}  # 3, variants, bins

        def row(node, gain, flat, hist):
            place, cut = divmod(int(flat), b - 1) if b > 1 else (0, 0)
            return {"estimator_idx": e, "tile": tile, "node": node, "gain": float(gain), "place": place + tile * TILE, "bin": cut, "left": hist[:, place, : cut + 1].sum(axis=1).tolist(), "all": hist[:, 0].sum(axis=1).tolist()}

        l2, least = fit.s["l2"], fit.s["least"]
        if fit.s["symmetric"]:
            gain = sum(B.gains(h, l2, 0) for h in hists.values())
            gain = np.where(np.isfinite(B.gains(sum(hists.values()), l2, least)), gain, -np.inf)
            flat = int(np.argmax(gain)) if gain.size else 0
            for k, h in hists.items():
                yield row(k, gain.flat[flat] if gain.size else -np.inf, flat, h)
            return
        for k, h in hists.items():
            gain = B.gains(h, l2, least)
            able = fit.columns(k // NODES)
            if able is not None:
                mask = np.ones(len(gain), bool)
                mask[able[(able >= tile * TILE) & (able < (tile + 1) * TILE)] - tile * TILE] = False
                gain[mask] = -np.inf
            flat = int(np.argmax(gain)) if gain.size else 0
            yield row(k, gain.flat[flat] if gain.size else -np.inf, flat, h)

    return finish


def step(made: DataFrame, fits: dict[int, Fit]) -> dict[tuple[int, int], dict]:
    """One pass: each open node's best split over all tiles (the first of equals), and the checks' losses as tile -1."""
    best: dict[tuple[int, int], dict] = {}
    for r in summed(made, sums_part(fits), best_split(fits), SPLITS).collect():  # a row for each estimator, node and tile
        r = r.asDict()
        key = (r["estimator_idx"], -1 if r["tile"] < 0 else r["node"])
        was = best.get(key)
        if was is None or (r["gain"], -r["tile"]) > (was["gain"], -was["tile"]):
            best[key] = r
    return best


def close(fit: Fit, number: int, level: int, found: dict[int, dict]) -> None:
    """Applies a level's splits to a tree; nodes without one are leaves."""
    tree, totals = fit.open[number], fit.totals[number]
    again = []
    if fit.s["symmetric"] and found:  # nodes without rows share the split
        any_split = next(iter(found.values()))
        found = {k: any_split | {"all": [0.0] * 3, "left": [0.0] * 3} for k in fit.active[number]} | found
    for k in fit.active[number]:
        r = found.get(k) or {"all": [0.0] * 3, "gain": -np.inf}
        totals[k] = tuple(r["all"])
        if r["gain"] > 1e-9:
            tree[k] = (r["place"], r["bin"])
            left = np.array(r["left"])
            for child, total in ((2 * k, left), (2 * k + 1, np.array(r["all"]) - left)):
                totals[child] = tuple(total)
                again.append(child)
    fit.active[number] = again if level + 1 < fit.s["depth"] else []


def fit_by_levels(made: DataFrame, patches: dict[int, Patch], stats: dict[int, dict], kind: str, classes: bool, seed: int, with_offset: bool, check: bool, patience: int = 10, settings: dict | None = None) -> dict[int, dict]:
    """The models of all estimators by one kind, as boosting.fit_trees gives them, from passes over the blocks. All
    estimators take part in each pass. Forests grow TOGETHER trees at a time, boosting one."""
    s = B.SETTINGS[kind] | (settings or {})
    fits = {e: Fit(p, kind, classes, seed + e, stats[e], with_offset, settings) for e, p in patches.items()}
    per_round = TOGETHER if kind == "random_forest" else 1
    for first in range(0, s["rounds"], per_round):
        numbers = range(first, min(first + per_round, s["rounds"]))
        for fit in fits.values():
            fit.open, fit.totals = {n: {} for n in numbers}, {n: {} for n in numbers}
            fit.active = {n: [1] for n in numbers}
        for level in range(s["depth"]):
            if not any(k for fit in fits.values() if not fit.stopped for k in fit.active.values()):
                break
            found = step(made, fits)
            for e, fit in fits.items():
                if fit.stopped:
                    continue
                if level == 0 and (e, -1) in found and kind != "random_forest":
                    stop_check(fit, found[e, -1]["gain"], patience)
                    if fit.stopped:
                        continue
                for n in numbers:
                    if fit.active[n]:
                        close(fit, n, level, {k: found[e, n * NODES + k] for k in fit.active[n] if (e, n * NODES + k) in found})
        for fit in fits.values():
            if not fit.stopped:
                fit.done += [(fit.open[n], {k: fit.leaf(t) if t[2] else 0.0 for k, t in fit.totals[n].items()}) for n in numbers]
        if all(fit.stopped for fit in fits.values()):
            break
    if check and kind != "random_forest":
        if not all(fit.stopped for fit in fits.values()):  # the last trees' loss
            for fit in fits.values():
                fit.open = {}
            found = step(made, fits)
            for e, fit in fits.items():
                if not fit.stopped and (e, -1) in found:
                    stop_check(fit, found[e, -1]["gain"], patience)
        for fit in fits.values():
            fit.done = fit.done[: fit.best[1]] if fit.best[0] < np.inf else fit.done
    return {e: {"kind": kind, "classes": classes, "base": fit.base, "rate": s["rate"], "cuts": [c.tolist() for c in fit.patch.cuts], "trees": [nested(t, v) for t, v in fit.done]} for e, fit in fits.items()}


def stop_check(fit: Fit, loss: float, patience: int) -> None:
    """The loss of the checking rows under the trees so far."""
    if not fit.done:
        return
    if loss < fit.best[0] - 1e-12:
        fit.best = (loss, len(fit.done))
    elif len(fit.done) - fit.best[1] >= patience:
        fit.stopped = True


def statistics(made: DataFrame, with_offset: bool, classes: bool) -> dict[int, dict]:
    """Of each estimator: rows, rows that teach, their weighted mean, and bounds for gradients and hessians."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        for b in each_block(batches):
            t = ~b.check
            y, w, o = b.y[t], b.weight[t], b.offset[t]
            n = len(y)
            ends = [float(v) for v in (y.min(), y.max(), w.max(), np.abs(y - o).max())] if n else [None] * 4
            yield pa.RecordBatch.from_pylist([dict(zip(("e", "rows", "n", "w", "wy", "lo", "hi", "most_w", "far"), (b.estimator, len(b.y), n, float(w.sum()), float((w * y).sum()), *ends)))], schema=pa.schema([("e", pa.int32()), ("rows", pa.int64()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("w", "wy", "lo", "hi", "most_w", "far")]]))

    parts = made.mapInArrow(run, "e int, rows long, n long, w double, wy double, lo double, hi double, most_w double, far double")
    got = parts.groupBy("e").agg(*[f(c).alias(c) for f, cs in ((F.sum, ("rows", "n", "w", "wy")), (F.min, ("lo",)), (F.max, ("hi", "most_w", "far"))) for c in cs]).collect()
    out = {}
    for r in got:
        mean = r["wy"] / r["w"] if r["w"] else 0.0
        far = 0.0 if not r["n"] else r["far"] if with_offset else max(abs(r["hi"] - mean), abs(r["lo"] - mean))
        out[r["e"]] = {"rows": r["rows"], "n": r["n"], "mean": mean, "most": (r["most_w"] or 0.0) * max(far, 1.0 if classes else 0.0) if r["n"] else 1.0, "most_w": r["most_w"] or 0.0}
    return out


#: Patches of at most so many cells are fitted in one task, larger ones by levels; the trees are the same.
WHOLE = 32 << 20


def fit_packed(made: DataFrame, patches: dict[int, Patch], x: dict[int, np.ndarray], kinds: list[str], classes: bool = False, seed: int = 22, with_offset: bool = False, check: bool = False, scale: tuple[float, float] | None = None, whole: int = WHOLE, settings: dict | None = None, margin: bool = False) -> DataFrame:
    """(estimator_idx, member, variants, model) of every kind on each estimator's blocks; scale: (mean, sd) of a scaled label."""
    spark = made.sparkSession
    more = ({} if scale is None else {"mean": scale[0], "sd": scale[1]}) | ({"margin": True} if margin else {})
    stats = statistics(made, with_offset, classes)
    form = "estimator_idx int, member int, variants array<int>, model string"
    if all(stats[e]["rows"] * len(p.variants) <= whole for e, p in patches.items() if e in stats):
        variants = {e: p.variants for e, p in patches.items()}

        def run(rows):
            import pandas as pd

            bs = [unpacked(r) for r in rows.sort_values("ids").to_dict("records")]
            e = bs[0].estimator
            cells = np.take_along_axis(x[e], np.concatenate([b.codes for b in bs], axis=1), axis=1).T
            y, w, o, c, ids = (np.concatenate([getattr(b, f) for b in bs]) for f in ("y", "weight", "offset", "check", "ids"))
            out = []
            for k, kind in enumerate(kinds):
                model = B.fit_trees(cells, y, kind, classes, w, o if with_offset else None, c if check else None, seed=seed + e, ids=ids, settings=settings)
                used, model = B.pruned(model, variants[e])
                out.append((e, k, used, json.dumps(model | more)))
            return pd.DataFrame(out, columns=["estimator_idx", "member", "variants", "model"])

        return made.groupBy("estimator_idx").applyInPandas(run, form)
    out = []
    known = {e: p for e, p in patches.items() if e in stats}
    for k, kind in enumerate(kinds):
        for e, model in fit_by_levels(made, known, stats, kind, classes, seed, with_offset, check, settings=settings).items():
            used, model = B.pruned(model, known[e].variants)
            out.append((e, k, used, json.dumps(model | more)))
    return spark.createDataFrame(out, form)


def read_packed(calls: DataFrame, stats: DataFrame, members: DataFrame) -> DataFrame:
    """(estimator_idx, sample_idx, pred): the mean of an estimator's members for every sample with calls. The models, whose
    size their settings bound, go to the tasks; only variants that they split on are packed."""
    models = [(r["estimator_idx"], list(r["variants"]), r["model"]) for r in members.select("estimator_idx", "variants", "model").collect()]
    ids = sorted({v for _, vs, _ in models for v in vs})
    x = worth(stats, ids)
    at = {v: i for i, v in enumerate(ids)}
    by_estimator: dict[int, list] = {}
    for e, vs, model in models:
        by_estimator.setdefault(e, []).append((np.array([at[v] for v in vs], int), model))

    def run(batches):
        import pyarrow as pa

        read = {e: [(places, json.loads(m)) for places, m in ms] for e, ms in by_estimator.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n = part.num_rows
                codes = np.stack([np.frombuffer(c, np.uint8) for c in part.column(1).to_pylist()], axis=1)
                for e, ms in read.items():
                    preds = [B.read_trees(model, np.take_along_axis(x[places], codes[places], axis=1).T) for places, model in ms]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, e, np.int32)), part.column(0), pa.array(np.mean(preds, axis=0))], names=["estimator_idx", "sample_idx", "pred"])

    return pack(calls, ids, everyone=True).mapInArrow(run, "estimator_idx int, sample_idx long, pred double")


def worth(stats: DataFrame, ids: list[int]) -> np.ndarray:
    """variants x 4: what the codes of the variants `ids` are worth; one row of each reaches the driver."""
    wanted = stats.sparkSession.createDataFrame([(int(v),) for v in ids], "variant_idx int")
    got = {r["variant_idx"]: (r["maf"], r["a0_freq"]) for r in stats.join(wanted, "variant_idx", "left_semi").select("variant_idx", "maf", "a0_freq").collect()}
    nan = float("nan")
    both = np.array([[nan if v is None else v for v in got[i]] for i in ids], float).reshape(-1, 2)
    return values(both[:, 0], both[:, 1])
