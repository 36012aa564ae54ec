"""Simulation: genotypes from latent normals, interaction pairs under constraints, liabilities, manifests, a two-SNP grid."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linkage import hash_normal, hash_uniform
from .storage import cut

# The constants of the rational approximation of the normal distribution (error below 7.5e-8).
_P, _B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    t = 1.0 / (1.0 + _P * F.abs(z))
    tail = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi) * t * (_B[0] + t * (_B[1] + t * (_B[2] + t * (_B[3] + t * _B[4]))))
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def thresholded(z: Column, p: Column) -> Column:
    """The dosage of a latent normal at Hardy-Weinberg cut points for allele frequency p."""
    u, none = normal_cdf(z), (1 - p) * (1 - p)
    return F.when(u < none, 0).when(u < none + 2 * p * (1 - p), 1).otherwise(2)


def interaction_pairs(variants: DataFrame, additive: DataFrame, n: int, overlap: float, both_additive: bool, seed: int, blocks: DataFrame | None = None, different_block: bool = False, outside_additive_blocks: bool = False, tries: int = 50) -> DataFrame:
    """(i, j, kind): n distinct unordered pairs, int(n overlap) of which have an additive variant (or two), the rest none.

    Candidates are drawn by hash, `tries` for each pair wanted; those that a constraint rejects, and repeated ones, go.
    blocks (variant_idx, block): different_block forbids pairs within a block, outside_additive_blocks forbids, for pairs
    without additive variants, blocks that hold one. Fewer pairs come where there are too few, as the caller can count."""
    spark = variants.sparkSession
    v = variants.select("variant_idx").distinct()
    add = additive.select("variant_idx").distinct()
    plain = v.join(add, "variant_idx", "left_anti")

    def placed(rows):
        """Numbered in order, so that a hash can pick one; a simulation's variants are one bounded table."""
        return rows.select(F.col("variant_idx").alias("_v"), (F.row_number().over(Window.orderBy("variant_idx")) - 1).alias("_at"))

    def drawn(first, second, k, kind):
        n1, n2 = first.count(), second.count()
        if not k or not n1 or not n2:
            return spark.createDataFrame([], "i long, j long, kind string, _try long")
        c = spark.range(k * tries).select("id", F.floor(hash_uniform("id", seed=f"{seed}{kind}a") * n1).cast("int").alias("_a"), F.floor(hash_uniform("id", seed=f"{seed}{kind}b") * n2).cast("int").alias("_b"))
        c = c.join(placed(first).withColumnsRenamed({"_v": "_x", "_at": "_a"}), "_a").join(placed(second).withColumnsRenamed({"_v": "_y", "_at": "_b"}), "_b").where("_x <> _y")
        return c.groupBy(F.least("_x", "_y").cast("long").alias("i"), F.greatest("_x", "_y").cast("long").alias("j")).agg(F.lit(kind).alias("kind"), F.min("id").alias("_try"))

    k = int(n * overlap)
    every = [(drawn(plain, plain, n - k, "plain"), n - k), (drawn(add, add if both_additive else v, k, "overlap"), k)]
    out = None
    for c, wanted in every:
        if blocks is not None and (different_block or outside_additive_blocks):
            of = blocks.select("variant_idx", "block")
            held = of.join(add, "variant_idx", "left_semi").select(F.col("block").alias("_h")).distinct()
            for x in "ij":
                c = c.join(of.select(F.col("variant_idx").cast("long").alias(x), F.col("block").alias(f"_b{x}")), x, "left")
            if different_block:
                c = c.where(F.coalesce(F.col("_bi") != F.col("_bj"), F.lit(True)))
            if outside_additive_blocks:
                for x in "ij":
                    inside = c.join(held, F.col(f"_b{x}") == F.col("_h"), "left_semi").where("kind = 'plain'").select("i", "j")
                    c = c.join(inside, ["i", "j"], "left_anti")
        c = c.orderBy("_try", "i", "j").limit(wanted).select("i", "j", "kind")
        out = c if out is None else out.unionByName(c)
    return out


def liability(parts: DataFrame, shares: dict[str, float], seed: int, train: str = "split = 'train'") -> DataFrame:
    """Adds liability: each column of parts scaled to sqrt(share) over its training deviation, and environmental noise with
    what the shares leave of variance 1; shares of 1 and more together are an error."""
    rest = 1.0 - sum(shares.values())
    if rest <= 0:
        raise ValueError("the shares have to leave some variance for the noise")
    sds = parts.where(train).agg(*[F.stddev_pop(c).alias(f"_sd_{c}") for c in shares])  # one row
    total = hash_normal("sample_idx", seed=f"{seed}e") * math.sqrt(rest)
    for c, h in shares.items():
        total = total + F.coalesce(F.col(c) * math.sqrt(h) / F.nullif(F.col(f"_sd_{c}"), F.lit(0.0)), F.lit(0.0))
    return parts.crossJoin(F.broadcast(sds)).withColumn("liability", total).drop(*[f"_sd_{c}" for c in shares])


def manifest(effects: DataFrame, pairs: DataFrame, variants: DataFrame, settings: dict) -> dict[str, DataFrame]:
    """The simulation's record as tables: settings (name, value), additive effects and pairs with their places."""
    v = variants.select("variant_idx", "chr", "pos")
    placed = pairs
    for x in "ij":
        placed = placed.join(v.select(F.col("variant_idx").cast("long").alias(x), F.col("chr").alias(f"chr_{x}"), F.col("pos").alias(f"pos_{x}")), x, "left")
    named = effects.sparkSession.createDataFrame([(k, float(x)) for k, x in settings.items()], "name string, value double")
    return {"settings": named, "additive": effects.join(v, "variant_idx"), "pairs": placed}


def two_snp_grid(calls: DataFrame, samples: DataFrame, pairs: DataFrame, depths=(2, 3, 4), shares=(0.0, 0.15, 0.3), h_add: float = 0.3, seed: int = 0) -> DataFrame:
    """(i, j, h_epi, depth, mse_linear, mse_tree, delta): a line and a tree of limited depth on two variants, held against labels
    with additive effects of both, their product (a share h_epi of the variance) and noise for the rest.

    calls (sample_idx, variant_idx, dosage), samples (sample_idx, split: train, test), pairs (i, j) with i < j. Labels are drawn
    by hash for each sample and pair; two variants have nine cells at most, so Spark counts and sums labels by cell and the
    fits see these sums alone. Samples without both calls are left out; pairs without rows of a split go."""
    side = lambda k: calls.where("dosage is not null").select("sample_idx", F.col("variant_idx").alias(k), F.col("dosage").cast("double").alias(f"d{k}"))
    both = pairs.select("i", "j").join(side("i"), "i").join(side("j"), ["sample_idx", "j"]).join(samples.select("sample_idx", "split"), "sample_idx")
    effect = lambda tag: hash_normal("i", "j", seed=f"{seed}{tag}")
    both = both.withColumn("_add", effect("a") * F.col("di") + effect("b") * F.col("dj")).withColumn("_epi", effect("c") * F.col("di") * F.col("dj")).withColumn("_noise", hash_normal("sample_idx", "i", "j", seed=f"{seed}e"))
    both = cut(both)
    sds = both.where("split = 'train'").groupBy(F.col("i").alias("_i"), F.col("j").alias("_j")).agg(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_sd{c}") for c in ("_add", "_epi")])
    each = both.join(sds, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j"))).withColumn("h_epi", F.explode(F.array(*[F.lit(float(h)) for h in shares])))
    y = F.col("_add") / F.col("_sd_add") * math.sqrt(h_add) + F.col("_epi") / F.col("_sd_epi") * F.sqrt("h_epi") + F.col("_noise") * F.sqrt(1 - h_add - F.col("h_epi"))
    cells = each.withColumn("y", y).groupBy("i", "j", "h_epi", "split", "di", "dj").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    wanted = list(map(int, depths))

    def run(rows):
        import pandas as pd

        train, test = rows[rows["split"] == "train"], rows[rows["split"] != "train"]
        if not len(train) or not len(test):
            return pd.DataFrame({c: [] for c in ("i", "j", "h_epi", "depth", "mse_linear", "mse_tree", "delta")})
        x, n, s = (train[c].to_numpy(float) for c in (["di", "dj"], "n", "s"))
        design = np.column_stack([x, np.ones(len(x))])
        line = np.linalg.lstsq(design * np.sqrt(n)[:, None], s / np.sqrt(n), rcond=None)[0]
        to = test[["di", "dj"]].to_numpy(float)

        def error(p):  # of predictions by cell
            return float((test["q"] - 2 * p * test["s"] + p * p * test["n"]).sum() / test["n"].sum())

        straight, out = error(np.column_stack([to, np.ones(len(to))]) @ line), []
        for depth in wanted:
            bent = error(_tree_values(_tree(x, n, s, depth), to))
            out.append((int(rows["i"].iloc[0]), int(rows["j"].iloc[0]), float(rows["h_epi"].iloc[0]), depth, straight, bent, straight - bent))
        return pd.DataFrame(out, columns=["i", "j", "h_epi", "depth", "mse_linear", "mse_tree", "delta"])

    return cells.groupBy("i", "j", "h_epi").applyInPandas(run, "i int, j int, h_epi double, depth int, mse_linear double, mse_tree double, delta double")


def _tree(x: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int):
    """A regression tree over cells with n rows and label sums s: (variant, cut, below, above) by least squares, or a leaf's
    mean."""
    best = None
    for j in range(x.shape[1]) if depth and len(n) > 1 else ():
        for at in np.unique(x[:, j])[1:]:
            low = x[:, j] < at
            gain = s[low].sum() ** 2 / n[low].sum() + s[~low].sum() ** 2 / n[~low].sum()
            if best is None or gain > best[0] + 1e-12:
                best = (gain, j, at, low)
    if best is None:
        return float(s.sum() / n.sum())
    return best[1], best[2], *(_tree(x[k], n[k], s[k], depth - 1) for k in (best[3], ~best[3]))


def _tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] < tree[1], _tree_values(tree[2], x), _tree_values(tree[3], x))


def demo(samples: int, variants: int, seed: int = 0, h_geno: float = 0.3, h_cov: float = 0.1, missing: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A small demonstration set for the PLINK writers: dosages (variants, samples) with -127 for missing calls, covariates
    (age, sex) and the liability."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.05, 0.5, variants)
    g = rng.binomial(2, p[:, None], (variants, samples))
    cov = np.column_stack([rng.uniform(30, 80, samples), rng.integers(0, 2, samples)])
    part = lambda x, h: (x - x.mean()) / (x.std() or 1) * math.sqrt(h)
    y = part(rng.standard_normal(variants) @ g, h_geno) + part(cov @ rng.standard_normal(2), h_cov) + rng.standard_normal(samples) * math.sqrt(1 - h_geno - h_cov)
    return np.where(rng.random(g.shape) < missing, -127, g), cov, y
