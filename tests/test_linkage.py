"""Packed linkage against correlations of whole columns, over several blocks and planes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import linkage

N, M = 330, 60


@pytest.fixture(scope="module")
def genotypes(spark):
    rng = np.random.default_rng(6)
    g = rng.integers(0, 3, (N, M)).astype(float)
    for j in range(1, M, 3):
        g[:, j] = np.where(rng.random(N) < 0.8, g[:, j - 1], g[:, j])
    g[:, 40] = 1.0
    g[rng.random((N, M)) < 0.1] = np.nan
    g[:, 41] = np.nan
    order = rng.permutation(M)  # a variant's number isn't its place
    chrom, pos = ["1" if k < 35 else "2" for k in range(M)], [100 * (k % 35) + (k == 7) * -100 for k in range(M)]
    calls = spark.createDataFrame([(int(3 * i), int(order[k]), None if np.isnan(g[i, k]) else int(g[i, k])) for i in range(N) for k in range(M)], "sample_idx long, variant_idx int, dosage int")
    variants = spark.createDataFrame([(int(order[k]), chrom[k], pos[k]) for k in range(M)], "variant_idx int, chr string, pos long")
    place = sorted(range(M), key=lambda k: (chrom[k], pos[k], order[k]))
    return calls.cache(), variants, g, order, chrom, pos, place


def r2(g, a, b):
    ok = ~np.isnan(g[:, a]) & ~np.isnan(g[:, b])
    if not ok.any():
        return "none"
    x, y = g[ok, a], g[ok, b]
    return None if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1] ** 2


@pytest.mark.parametrize("rows,plane", [(256, 1 << 18), (7, 128)])
@pytest.mark.parametrize("by_number,reach", [(False, 450), (True, 4)])
def test_ld(genotypes, monkeypatch, rows, plane, by_number, reach):
    monkeypatch.setattr(linkage, "ROWS", rows)
    monkeypatch.setattr(linkage, "PLANE", plane)
    calls, variants, g, order, chrom, pos, place = genotypes
    got = {(r.i, r.j): r.r2 for r in linkage.ld(calls, variants, reach, by_number).collect()}
    want = {}
    for n, a in enumerate(place):
        for b in place[n + 1 :]:
            near = place.index(b) - n <= reach if by_number else abs(pos[a] - pos[b]) <= reach
            if chrom[a] == chrom[b] and near and (v := r2(g, a, b)) != "none":
                ids = (int(order[a]), int(order[b]))
                want[ids if by_number else tuple(sorted(ids))] = v
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def test_prune(genotypes):
    calls, variants, g, order, chrom, pos, place = genotypes
    kept, want = [], {}
    for n, a in enumerate(place):
        near = [b for b in place[max(0, n - 4) : n] if chrom[a] == chrom[b] and want[int(order[b])]]
        want[int(order[a])] = not any(isinstance(v := r2(g, b, a), float) and v > 0.2 for b in near)
    assert {r.variant_idx: r.kept for r in linkage.prune(calls, variants, 5, 0.2).collect()} == want and not all(want.values())


def test_no_rows_of_pairs_and_samples(genotypes):
    """Calls take part in no join with pairs; what meets are planes."""
    calls, variants, *_ = genotypes
    assert linkage.ld(calls.limit(0), variants, 500).count() == 0
    planes = linkage.bit_planes(calls)
    assert planes.count() == M - 1 and planes.select(F.max(F.octet_length("planes"))).first()[0] == 3 * 8 * -(-3 * N // 64)
