"""Groups of fingerprints by partitions of set length and rare signatures, against all pairs."""

import numpy as np
import pytest

from strandmill.llm import spotsigs


def brute(rows, share, threshold):
    """doc_id to the set of doc_ids in its group, by comparing every two rows."""
    counts, n = {}, 0
    for _, t in rows:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
            n += 1
    sign = spotsigs.Fingerprinter(sorted(w for w, k in counts.items() if k >= share * n))
    sets = [sign(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(np.intersect1d(a, b))
            if (not len(a) and not len(b)) or (len(a) and both >= threshold * (len(a) + len(b) - both)):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def texts():
    rng = np.random.default_rng(9)
    vocabulary = ["the", "of", "a"] * 30 + [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(20, 400, 40)]
    for base in out[:12]:  # near copies: words replaced, and longer or shorter ones
        for share in (0.01, 0.03, 0.08):
            words = base.split()
            for at in rng.integers(0, len(words), max(1, int(share * len(words)))):
                words[at] = f"x{rng.integers(1000)}"
            out.append(" ".join(words))
        out.append(base + " " + " ".join(rng.choice(vocabulary, 12)))
    # a chain of texts that differ a little from the one before
    words = out[0].split() * 2
    for i in range(25):
        words[i * 3] = f"c{i}"
        out.append(" ".join(words))
    return out + ["", "", "lone", "lone", "the of a", None]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_groups_by_all_pairs(spark, threshold):
    rows = [(i * 3 % 211, t) for i, t in enumerate(texts())]
    rows += rows[3:6] + [(None, rows[0][1])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _key string, band string").repartition(5)
    got = spotsigs.near_groups(frame, threshold, share=0.02).collect()
    assert len(got) == len(rows)
    group = brute(rows, 0.02, threshold)
    want = []
    for (d, _), g in zip(rows, group):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == g]
        want.append((d, min(x for x in ids if x is not None), len(ids)))
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted(((r.doc_id, r.group_id, r.group_size) for r in got), key=key) == sorted(want, key=key)
    assert len(set(group)) < len({t for _, t in rows if t}) - 10  # groups of different texts are there


def test_one_crowded_bucket(spark):
    """Many different sets that share a signature and little else: all meet, none is lost, few become pairs."""
    tail = [" ".join(f"the r{i}x{j} s{i}y{j}" for j in range(4)) for i in range(700)]
    rows = [(i, f"the same start {t}") for i, t in enumerate(tail)] + [(5000, f"the same start {tail[7]} the q q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.near_groups(frame, 0.8, share=0.2).collect()}
    assert got[5000].group_id == 7 and got[7].group_size == 2
    assert all(got[i].group_size == 1 for i in range(700) if i != 7)


def test_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert spotsigs.near_groups(frame).count() == 0
    only = spotsigs.near_groups(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.group_id, r.group_size) for r in only] == [(None, None, 2)] * 2


def test_centres_and_pairs_are_not_compared_again(spark):
    """What a bucket's star has compared stays out of its blocks: its centre, and with it buckets of two."""
    shared = spark.createDataFrame([(b"a", 1, b"a"), (b"b", 1, b"a"), (b"a", 2, b"a"), (b"b", 2, b"a"), (b"c", 2, b"a")], "_key binary, band long, _c binary")
    found = spark.createDataFrame([(k, k) for k in (b"a", b"b", b"c")], "id binary, component binary")
    got = sorted((r.band, bytes(r._key)) for r in spotsigs.others_placed(shared, found).collect())
    assert got == [(1, b"b"), (2, b"b"), (2, b"c")]


def test_signatures_are_counted_many_sets_at_once(spark, monkeypatch):
    """A count takes a pass over all counters, which once was made for each set."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 32, k, dtype=np.uint32)) for k in (0, 1, 5, 700, 40)] * 9
    frame = spark.createDataFrame([(bytearray(s.astype("<u4").tobytes()),) for s in sets], "s binary").coalesce(1)
    want = sum(np.bincount(spotsigs.counter(s), minlength=spotsigs.COUNTERS) for s in sets)
    for together in (2, spotsigs.TOGETHER):
        monkeypatch.setattr(spotsigs, "TOGETHER", together)
        assert (spotsigs.rarity(frame) == want).all()
