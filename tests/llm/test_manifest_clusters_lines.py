"""The Merkle manifest, ball-tree clustering and line dedup against plain loops and their SQL, on small awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("strandmill.llm")
from pyspark.sql import functions as F

from strandmill.llm import ball_tree, line_dedup, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, _g string, _key string, _a long, keep long"
DIR = "/root/testdata/sf0.001"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def awkward(n: int = 200) -> list[tuple]:
    """Rows with null ids, sources and texts, repeated rows, repeated ids, lone sources and a hot one."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 2 else rng.choice(["a", "b", "é", None]), "en", 3, f"text {i}\nmore\n\n{i % 7}", "x", "y", 1, 2) for i in range(n)]
    rows += [(None, None, None, None, None, None, None, None, None)] * 3 + [(5, "hot", "en", 3, "text 5\nmore\n\n5", "x", "y", 1, 2)] * 2
    rows += [(None, "lone", "en", 1, "one\ntwo", None, None, None, None), (7, "\U0001f600", None, 0, "", None, None, None, None), (8, "", "en", 2, "x" * 200_000 + "\n" + "y\n" * 9, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def expected_proofs(rows):
    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = i - i % 3
            yield "".join(level[run:i]), "".join(level[i + 1 : run + 3])
            i //= 3

    made = []
    for r in rows:
        tampered = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        made.append((r[1], r[0], leaf(r, r[4]), leaf(r, tampered)))
    made.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))
    sources = list(dict.fromkeys(x[0] for x in made))
    trees = {s: tree([x[2] for x in made if x[0] == s]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out, seen = [], Counter()
    for s, doc, own, other in made:
        steps = [*path(trees[s], seen[s]), *path(top, sources.index(s))]
        seen[s] += 1
        folded = other
        for a, b in steps:
            folded = sha(a + folded + b)
        out.append((doc, own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 27, 200])
def test_merkle(spark, n):
    rows = awkward(n) if n > 1 else awkward(2)[:n]
    got = merkle.proofs(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert ordered(got) == ordered(expected_proofs(rows))


def test_merkle_over_many_ranges(spark):
    """Runs that cross ranges at several levels, with one row or none in many ranges."""
    rows = [(i, "s", "en", i, f"{i}\nx", *[None] * 4) for i in range(100)] + [(i, f"t{i // 2}", "en", i, "z", *[None] * 4) for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = merkle.proofs(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ordered(got) == ordered(expected_proofs(rows))


def test_mountains_emit_each_node_once():
    for total in (1, 2, 3, 4, 9, 10, 28, 100):
        for cut in range(0, total + 1, 5):
            stacks = []
            for a, b in ((0, cut), (cut, total)):
                s = merkle.Mountains(total, 3)
                for i in range(a, b):
                    s.push(0, i, sha(str(i)))
                s.end()
                stacks.append(s)
            keys = [(level, i) for s in stacks for level, i, _ in s.nodes]
            assert len(keys) == len(set(keys))
            if cut == total:
                assert not stacks[0].edges and len(keys) == sum(merkle.width(total, k, 3) for k in range(1, len(stacks[0].widths)))


def lloyd(rows, k=8, rounds=10, size=64):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    v = np.array([x for _, x in kept], np.int64).reshape(-1, size)
    first = sorted((i is None, sha(f"3:{i}") if i is not None else "", x) for i, x in kept)[:k]
    c = np.array([x for _, _, x in first], np.int64).reshape(-1, size)
    near = lambda: ((v[:, None, :] - c) ** 2).sum(axis=2)
    for _ in range(rounds if len(v) else 0):
        at = near().argmin(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = v[at == j].sum(axis=0) // (at == j).sum()
    if not len(v):
        return [], []
    d = near()
    return [(i, int(a), int(x[a])) for (i, _), x, a in zip(kept, d, d.argmin(axis=1))], c.tolist()


def vectors(n, copies=300):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * 0.05).astype(np.float32).tolist()) for i in range(n)]
    same = centres[0].astype(np.float32).tolist()
    rows += [(i % 50, same) for i in range(copies)]
    rows += [(None, same), (None, [0.0] * 64), (1, None), (2, [0.5] * 63), (3, [float("nan")] * 64), (4, [float("inf")] + [0.0] * 63), (5, [None] + [0.0] * 63), (6, [])]
    return rows


@pytest.mark.parametrize("n,copies", [(900, 5000), (3, 0)])
def test_clusters(spark, n, copies):
    rows = vectors(n, copies)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got, centroids = ball_tree.cluster(ball_tree.whole(df, "embedding", 64, 1024))
    want, expected = lloyd(rows)
    assert centroids == expected
    assert ordered(got.collect()) == ordered(want)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got, centroids = ball_tree.cluster(ball_tree.whole(df, "embedding", 64, 1024))
    assert got.count() == 0 and centroids == []


def test_too_large_components_fail(spark):
    df = spark.createDataFrame([(1, [3e5] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="over"):
        ball_tree.cluster(ball_tree.whole(df, "embedding", 64, 1024))[0].collect()


def test_balls_hold_their_vectors_and_prune():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-50, 50, size=(1500, 64)) + 1000 * k for k in range(3)] + [np.full((400, 64), 7)]).astype(np.int32)
    t = ball_tree.grown(v)
    for k, (a, b) in enumerate(zip(t["starts"], t["ends"])):
        rows = v[t["order"][a:b]].astype(np.float64)
        assert (np.sqrt(((rows - t["centres"][k]) ** 2).sum(axis=1)) <= t["radii"][k]).all()
        assert (rows.sum(axis=0) == t["sums"][k]).all()
    t["vectors"] = v[t["order"]]
    c = np.array([np.full(64, 1000 * k) for k in range(3)])
    whole = sum(int((t["ends"] - t["starts"])[at].sum()) for at, _, balls in ball_tree.assigned(t, c) if balls)
    assert whole == len(v)
    large = rng.integers(-ball_tree.MOST, ball_tree.MOST, size=(20, 64))
    assert (ball_tree.squared(large, large[:3]) == [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in large[:3]] for a in large]).all()


def expected_lines(rows, at_least, later_only=False):
    blank = " \t\n\v\f\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    texts = [(r[0], r[4] or "") for r in rows]
    n = Counter(k for _, t in texts for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for doc, t in texts:
        lines = t.split("\n")
        stay = [x for x in lines if not (key(x) and n[key(x)] >= at_least)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def line_rows():
    rng = random.Random(2)
    words = ["Licence", " licence\t", "LICENCE\x0b", "É", "é", "", " ", "\x1c", "foo bar", "ĞΩ", "x\r", "X"]
    rows = [(i, "s", "en", 1, "\n".join(rng.choice([*words, f"own {i} {j}"]) for j in range(rng.randint(0, 9))), *[None] * 4) for i in range(60)]
    rows += [(3, "s", "en", 1, "Once\nrepeated", *[None] * 4)] * 12 + [(None, "s", None, None, None, *[None] * 4)] * 15
    rows += [(99, "s", "en", 1, "only here\n" * 500 + "licence\n" * 300 + "end", *[None] * 4), (100, "s", "en", 1, "\n".join(f"l{i}" for i in range(5000)), *[None] * 4)]
    return rows + [(None, "s", "en", 1, f"null id {i}\nfoo bar", *[None] * 4) for i in range(20)]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("at_least", [2, 10])
def test_lines(spark, monkeypatch, hot, at_least):
    rows = line_rows()
    if hot:  # every key as one of the hot ones
        monkeypatch.setattr(line_dedup, "hot_keys", lambda lines: lines.select("_a").distinct())
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(4), at_least).collect()
    assert ordered(got) == ordered(expected_lines(rows, at_least))


@pytest.mark.parametrize("hot", [False, True])
def test_first_lines_stay(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(line_dedup, "hot_keys", lambda lines: lines.select("_a").distinct())
    rows = [(2, "s", "en", 1, "a\nb\nA", *[None] * 4), (1, "s", "en", 1, "b\nc\n b", *[None] * 4), (None, "s", "en", 1, "c", *[None] * 4)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), 1, later_only=True).collect()
    assert ordered((r.doc_id, r.kept) for r in got) == ordered([(None, "c"), (1, "b"), (2, "a")])


def test_sketch_finds_hot_lines(spark):
    lines = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("_a"))
    assert [r[0] for r in line_dedup.hot_keys(lines).collect()] == [7]


def test_lines_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("module,query", [(merkle, "op11_merkle"), (ball_tree, "op12_clusters"), (line_dedup, "op13_lines")])
def test_sql(spark, module, query):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got = getattr(module, query)(spark, DIR)
    rel = con.execute(module.ORACLE)
    assert ordered(got.select(*[c[0] for c in rel.description]).collect()) == ordered(rel.fetchall())
