"""Hard negatives against all scores."""

import math

import numpy as np

from runlore.llm import negatives

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, every=50):
    ok = {
        (i, lab, tuple(math.floor(256 * x) for x in v))
        for i, lab, v in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a in ok:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1] == a[1]) for b in ok if b[0] != a[0] and len(b[2]) == len(a[2])]
        for back, p, _ in sorted(s for s in scored if s[2])[:5]:
            hard = sorted(s for s in scored if not s[2] and -50 * back <= -100 * s[0] <= -95 * back)[:3]
            out += [(a[0], p, k + 1, n[1], -back, -n[0]) for k, n in enumerate(hard)]
    return sorted(out)


def result(df, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **more).collect())


def test_clusters_equal_brute_force_whatever_the_blocks(spark):
    pick = np.random.default_rng(2)
    heads = pick.normal(size=(12, 16))
    at = pick.integers(0, 12, 1500)
    vectors = (heads[at] + pick.normal(size=(1500, 16)) * 0.3) * pick.uniform(0.5, 2, (1500, 1))
    labels = ((at + (pick.random(1500) < 0.3) * pick.integers(0, 3, 1500)) % 5).tolist()
    rows = [(i, lab, v.astype(np.float32).astype(float).tolist()) for i, lab, v in zip(pick.permutation(1500).tolist(), labels, vectors)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", negatives.F.lit(1))
    want = brute(rows, 20)
    assert len(want) > 500
    assert result(df, every=20, size=64) == want
    assert result(df.repartition(7), every=20) == want


def test_bounds_hold_and_rule_out():
    pick = np.random.default_rng(4)
    heads = pick.normal(size=(6, 32)) * 100
    rows = np.floor(np.repeat(heads, 200, 0) + pick.normal(size=(1200, 32)) * 5).astype(np.int32)
    rows[7] = 0
    units = rows[::150][:8] / np.linalg.norm(rows[::150][:8].astype(float), axis=1)[:, None]
    norms, angles = negatives._angles(rows, units)
    low, high = negatives.interval(angles, angles, norms, norms)
    exact = negatives.scores(rows, rows)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < 0.5 * norms[:, None] * norms).mean() > 0.4


def test_large_values_are_exact():
    big = np.array([[2**27 - 1, 1], [-(2**27) + 1, 3]], np.int32)
    assert negatives.scores(big, big).tolist() == [[(2**27 - 1) ** 2 + 1, 3 - (2**27 - 1) ** 2], [3 - (2**27 - 1) ** 2, (2**27 - 1) ** 2 + 9]]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]), (3, 2, [0.75, 0.0]), (4, 2, [0.75, 0.0]), (5, 2, [0.75, 0.0]),
            (6, 2, [0.75, 0.0]), (7, None, [0.7, 0.0]), (8, 2, None), (9, 2, [0.7, None]), (10, 2, [nan, 0.7]), (11, 2, [inf, 0.0]), (None, 2, [0.7, 0.0]),
            (12, 2, [0.7, 0.0, 0.0]), (50, 3, [0.0, 0.0]), (51, 3, [1.0, 1.0]), (100, 4, [-1.0, 0.0]), (101, 4, [1.0, 0.0]), (150, 9, [0.0, 1.0]),
            (200, 5, []), (201, 5, []), (202, 6, []), (250, 7, [1.0, 1.0, 1.0]), (50, 3, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute(rows)
    assert result(df) == want and {w[0] for w in want} >= {0, 50, 200}
    assert result(df.withColumn("embedding", negatives.F.col("embedding").cast("array<float>"))) == want
    assert result(df.limit(0)) == []
    huge = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [1.0]), (2, 2, [0.7]), (50, 1, [1.0])], df.schema)
    assert result(huge) == [(50, 1, 1, 2, 65536, 256 * 179)]
