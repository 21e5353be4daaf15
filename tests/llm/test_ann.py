"""Recall and scores of the graph search against brute force."""

import numpy as np

from runlore.llm import ann, hnsw

SF_DIR = "/root/testdata/sf0.01"


def exact(ids, vectors, every, nearest):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        gaps = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, gaps)) if i != q][:nearest]
        out[int(ids[q])] = [(int(ids[i]), gaps[i]) for i in order]
    return out


def test_graph_recall():
    pick = np.random.default_rng(3)
    points = pick.normal(size=(3000, 32)).astype(np.float32)
    points[1000:2000] = points[:1000] + pick.normal(size=(1000, 32)) * 0.01
    graph = hnsw.Graph.load(hnsw.build(points).dump())
    found = hnsw.search(graph, points[:200], 10)
    near = np.argsort(((points[:200, None] - points[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, near)]) >= 0.95
    assert len(graph.layers) > 1 and graph.layers[0][1].shape == (3000, 2 * hnsw.LINKS)


def test_recall_over_shards(spark):
    from runlore.llm.common import table

    df = table(spark, SF_DIR, "embeddings")
    rows = df.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows]), 20, 10)
    got = {}
    for r in ann.op9(df.withColumnRenamed("label", "rank"), 10, 20, 100).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, 11))
        hits += len({v for v, _ in got[q].values()} & {v for v, _ in near})
        assert [got[q][k] for k in sorted(got[q])] == sorted(got[q].values(), key=lambda x: (x[1], x[0]))
    assert hits >= 0.95 * 10 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 300)] + [(1000, [1.0, 2.5]), (2000, None), (3000, [0.0, 0.0]), (4000, [float("nan"), 1.0])]
    rows += [(5000, [float("inf"), 1.0]), (6000, [None, 1.0]), (None, [1.0, 2.0]), (7000, [1.0, 2.0, 3.0]), (8000, []), (1000, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.op9(df, 10, 100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {0, 100, 200, 1000}
    assert sorted(got[0]) == [(k, k, 0.0) for k in range(1, 11)]
    assert sorted(got[200]) == [(k + 1, k, 0.0) for k in range(10)]
    assert sorted(got[1000]) == [(k + 1, k, 0.5) for k in range(10)]
    few = df.filter("vec_id in (0, 1, 2)")
    assert ann.op9(few, 10, 1).count() == 6
    assert ann.op9(df.limit(0)).count() == 0


def test_doubles_keep_their_precision_and_range(spark):
    pick = np.random.default_rng(8)
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0 + 1e-10]), (2, [1.0, 1.0 + 1e-11]), (3, [1e300, -1e300]), (4, [1.0, 1.5]), (5, [1e-300, 0.0]), (6, [2e-300, 0.0]),
            (100, [1e308, 1e308]), (7, [-1e308, -1e308]), (200, [3e-300, 0.0])]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(pick.normal(size=(40, 2)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", ann.F.lit(1))
    got = {}
    for r in ann.op9(df, 60, 100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 1000}
    for q, found in got.items():
        own = dict(rows)[q]
        want = sorted((float(ann.distances(np.array([v]), np.array(own))[0]), i) for i, v in rows if i != q)
        assert [(s, i) for _, i, s in sorted(found)] == want
    first = sorted(got[0])[:2]
    assert [i for _, i, _ in first] == [2, 1] and 0 < first[0][2] < first[1][2] < 2e-10
    assert sorted(got[200])[0][1] == 6 and 0 < sorted(got[200])[0][2] < 1.1e-300
