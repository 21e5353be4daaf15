"""Links and components against all pairs; the code's decoding against all directions."""

import numpy as np
import pytest

from runlore.llm import caps


def brute(ids, vectors, cosine=0.95):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, n = list(range(len(ids))), [0] * len(ids)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    linked = set()
    for dim in {len(vectors[i]) for i in good}:
        own = [i for i in good if len(vectors[i]) == dim]
        rows = caps.scaled(np.array([vectors[i] for i in own]))
        unit = rows / np.linalg.norm(rows, axis=1)[:, None]
        for p, q in zip(*np.nonzero(np.triu(unit @ unit.T >= cosine, 1))):
            a, b = own[p], own[q]
            linked.add((a, b))
            n[a] += 1
            n[b] += 1
            label[root(a)] = root(b)
    least = {}
    for i, name in enumerate(ids):
        key = root(i)
        least[key] = min([x for x in (least.get(key), name) if x is not None], default=None)
    return sorted(((i is None, i or 0), n[k], least[root(k)], i == least[root(k)]) for k, i in enumerate(ids)), len(linked)


def result(df, **more):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(df, **more).collect())


def near(pick, x, cosine):
    y = pick.normal(size=x.shape)
    y -= (x * y).sum(1)[:, None] * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1)[:, None]


def test_decoding_gives_exactly_the_exceeding_directions():
    pick = np.random.default_rng(5)
    for dim in (1, 3, 10, 48, 64):
        rows = pick.normal(size=(40, dim))
        rows /= np.linalg.norm(rows, axis=1)[:, None]
        at, ids = caps.decoded(rows, dim, 3000)
        rim, parts, words = caps._plan(dim, 3000)
        want = set()
        for code in range(caps.CODES):
            signs, lists = caps._code(dim, parts, words, code)
            turned = caps.rotated(rows, signs)
            assert np.allclose(np.linalg.norm(turned, axis=1), 1)
            total = turned[:, lists[0][0]] @ lists[0][1].T
            for place, table in lists[1:]:
                total = (total[:, :, None] + (turned[:, place] @ table.T)[:, None, :]).reshape(40, -1)
            for i, word in zip(*np.nonzero(total >= rim)):
                want.add((int(i), ((code * words**parts + int(word)) * caps.CODES + code)))
        assert {(int(a), int(b)) for a, b in zip(at, ids)} == want


@pytest.mark.parametrize("cosine,least", [(0.951, 0.98), (0.97, 0.99), (0.99, 0.999)])
def test_recall_of_pairs_just_above_the_threshold(cosine, least):
    pick = np.random.default_rng(7)
    x = pick.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = near(pick, x, cosine)
    for number in (2_000, 50_000, 2_000_000):
        sets = [{} for _ in range(2)]
        for side, rows in enumerate((x, y)):
            for a, b in zip(*caps.decoded(rows, 64, number)):
                sets[side].setdefault(int(a), set()).add(int(b))
        met = np.mean([bool(sets[0].get(i, set()) & sets[1].get(i, set())) for i in range(2000)])
        assert met >= least, (number, met)


def test_links_copies_and_chains_equal_all_pairs(spark):
    pick = np.random.default_rng(11)
    base = pick.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    chain = [base[0]]
    for _ in range(30):
        chain.append(near(pick, chain[-1][None], 0.97)[0])
    crowd = near(pick, np.repeat(base[1:2], 150, 0), 0.985)
    rows = np.concatenate([base, np.array(chain) * 3, crowd, np.repeat(base[5:6], 20, 0), base[6:7] * 1e-3])
    ids = pick.permutation(len(rows)).tolist()
    vectors = [v.astype(np.float32).tolist() for v in rows]
    want, links = brute(ids, vectors)
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>").withColumn("node", caps.F.lit("x"))
    got = result(df)
    assert abs(sum(g[1] for g in got) - 2 * links) <= 0.01 * 2 * links
    missed = sum(g != w for g, w in zip(got, want))
    assert missed <= 0.02 * len(want)
    assert result(df, tile=16) == got


def test_edge_cases(spark):
    big = [1e300, 1e300, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]),
            (7, [1.0, 0.01]), (7, [1.0, 0.01]), (8, [5e-320, 0.0]), (9, [1.0, 0.0, 0.0]), (10, big), (11, [1e-300, 1e-300, 1e-310]), (12, [3.0]), (13, [4.0]),
            (14, [-4.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 1e-5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", caps.F.lit(1))
    want, _ = brute([r[0] for r in rows], [r[1] for r in rows])
    assert result(df) == [(*w[:3], w[0][1] == w[2] if not w[0][0] else w[2] is None) for w in want]
    assert caps.near_duplicates(df.limit(0)).count() == 0
    assert [f.dataType.simpleString() for f in caps.op12(df).schema] == ["bigint", "bigint", "bigint", "boolean"]
