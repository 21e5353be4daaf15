"""Targets against repeated resharing, and the properties of the rounding."""

import re

import pytest

from runlore.llm import mixing

SF_DIR = "/root/testdata/sf0.001"


def reshared(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        give, left = left, 0.0
        for s in list(open_):
            target[s] += give * weight[s] / total
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows, docs):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = reshared(sizes)
    per = {s: [r for r in rows if r["source"] == s] for s in sizes}
    for source, own in per.items():
        assert {r["source_size"] for r in own} == {sizes[source]}
        assert all(r["target"] == pytest.approx(target[source], abs=1e-6) for r in own)
        assert all(0 <= r["copies"] <= 2 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - target[source]) <= max(r["size"] for r in own)


def test_sources_reach_their_targets(spark, docs_of):
    from runlore.llm.common import table

    docs = table(spark, SF_DIR, "documents")
    units = docs.select(mixing.F.col("doc_id").alias("id"), "source", mixing.size_of(mixing.F.col("text")).alias("size"))
    rows = [r.asDict() for r in mixing.copies(units).collect()]
    check(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    again = mixing.copies(units.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, (r.asDict() for r in again)))
    out = mixing.op3(docs.withColumn("copies", docs.lang)).collect()
    assert sum(r.taken for r in out) == sum(r["copies"] * r["size"] for r in rows)


def test_expectation_is_kept_over_seeds(docs_of, monkeypatch):
    docs = [(i, "w " * (1 + i % 7), None, "b" if i % 3 else "a") for i in range(60)]
    units = docs_of(docs).select(mixing.F.col("doc_id").alias("id"), "source", mixing.size_of(mixing.F.col("text")).alias("size"))
    total = {}
    for seed in range(12):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.copies(units).collect():
            total.setdefault((r.source, r.target / r.source_size), []).append(r.copies)
    for (_, rate), seen in total.items():
        assert abs(sum(seen) / len(seen) - rate) < 0.1


def test_edge_cases(docs_of):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "x y", None, None), (3, "x y", None, None), (None, "x", None, "\U0001f388"),
            (4, "z " * 40_000, None, "￿"), (5, "one", None, "only"), (6, " \t\x0b", None, "void")]
    docs = docs_of(rows)
    got = mixing.op3(docs).collect()
    assert len(got) == len(rows)
    units = docs.select(mixing.F.col("doc_id").alias("id"), "source", mixing.size_of(mixing.F.col("text")).alias("size"))
    check([r.asDict() for r in mixing.copies(units).collect()], [(r[0], r[1], r[3]) for r in rows])
    assert mixing.op3(docs.limit(0)).count() == 0
    out = mixing.mixed(docs.withColumn("size", docs.lang))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]
    assert out.count() == len(rows) - 1
    assert {r.taken for r in out.collect() if r.doc_id in (1, 2, 6)} == {0}


def test_a_hot_source_over_several_levels(spark):
    units = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "1 + id % 50 as size")
    rows = [r.asDict() for r in mixing.copies(units).collect()]
    assert len(rows) == 20_000
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 50


def test_many_sources_are_ranked_in_ranges(spark):
    # resharing ends where nothing is above its cap, whatever the number of sources
    sizes = spark.range(100_000).selectExpr(
        "CASE WHEN id % 50000 <> 7 THEN concat('s', lpad(id % 50000, 5, '0')) END AS source", "hash(id % 50000) % 7 * 3 + 30 AS size"
    ).unionByName(spark.createDataFrame([("t", 2_000_000)], "source string, size bigint"))
    got = {r.source: r for r in mixing.targets(sizes).collect()}
    own = {s: r.source_size for s, r in got.items()}
    want = reshared(own)
    assert len(got) == 50_001 and sum(own.values()) > 2_000_000
    assert all(got[s].target == pytest.approx(want[s], rel=1e-9) for s in want)
    assert sum(r.target for r in got.values()) == pytest.approx(1.5 * sum(own.values()))
