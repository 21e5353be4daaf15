"""Ordered operators against brute force, whole and split, over several layouts of the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from runlore.operators import ordered

SPLITS = [None, 7]  # no group is hot / every larger group is split


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    # one key holds most rows; times repeat and are missing now and then
    return [
        (rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(12)]), i, rnd.randint(-3, 5))
        for i in range(160)
    ]


def frame(spark, rows, parts=3):
    data = rows[:]
    random.Random(parts).shuffle(data)
    return spark.createDataFrame(data, "k string, at bigint, id bigint, v bigint").repartition(parts)


def order(row):
    return (row[1] is not None, row[1] or 0, row[2])


@pytest.mark.parametrize("target", SPLITS)
@pytest.mark.parametrize("parts", [1, 5])
def test_running_sums(spark, rows, target, parts):
    got = ordered.running_sums(
        frame(spark, rows, parts), ["k"], ["at", "id"], {"total": F.col("v"), "n": F.lit(1)}, target_rows=target
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [x for x in rows if x[0] == r.k and order(x) <= order((r.k, r.at, r.id))]
        assert (r.total, r.n) == (sum(x[3] for x in before), len(before))


@pytest.mark.parametrize("target", SPLITS)
@pytest.mark.parametrize("parts", [1, 5])
def test_previous_row(spark, rows, target, parts):
    got = ordered.previous_row(
        frame(spark, rows, parts), ["k"], ["at", "id"], ["id", "v"], "p", target_rows=target
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        before = sorted((x for x in rows if x[0] == r.k and order(x) < order((r.k, r.at, r.id))), key=order)
        assert (tuple(r.p) if r.p else None) == ((before[-1][2], before[-1][3]) if before else None)


@pytest.mark.parametrize("target", SPLITS)
def test_trailing_sums(spark, rows, target):
    got = ordered.trailing_sums(
        frame(spark, rows), {"n": F.lit(1), "v": F.col("v")}, {"w": 3}, levels={"g": ["k"]}, ids=["id"], at="at",
        whole="all", target_rows=target,
    ).collect()
    by_id = {x[2]: x for x in rows}
    assert sorted(r.id for r in got) == sorted(x[2] for x in rows if x[1] is not None)
    for r in got:
        k, at = by_id[r.id][:2]
        window = [x for x in rows if x[0] == k and x[1] is not None and at - 3 <= x[1] <= at]
        assert (r.w_g_n, r.w_g_v) == (len(window), sum(x[3] for x in window))
        assert r.all_g_n == sum(x[0] == k for x in rows)


@pytest.mark.parametrize("target", SPLITS)
def test_asof_sums_open_and_closed(spark, rows, target):
    events = frame(spark, [x for x in rows if x[1] is not None])
    probes = spark.createDataFrame([("a", 4, 1), ("b", 0, 2), ("zz", 5, 3), (None, 20, 4)], "k string, t bigint, p bigint")
    got = ordered.asof_sums(
        events, {"n": F.lit(1)}, probes, {"upto": (F.col("t"), True), "before": (F.col("t"), False)},
        levels={"g": ["k"]}, ids=["p"], at="at", target_rows=target,
    ).collect()
    want = {}
    for p in probes.collect():
        times = [x[1] for x in rows if x[0] == p.k and x[1] is not None]
        want[p.p] = (sum(t <= p.t for t in times), sum(t < p.t for t in times))
    assert {r.p: (r.upto_g_n, r.before_g_n) for r in got} == want


def test_cuts_follow_the_size_of_hot_groups_only(spark, rows):
    df = frame(spark, rows)
    assert not ordered.find_cuts(df, ["k"], ["at", "id"]).any
    cuts = ordered.find_cuts(df, ["k"], ["at", "id"], 40)
    hot = [r["__k0"] for r in cuts.table.collect()]
    assert hot == ["a"]
    many = spark.range(3000).selectExpr("'a' as k", "id % 50 as at", "id")
    cuts = ordered.find_cuts(many, ["k"], ["at", "id"], 10)
    assert 150 < len(cuts.table.first()["__cuts"]) < 300
    out = ordered.running_sums(many, ["k"], ["at", "id"], {"n": F.lit(1)}, cuts=cuts)
    ranked = sorted(out.collect(), key=lambda r: (r.at, r.id))
    assert [r.n for r in ranked] == list(range(1, 3001))
    assert ordered.has_hot_group(df, ["k"], 40) and not ordered.has_hot_group(df, ["k"], 1000)


def test_split_groups_are_exchanged_by_slice(spark, rows):
    """Rows that already lie by the group must not keep all slices in one task."""
    df = frame(spark, rows).repartition(4, "k")
    out = ordered.running_sums(df, ["k"], ["at", "id"], {"n": F.lit(1)}, target_rows=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "__slice" in plan.split("hashpartitioning(")[-1] or "__slice" in plan


def test_facts_of_hot_keys_are_joined_once_per_row(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "TARGET_ROWS", 7)
    df = frame(spark, rows)
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, f int")
    for how in ("inner", "left"):
        plain = sorted(map(str, df.join(facts, ["k"], how).collect()))
        assert sorted(map(str, ordered.join_facts(df, facts, ["k"], "id", True, how).collect())) == plain


def test_previous_row_with_a_condition(spark, rows):
    for target in SPLITS:
        got = ordered.previous_row(
            frame(spark, rows), ["k"], ["at", "id"], ["id"], "p", where=F.col("v") > 3, target_rows=target
        ).collect()
        assert len(got) == len(rows)
        for r in got:
            before = [x for x in rows if x[0] == r.k and order(x) < order((r.k, r.at, r.id)) and x[3] > 3]
            assert (r.p.id if r.p else None) == (max(before, key=order)[2] if before else None)
