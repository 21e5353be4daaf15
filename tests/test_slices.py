"""What grows with the rows: the search for a row's slice, columns that travel, joins of one stage."""

import random

from pyspark.sql import functions as F

from contract.case import Tables
from contract.text_cases import run_tables
from runlore import session
from runlore.operators import jobs, ordered
from runlore.plans.run_features import run_features
from runlore.plans.settings import Settings


def numbered(spark, n, groups):
    """Rows of some groups, those of the last one few; times repeat and are missing now and then."""
    rnd = random.Random(3)
    rows = [(f"g{i % groups}" if i % 7 else None, rnd.choice([None, *range(n // 4)]), i) for i in range(n)]
    return spark.createDataFrame([*rows, ("small", 1, n), ("small", 2, n + 1)], "k string, at bigint, id bigint").repartition(3), rows


def expected(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    seen, out = {}, {}
    for k, _, i in order:
        out[i] = seen[k] = seen.get(k, 0) + 1
    return out


def test_a_row_meets_few_of_many_cut_points(spark):
    df, rows = numbered(spark, 4000, 2)
    cuts = ordered.find_cuts(df, ["k"], ["at", "id"], 2)
    assert cuts.most > ordered.FANOUT**2
    sliced = ordered._sliced(df, cuts)
    plan = sliced._jdf.queryExecution().optimizedPlan().toString()
    # no join hands on all the cut points of a group: what rows are given are nodes
    assert "__cuts" not in plan.split("Join LeftOuter")[0]
    assert all(ordered._nodes(cuts, d).agg(F.max(F.size("__points"))).first()[0] <= ordered.FANOUT for d in range(3))
    points = {r["__k0"]: [tuple(p) for p in r["__cuts"]] for r in cuts.table.collect()}
    key = lambda at, i: (at is not None, at or 0, i)
    for r in sliced.collect():
        want = sum(key(*p) <= key(r.at, r.id) for p in points.get(r.k, []))
        assert (r["__slice"], r["__hot"]) == (want, r.k in points)


def test_many_slices_are_not_broadcast(spark, monkeypatch):
    """The tables of cut points and of slices grow with the rows; above a limit they are joined by exchanges."""
    monkeypatch.setattr(ordered, "BROADCAST_POINTS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, rows = numbered(spark, 1500, 3)
        out = ordered.running_sums(df, ["k"], ["at", "id"], {"n": F.lit(1)}, target_rows=5)
        assert {r.id: r.n for r in out.collect() if r.k != "small"} == expected(rows)
        previous = ordered.previous_row(df, ["k"], ["at", "id"], ["id"], "p", target_rows=5).filter("k = 'small'").collect()
        assert sorted((r.id, r.p and r.p.id) for r in previous) == [(1500, None), (1501, 1500)]
        # the root has one row per group and the level under it few; the leaves and the slices have many
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_job_steps_do_not_travel_unless_asked_for(spark, table):
    """What features take from the steps is taken before the exchange; rows are those of the steps themselves."""
    step = lambda name, how: {"name": name, "conclusion": how, "started_at": None, "completed_at": None}
    listed = [{"repository": "o/a", "job_id": i, "run_id": 1, "name": "j", "steps": s} for i, s in enumerate([
        [step("Set up", "success"), step("Run pytest", "failure")], [], None, [step("x", "success")],
    ])]
    known = table("jobs", listed)
    enriched = jobs.job_with_run(known, table("runs", [{"repository": "o/a", "run_id": 1, "head_branch": "main"}]))
    base = jobs.job_base(enriched, table("workflows", []))
    assert {r.job_id: r.step_count for r in base.collect()} == {0: 2, 1: 0, 2: 0, 3: 1}
    facts = spark.createDataFrame(
        [("o/a", i, None, 0, None, None, [], True) for i in range(4)],
        "repository string, job_id bigint, error_reason string, log_warn_nums bigint, operation_system string, runner_image string,"
        " actions array<struct<action:string,sha:string>>, has_text boolean",
    )
    previous = spark.createDataFrame([], "repository string, job_id bigint, prev_job_id bigint")
    dated = enriched.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    found = jobs.job_diagnostics(dated, facts, previous, table("repositories", [{"repository": "o/a", "default_branch": "main"}]))
    assert {r.job_id: r.gh_first_error_step for r in found.collect()} == {0: "test", 1: None, 2: None, 3: None}
    below = [line for line in base.drop("steps")._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[0].splitlines()]
    assert not any("steps#" in line for line in below)


def test_one_stage_joins_few_parts_of_a_run(spark):
    """Each sorted side of a join keeps memory in every task of its stage, so one plan must not hold them all."""
    data = Tables(session.configure(spark), "/root/testdata/sf0.001")
    df = run_features(run_tables(data) | {"file_metrics": data["file_metrics"]}, settings=Settings(fetch_all=False, fetch_sloc=True))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 8
    assert df.count() == data["runs"].count()
