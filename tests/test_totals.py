"""Features of new batches from stored totals against a full computation; what a batch reads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from runlore.operators import people, runs, slices
from runlore.sources import keyed
from runlore.streaming import totals

BEGIN = dt.datetime(2024, 1, 1)


def some_runs(table, pick, ids, days):
    rows = []
    for i in ids:
        at = None if pick.random() < 0.05 else BEGIN + dt.timedelta(days=days[0] + pick.random() * (days[1] - days[0]))
        actor = None if pick.random() < 0.1 else (f"u{pick.randrange(4)}", pick.randrange(4))
        rows.append(dict(repository=f"o/{pick.randrange(3)}", run_id=i, created_at=at, actor=actor, conclusion=pick.choice(["success", "failure", "failure", "cancelled", None])))
    return table("runs", rows)


def some_commits(table, pick, ids, days):
    rows = []
    for i in ids:
        at = None if pick.random() < 0.05 else BEGIN + dt.timedelta(days=days[0] + pick.random() * (days[1] - days[0]))
        name = None if pick.random() < 0.1 else f"u{pick.randrange(5)}"
        rows.append(dict(repository=f"o/{pick.randrange(3)}", sha=f"c{i}", committed_at=at, author_name=name, author_email="m", author_login=name))
    return table("commits", rows)


def shown(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_new_batches_equal_full_recomputation(spark, table, tmp_path):
    pick = random.Random(5)
    stores = totals.run_slices(str(tmp_path / "r")), totals.commit_slices(str(tmp_path / "c")), totals.committer_slices(str(tmp_path / "p"))
    # the third batch is late: it lies between the others
    seen_runs, seen_commits = None, None
    for number, days in enumerate([(0, 60), (60, 75), (30, 62)]):
        batch = some_runs(table, pick, range(number * 100, number * 100 + 60), days).cache()
        new = some_commits(table, pick, range(number * 100, number * 100 + 50), days).cache()
        for _ in range(1 + (number == 2)):  # a batch that is replayed
            totals.add_runs(batch, stores[0], "s", number)
            totals.add_commits(new, stores[1], "s", number)
            totals.add_committers(new, stores[2], 20, "s", number)
        seen_runs = batch if seen_runs is None else seen_runs.unionByName(batch)
        seen_commits = new if seen_commits is None else seen_commits.unionByName(new)
        context = runs.run_context(seen_runs, batch)
        asked = batch.select("repository", "run_id")
        want = runs.failure_history(context).join(asked, ["repository", "run_id"], "left_semi")
        assert shown(totals.failure_history_of(batch, stores[0])) == shown(want)
        assert shown(totals.experience_of(batch, stores[1])) == shown(slices.repository_experience(batch, seen_commits))
        assert shown(totals.committers_of(batch, stores[2], 20)) == shown(people.committer_counts(batch, seen_commits, 20))


def test_changed_conclusions_and_commits_that_come_late(spark, table, tmp_path):
    store, people_ = totals.run_slices(str(tmp_path / "r")), totals.committer_slices(str(tmp_path / "p"))
    at = lambda d: BEGIN + dt.timedelta(days=d)
    one = lambda i, d, c, a=1: dict(repository="o/a", run_id=i, created_at=at(d), conclusion=c, actor=("u", a))
    first = table("runs", [one(1, 0.1, "failure"), one(2, 0.2, "success", 2), one(3, 9, "success")])
    again = table("runs", [one(1, 0.1, "success", 2), one(2, 0.2, None, 2)])
    totals.add_runs(first, store, "s", 0)
    totals.add_runs(again, store, "s", 1)
    now = table("runs", [one(1, 0.1, "success", 2), one(3, 9, "success")])
    batch = now.filter("run_id = 3")
    assert shown(totals.failure_history_of(batch, store)) == shown(runs.failure_history(runs.run_context(now, batch)).filter("run_id = 3"))
    commit = lambda i, d: dict(repository="o/a", sha=f"c{i}", committed_at=at(d), author_name="n", author_email="m")
    commits = [commit(1, 0), commit(2, 50), commit(3, 10), commit(4, 49.5)]
    for number, c in enumerate(commits):
        totals.add_committers(table("commits", [c]), people_, 20, "s", number)
    probes = table("runs", [one(i, d, "success") for i, d in enumerate([0, 5, 21, 30.5, 49.6, 51, 69.9, 71])])
    assert shown(totals.committers_of(probes, people_, 20)) == shown(people.committer_counts(probes, table("commits", commits), 20))


def test_a_batch_reads_its_window_only(spark, table, tmp_path):
    store = totals.run_slices(str(tmp_path / "r"))
    day = "timestamp_micros((1704067200 + id * 600) * 1000000)"
    base = spark.range(100_000).selectExpr("concat('o/', id % 20) as repository", "id as run_id", f"{day} as created_at", "'failure' as conclusion", "named_struct('login', 'u', 'id', 1L) as actor")
    totals.add_runs(base, store)
    for part in ("events", "sums"):
        keyed.compact(spark, f"{store.path}/{part}", range_rows=2_000)
    batch = base.filter("run_id between 90000 and 90009").cache()
    totals.add_runs(batch, store)
    written = keyed.manifest(spark, f"{store.path}/events").newer_rows, keyed.manifest(spark, f"{store.path}/sums").newer_rows
    assert written == (10, 10)
    points = batch.select("repository", F.unix_micros("created_at").alias("at"))
    rows = store.around(spark, points, store.window_reach(points, 28 * 86_400_000_000))
    assert rows.count() <= 10 * (29 + 20)
    assert totals.failure_history_of(batch, store).count() == 10
