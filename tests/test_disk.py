"""What a query leaves on the disk while it runs: exchanges of finished parts, and columns that need not travel."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlore import session
from runlore.operators import changes, jobs, linediff, ordered, repositories
from runlore.plans.job_features import job_features
from runlore.plans.settings import Settings
from tests.test_selection import _exchanged

START = datetime(2024, 1, 1)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_the_shuffle_files_of_a_part_go_when_it_is_stored(spark):
    session.configure(spark)
    before = shuffle_files(spark)
    stored = session.cut_lineage(spark.range(100_000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count())
    wait = time.time() + 20
    while shuffle_files(spark) - before and time.time() < wait:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert stored.count() == 1000


def test_tables_on_the_way_go_when_the_result_is_stored(spark):
    here = lambda path: os.path.exists(path.removeprefix("file:"))
    written = []
    with session.temporary_tables(spark):
        def make():
            first = session.cut_lineage(spark.range(5))
            written.extend(first.inputFiles())
            return first.selectExpr("id + 1 AS n")

        result = session.settled(spark, make)
        assert written and not any(here(w.removeprefix("file://")) for w in written)
        assert sorted(r.n for r in result.collect()) == [1, 2, 3, 4, 5]
        kept = result.inputFiles()
    assert not any(here(k.removeprefix("file://")) for k in kept)


def test_few_facts_go_to_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TARGET_ROWS", 7)
    rows = spark.range(60).selectExpr("if(id % 9 = 0, null, 'a' || id % 4) AS k", "id")
    facts = spark.createDataFrame([("a0", 1), ("a1", 2), ("a1", 3), ("a9", 4), (None, 5)], "k string, f int")
    for how in ("inner", "left"):
        plain = sorted(map(str, rows.join(facts, ["k"], how).collect()))
        few = ordered.join_few(rows, facts, ["k"], "id", True, how)
        assert "id" not in _exchanged(few) and sorted(map(str, few.collect())) == plain
        monkeypatch.setattr(ordered, "BROADCAST_FACTS", 0)
        assert sorted(map(str, ordered.join_few(rows, facts, ["k"], "id", True, how).collect())) == plain
        monkeypatch.undo()


@pytest.fixture
def tables(table):
    """Twelve jobs in six runs of two workflows; each log names an action, some have another image."""
    logs = "2024-03-01T10:00:00.1234567Z ##[group]Runner Image\nVersion: {}\nDownload action repository 'a/b@v1' (SHA:{})\n"
    runs = [
        {"repository": "o/a", "run_id": r, "workflow_id": r % 2, "conclusion": "success", "created_at": START + timedelta(days=r)}
        for r in range(6)
    ]
    listed = [{"repository": "o/a", "job_id": 10 * r + n, "run_id": r, "name": f"n{n}", "created_at": START, "started_at": START} for r in range(6) for n in (0, 1)]
    texts = [{"repository": "o/a", "job_id": j["job_id"], "log": logs.format(j["run_id"] // 4, j["run_id"] // 3)} for j in listed]
    return {
        "runs": table("runs", runs), "jobs": table("jobs", listed), "job_logs": table("job_logs", texts),
        "workflows": table("workflows", [{"repository": "o/a", "id": 1, "name": "one", "list_pos": 0}]),
        "repositories": table("repositories", [{"repository": "o/a", "default_branch": "main", "has_organization": True}]),
    }


def compared(rows):
    return {r.job_id: (r.is_runner_changed, r.is_action_changed) for r in rows}


# the run before one of the same workflow is two numbers lower
WANT = {10 * r + n: (None, None) if r < 2 else (r // 4 != (r - 2) // 4, r // 3 != (r - 2) // 3) for r in range(6) for n in (0, 1)}


def test_job_features_are_joined_from_stored_parts(tables):
    out = job_features(tables)
    # what was found about previous jobs and actions is stored, and its exchanges are gone
    assert not {"actions", "prev_actions", "prev_job_id"} & _exchanged(out)
    rows = out.collect()
    assert compared(rows) == WANT
    assert {r.job_id: r.workflow_name for r in rows} == {j: "one" if j // 10 % 2 else None for j in WANT}
    assert all(r.use_unverified_action and r.is_master is False for r in rows)


def test_split_job_features_are_joined_from_stored_parts(tables, monkeypatch):
    monkeypatch.setattr(ordered, "TARGET_ROWS", 3)
    out = job_features(tables, settings=Settings(target_rows=3))
    # the columns of workflows come to the rows, which are not dealt out by salts
    assert not {"__salt", "actions", "prev_actions"} & _exchanged(out)
    assert compared(out.collect()) == WANT



def test_diagnostics_store_their_parts(tables):
    """The exchanges of the comparison and of the flags are gone before the parts are joined."""
    facts = jobs.log_facts(tables["job_logs"])
    enriched = jobs.job_with_run(tables["jobs"], tables["runs"])
    out = jobs.job_diagnostics(enriched, facts, jobs.previous_jobs(tables["jobs"], tables["runs"]), tables["repositories"])
    assert not {"actions", "prev_actions", "prev_job_id"} & _exchanged(out)
    assert compared(out.collect()) == WANT



def test_previous_jobs_are_stored_before_facts_are_compared(tables):
    facts = session.cut_lineage(jobs.log_facts(tables["job_logs"]))
    out = jobs.changes_since_previous(facts, jobs.previous_jobs(tables["jobs"], tables["runs"]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert compared(out.collect()) == WANT



def test_changes_of_a_commit_are_joined_from_stored_parts(table):
    known = table("commits", [{"repository": "o/a", "sha": f"c{i}", "parent_sha": f"c{i - 1}" if i else None} for i in range(3)])
    files = table("commit_files", [{"repository": "o/a", "sha": f"c{i}", "filename": "A.java", "status": "M", "patch": "+x\n" * i} for i in range(3)])
    symbols = table("java_symbols", [{"repository": "o/a", "sha": f"c{i}", "path": "A.java", "kind": "class", "name": f"C{n}", "position": n} for i in range(3) for n in range(i + 1)])
    contents = table("file_contents", [{"repository": "o/a", "sha": f"c{i}", "path": "pom.xml", "content": "<dependency>" * (i + 1)} for i in range(3)])
    out = changes.commit_change_features(known, files, symbols, repositories.manifest_counts(contents))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "patch" not in plan
    got = {r.sha: (r.gh_lines_added, r.ast_class_added, r.gh_dependencies_churn) for r in out.collect()}
    assert got == {"c1": (1, 1, 1), "c2": (2, 1, 1)}



def test_lines_of_both_sides_are_made_once(table, monkeypatch):
    known = table("commits", [{"repository": "o/a", "sha": f"c{i}", "parent_sha": f"c{i - 1}" if i else None} for i in range(3)])
    contents = table("file_contents", [{"repository": "o/a", "sha": f"c{i}", "path": "a", "content": "".join(f"{n}\n" for n in range(i, 4))} for i in range(3)])
    stored, cut = [], linediff.cut_lineage
    monkeypatch.setattr(linediff, "cut_lineage", lambda df: stored.append(df) or cut(df))
    out = linediff.content_changes(known, contents)
    # the texts are read for the two tables of versions only; what compares them reads their stored lines
    assert "content" in stored[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.sha: (r.status, r.added, r.deleted) for r in out.collect()} == {"c1": ("M", 0, 1), "c2": ("M", 0, 1)}



def test_ids_that_are_keys_travel_once(spark):
    events = spark.createDataFrame([("a", "x", 1), ("a", "x", 5), (None, "x", 2)], "k string, f string, at long")
    probes = spark.createDataFrame([("a", "x", 1, 4), ("a", "x", 2, 9), (None, "x", 3, 9), ("b", "x", 4, 9)], "k string, f string, id long, until long")
    for target in (100, 1):
        out = ordered.asof_sums(
            events, {"n": F.lit(1)}, probes, {"hi": (F.col("until"), True)},
            levels={"all": ["k", "f"]}, ids=["k", "id", "f"], at="at", target_rows=target,
        )
        assert not {"__id_k", "__id_f"} & _exchanged(out)
        assert sorted(map(str, out.collect())) == sorted(
            f"Row(k={k!r}, id={i}, f='x', hi_all_n={n})" for k, i, n in (("a", 1, 1), ("a", 2, 2), (None, 3, 1), ("b", 4, 0))
        )
