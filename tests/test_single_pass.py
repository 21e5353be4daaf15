"""Rows that are put in order are put in order once, and groups are split by their own size."""

import re
from datetime import datetime, timedelta

from contract import CASES, source_cases
from contract.case import Tables
from runlore.operators import changes, commits, ordered, repositories, slices

START = datetime(2024, 1, 1)


def run_rows(n):
    """Runs of one repository, some twice on a commit; commit c<i> touches file f<i div 8> and one of its own, some of them twice."""
    rows = [
        {
            "repository": "o/a", "run_id": i, "head_sha": f"c{i // 2}", "head_branch": "main",
            "conclusion": "failure" if i % 2 else "success", "created_at": START + timedelta(hours=i),
        }
        for i in range(n)
    ]
    files = [{"repository": "o/a", "sha": f"c{i}", "filename": f} for i in range(n // 2) for f in (f"f{i // 8}", f"own{i}")]
    files += [{"repository": "o/a", "sha": f"c{i}", "filename": f} for i in range(0, n // 2, 3) for f in (f"f{i // 8}", "", None)]
    return rows, files


def test_previous_runs_are_found_once(spark, table):
    rows, files = run_rows(48)
    known = table("commits", [{"repository": "o/a", "sha": f"c{i}"} for i in range(24)])
    out = commits.same_files_as_previous(table("runs", rows), known, table("commit_files", files), target_rows=5)
    # the pairs and the result both need the previous run, which is taken from storage
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.run_id: r.prev_build_same_files_touched for r in out.collect()}
    assert got == {i: None if i == 0 else (i // 2) // 8 == ((i - 1) // 2) // 8 for i in range(48)}


def test_the_exchange_of_slices_serves_the_carry_rows(spark, table):
    rows, _ = run_rows(60)
    narrow = table("runs", rows).select("repository", "run_id", "head_sha", "created_at")
    out = ordered.previous_row(narrow, ["repository"], ["created_at", "run_id"], ["head_sha"], "p", target_rows=5)
    assert {r.run_id: r.p and r.p.head_sha for r in out.collect()} == {i: f"c{(i - 1) // 2}" if i else None for i in range(60)}
    # rows of other groups are not left out before the exchange, which would make it another one
    sides = out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1:]
    assert [re.search(r"Join (\w+)", s).group(1) for s in sides] == ["LeftOuter", "LeftOuter"]


def hot_by_hand(rows, files, days=30):
    touched = {}
    for f in files:
        touched.setdefault(f["sha"], []).append(f["filename"])
    events = [(r["created_at"], f, r["conclusion"] == "failure") for r in rows for f in touched[r["head_sha"]] if f]
    out = set()
    for r in rows:
        for f in set(touched[r["head_sha"]]):
            near = [bad for at, g, bad in events if g == f and r["created_at"] - timedelta(days=days) <= at <= r["created_at"]]
            if len(near) >= 5 and sum(near) * 100 / len(near) >= 20:
                out.add(r["run_id"])
    return out


def test_a_hot_repository_with_small_files_is_not_split(spark, table, monkeypatch):
    rows, files = run_rows(200)
    runs, commit_files = table("runs", rows), table("commit_files", files)
    own = runs.select("repository", "run_id", runs.head_sha.alias("sha"))
    given, sums = [], slices.asof_sums
    monkeypatch.setattr(slices, "asof_sums", lambda *a, **k: given.append(k["cuts"]) or sums(*a, **k))
    # the repository has 200 runs, a file at most 24 touches and 2 * 16 points at which they are read
    out = slices.hotspot_touched(runs, runs, own, commit_files, target_rows=100)
    assert given == [ordered.NO_CUTS]
    want = hot_by_hand(rows, files)
    assert want and {r.run_id for r in out.collect()} == want
    split = slices.hotspot_touched(runs, runs, own, commit_files, target_rows=20)
    assert given[1] is None and {r.run_id for r in split.collect()} == want


def test_manifests_are_counted_once(spark, table):
    commits_ = table("commits", [{"repository": "o/a", "sha": f"c{i}", "parent_sha": f"c{i - 1}" if i else None} for i in range(4)])
    contents = [{"repository": "o/a", "sha": f"c{i}", "path": "pom.xml", "content": "<dependency>" * n} for i, n in enumerate((1, 1, 3, 2))]
    out = changes.dependency_changes(commits_, repositories.manifest_counts(table("file_contents", contents)))
    # the counts are stored: no text is read for either side of a pair
    assert "content" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.sha: (r.gh_dependencies_churn, r.dependencies_count) for r in out.collect()} == {"c1": (0, 1), "c2": (1, 3), "c3": (1, 2)}


def test_runs_arrive_in_as_many_files_as_they_are_read_in(spark, table, monkeypatch, tmp_path):
    rows, _ = run_rows(40)
    runs = table("runs", [r | {"event": "push" if r["run_id"] % 4 else "other"} for r in rows]).repartition(4, "run_id")
    monkeypatch.setattr(source_cases, "_folder", lambda t, name: str(tmp_path / name))
    out = CASES["f1_streamed_history"].build(Tables(spark, "", {"runs": runs}))
    # two batches; one file each would be written and read by one task
    assert len(list((tmp_path / "runs").glob("*.parquet"))) > 2
    want = {r["run_id"]: r["conclusion"] + ("!" if r["run_id"] % 4 else "") for r in rows}
    assert {r.run_id: r.conclusion for r in out.collect()} == want
