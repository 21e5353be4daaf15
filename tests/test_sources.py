"""Task table, history store, payloads, git logs and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runlore.schemas import TABLES
from runlore.sources import history, keyed, payloads, tasks
from runlore.streaming import ingest


def csv(tmp_path, text, name="tasks.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


KEY = ("repository", "run_id", "collected")


def test_load(spark, tmp_path):
    path = csv(tmp_path, '﻿repository,run_id,collected,note\n o/a , #1 ,,"x, ""y"""\no/a,2, 1 ,\n')
    got = tasks.load_tasks(spark, path)
    assert rows(got, *KEY) == [("o/a", "#1", 0), ("o/a", "2", 1)]
    assert got.filter("run_id = '#1'").first().note == 'x, "y"'
    empty = tasks.load_tasks(spark, str(tmp_path / "absent.csv"), "job_id")
    assert empty.drop(tasks.POSITION).columns == ["repository", "job_id", "collected"] and empty.count() == 0


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("repository,run_id\no/a,1\n", "missing: collected"),
        ("repository,run_id,collected\no/a,1,x\n", "Invalid collected value"),
        ("repository,run_id,collected\no/a, ,0\n", "are required"),
        ("repository,run_id,collected\n,1,0\n", "are required"),
    ],
)
def test_bad_tables_are_refused(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        tasks.load_tasks(spark, csv(tmp_path, text)).collect()


def listed(spark, *entries):
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], f"repository string, run_id string, collected string, {tasks.POSITION} int")
    return tasks.normalise_tasks(df)


def test_duplicates_and_selection(spark):
    t = listed(spark, ("o/a", "1", "0"), ("o/a", "1", "1"), ("o/a", "2", ""), ("o/b", "3", "0"), ("o/a", "4", "1"), ("o/a", "5", "2"))
    assert rows(tasks.resolve_tasks(t), *KEY) == [("o/a", "1", 1), ("o/a", "2", 0), ("o/a", "4", 1), ("o/a", "5", 1), ("o/b", "3", 0)]
    assert rows(tasks.pending_tasks(t, ["o/a"]), *KEY) == [("o/a", "2", 0)]
    assert rows(tasks.pending_tasks(t, ["o/a"], overwrite=True), *KEY) == [("o/a", "1", 0), ("o/a", "2", 0), ("o/a", "4", 1), ("o/a", "5", 0)]
    assert rows(tasks.duplicate_tasks(t), "run_id", "row_count") == [("1", 2)]
    table, chosen = tasks.explicit_tasks(t, ["o/a"], [" 9 ", "1", "2"])
    assert rows(chosen, *KEY) == [("o/a", "2", 0), ("o/a", "9", 0)] and table.count() == 7
    with pytest.raises(ValueError, match="exactly one"):
        tasks.explicit_tasks(t, ["o/a", "o/b"], ["1"])


def test_modes():
    assert (tasks.check_mode("run", ["1"]), tasks.check_mode("job", None, ["1"])) == ("run_id", "job_id")
    for bad in [("run", None, ["1"]), ("job", ["1"], None), ("x", None, None)]:
        with pytest.raises(ValueError):
            tasks.check_mode(*bad)


def test_pending_entities(spark):
    t = listed(spark, ("o/a", "1", "1"), ("o/a", "2", "0"))
    runs = spark.createDataFrame([("o/a", i) for i in (1, 2, 3)], "repository string, run_id bigint")
    assert rows(tasks.pending_entities(runs, t), "run_id") == [(2,), (3,)]
    assert tasks.pending_entities(runs, t, overwrite=True).count() == 3


def test_merge_updates_every_duplicate_and_is_idempotent(spark):
    t = listed(spark, ("o/a", "1", "0"), ("o/a", "1", "1"), ("o/a", "2", "0")).drop(tasks.POSITION).withColumn("old", F.lit("keep"))
    new = spark.createDataFrame([("o/a", 1, "x"), ("o/a", 7, "y")], "repository string, run_id bigint, x string")
    once = tasks.merge_features(t, new)
    assert once.columns == ["repository", "run_id", "collected", "old", "x"]
    want = [("o/a", "1", 1, "keep", "x")] * 2 + [("o/a", "2", 0, "keep", ""), ("o/a", "7", 1, "", "y")]
    for merged in (once, tasks.merge_features(once, new)):
        assert rows(tasks.serialised(merged).select("repository", "run_id", F.col("collected").cast("int").alias("collected"), "old", "x"), *once.columns) == want


def test_cells_read_like_python(spark):
    moment = datetime(2024, 1, 2, 3, 4, 5, 60)
    numbers = [0.5, 12345678.0, 0.0005, 1e16, 1.5e-5, 1e22, -2.5e7, 0.0, 123456789012345.6]
    df = spark.createDataFrame([(n, True, moment, ["é", None], None) for n in numbers], "n double, b boolean, t timestamp, l array<string>, e string")
    got = tasks.serialised(df).collect()
    assert [r.n for r in got] == [str(n) for n in numbers]
    assert tuple(got[0])[1:] == ("True", "2024-01-02 03:04:05.000060+00:00", '["é",null]', "")


def test_written_table_replaces_the_old_one(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 1):
        tasks.write_tasks(listed(spark, *[("o/a", str(i), "0") for i in range(n)]), path)
    assert rows(tasks.load_tasks(spark, path), *KEY) == [("o/a", "0", 0)]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def run(i, at, repository="o/a", **more):
    return dict(repository=repository, run_id=i, created_at=datetime.fromisoformat(at) if at else None, **more)


def test_history_merge_and_store(spark, table, tmp_path):
    old = table("runs", [run(1, "2024-01-01", conclusion="a"), run(2, "2024-01-02", conclusion="a"), run(9, "2024-01-02", "o/z", conclusion="a")])
    new = table("runs", [run(2, "2024-01-02", conclusion="b"), run(3, "2024-01-03", conclusion="b")])
    merged = history.newest_first(history.merge_history(old, new)).collect()
    assert [(r.run_id, r.conclusion) for r in merged] == [(3, "b"), (2, "b"), (1, "a"), (9, "a")]
    path = str(tmp_path / "history")
    history.save_history(old, path)
    for _ in range(2):  # the same update again changes nothing
        history.update_history(spark, path, new)
        assert rows(history.load_history(spark, path), "run_id", "conclusion") == [(1, "a"), (2, "b"), (3, "b"), (9, "a")]


def test_gaps(table):
    stored = table("runs", [run(1, "2024-01-10"), run(2, "2024-01-12")])
    selected = table("runs", [run(3, "2024-01-11"), run(4, "2024-01-13"), run(5, "2024-01-01", "o/b")])
    got = {(r.repository, r.gap): (str(r.gap_start)[:10], str(r.gap_end)[:10]) for r in history.run_gaps(selected, stored, 1).collect()}
    assert got == {("o/a", "earlier"): ("2024-01-04", "2024-01-10"), ("o/a", "later"): ("2024-01-12", "2024-01-13"), ("o/b", "all"): ("2023-12-25", "2024-01-01")}


def test_payloads(spark):
    text = '{"id": 5, "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T02:00:00+02:00", "actor": null, "head_commit": {"timestamp": "2024-01-01T00:00:00"}}'
    df = spark.createDataFrame([("o/a", text)], "repository string, payload string")
    r = payloads.runs_from_payload(df).first()
    assert (r.run_id, r.created_at, r.updated_at, r.actor_login) == (5, datetime(2024, 1, 1), datetime(2024, 1, 1), None)
    assert r.head_commit.timestamp == datetime(2024, 1, 1)
    wanted = spark.createDataFrame([("o/a", "5"), ("o/a", "8"), ("o/a", "7")], "repository string, run_id string")
    with pytest.raises(ValueError, match="o/a: 7, o/a: 8$"):
        payloads.require_ids(wanted, payloads.runs_from_payload(df))
    payloads.require_ids(wanted.limit(1), payloads.runs_from_payload(df))


def test_git_log(spark, tmp_path):
    s = "\x1f"
    text = f"a1{s}N{s}e{s}2024-01-02{s}msg{s}x{s}HEAD\nM\tf.py\nR100\told\tnew\n\nb2{s}N{s}e{s}2024-01-03{s}m{s}\n\nlost{s}{s}{s}{s}{s}\nc3{s}N{s}e{s}2024-01-03{s}m{s}\nD\tg\n"
    path = csv(tmp_path, text, "log.txt")
    log = payloads.parse_git_log(payloads.read_git_log(spark, path, "o/a"))
    assert rows(payloads.logged_commits(log), "sha", "message") == [("a1", f"msg{s}x"), ("b2", "m"), ("c3", "m")]
    assert rows(payloads.logged_files(log), "sha", "status", "filename") == [("a1", "M", "f.py"), ("a1", "R100", "old"), ("c3", "D", "g")]


def test_streams_are_incremental(spark, table, tmp_path):
    logs, facts, progress = (str(tmp_path / n) for n in ("logs", "facts", "progress"))
    for i, text in enumerate(["Warning: a", "deprecated warning: b"]):
        table("job_logs", [dict(repository="o/a", job_id=i, log=text)]).coalesce(1).write.mode("append").parquet(logs)
        ingest.start_log_facts(ingest.stream_table(spark, logs, TABLES["job_logs"]), facts, progress).awaitTermination()
        assert rows(ingest.load_facts(spark, facts), "job_id", "log_warn_nums") == [(0, 1), (1, 2)][: i + 1]


def test_streamed_history_tells_what_changed(spark, table, tmp_path):
    source, store, progress = (str(tmp_path / n) for n in ("runs", "history", "progress"))
    seen = []
    for i, name in enumerate(["o/a", "o/b"]):
        table("runs", [run(i, "2024-01-01", name)]).coalesce(1).write.mode("append").parquet(source)
        ingest.start_run_history(
            ingest.stream_table(spark, source, TABLES["runs"]), store, progress,
            after=lambda touched, n: seen.append([r.repository for r in touched.collect()]),
        ).awaitTermination()
    assert seen == [["o/a"], ["o/b"]] and keyed.read(spark, store).count() == 2
