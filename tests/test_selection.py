"""A selection reads little, gives the rows of the whole, and times do not depend on the session's zone."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from contract.case import Tables
from contract.job_cases import job_tables
from contract.text_cases import run_tables
from runlore import session
from runlore.functions import errors
from runlore.operators import jobs
from runlore.plans import job_features as plan
from runlore.plans import pruning
from runlore.plans.extract import extract
from runlore.plans.pruning import within
from runlore.plans.run_features import needed_commits, run_features
from runlore.sources import payloads, tasks
from runlore.streaming import ingest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return Tables(session.configure(spark), SF_DIR)


def test_one_job_reads_two_logs(data):
    previous = jobs.previous_jobs(data["jobs"], data["tied_runs"])
    asked = previous.filter("prev_job_id is not null").limit(1).collect()[0]
    selected = data["jobs"].filter(F.col("job_id") == asked.job_id)
    tables = within(job_tables(data), selected)
    own = jobs.previous_jobs(tables["jobs"], tables["runs"], selected=selected)
    logs = plan.needed_logs(tables["job_logs"], selected, own)
    assert {r.job_id for r in logs.select("job_id").collect()} == {asked.job_id, asked.prev_job_id}


def test_one_run_reads_two_commits(data):
    tables = run_tables(data)
    near = needed_commits(tables, data["runs"].orderBy("run_id").limit(1))
    shas = near["java_symbols"].select("sha").union(near["file_contents"].select("sha")).distinct().count()
    assert near["commits"].count() <= 1 and shas <= 2


def test_repositories_are_filtered_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame([("o/a", 1, "x"), ("o/b", 2, "y")], "repository string, job_id long, log string").write.parquet(path)
    selected = spark.createDataFrame([("o/a", 1)], "repository string, job_id long")
    cut = within({"job_logs": spark.read.parquet(path)}, selected)["job_logs"]
    assert cut.count() == 1
    plan_text = cut._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan_text and "o/a" in plan_text.split("PushedFilters: ")[1]


def test_times_in_another_zone(spark):
    wednesday = dt.datetime(2024, 1, 3, 0, 0, 0, 5, tzinfo=dt.timezone.utc)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(wednesday, "2024-01-03T00:00:00", "2024-01-03", "2024-01-03T02:00:00+02:00")], "at timestamp, a string, b string, c string")
        day, hour = jobs.day_and_hour("at")
        times = [F.unix_micros(payloads.utc_time(F.col(c))).alias(c) for c in "abc"]
        row = df.select(day.alias("day"), hour.alias("hour"), *times).first()
        text = tasks.serialised(df.select("at")).first()["at"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.day, row.hour) == (2, 0)
    assert row.a == row.b == row.c == 1704240000000000
    assert text == "2024-01-03 00:00:00.000005+00:00"


def test_repeated_tasks_are_reported_and_resolved(spark, data):
    job = data["jobs"].filter("repository = 'org/r1'").orderBy("job_id").first()
    rows = [("org/r1", str(job.job_id), "0"), ("org/r1", str(job.job_id), "1"), ("org/r2", "9", "0"), ("org/r2", "9", "1")]
    listed = tasks.normalise_tasks(spark.createDataFrame(rows, "repository string, job_id string, collected string"), "job_id")
    with pytest.warns(UserWarning, match="1 tasks are listed more than once"):
        out = extract(listed, job_tables(data), "job", ["org/r1"])
    assert sorted((r.repository, r.collected) for r in out.collect()) == [("org/r1", 1), ("org/r1", 1), ("org/r2", 0), ("org/r2", 1)]


def test_written_tasks_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "tasks")
    rows = [("o/a", "5", "0", "first"), ("o/a", "3", "0", "x"), ("o/a", "5", "1", "second"), ("o/a", "1", "0", "y")]
    spark.createDataFrame(rows, "repository string, run_id string, collected string, note string").coalesce(1).write.option("header", True).csv(path)
    features = spark.createDataFrame([("o/a", "3", "f"), ("o/a", "0", "g")], "repository string, run_id string, found string")
    for _ in range(2):
        merged = tasks.merge_features(tasks.load_tasks(spark, path), features)
        tasks.write_tasks(session.cut_lineage(merged), path)
        again = tasks.load_tasks(spark, path)
        assert [r.run_id for r in again.orderBy(tasks.POSITION).collect()] == ["5", "3", "5", "1", "0"]
        assert tasks.resolve_tasks(again).filter("run_id = '5'").first()["note"] == "first"


def test_folded_facts_are_outranked_by_replays(spark, tmp_path):
    path = str(tmp_path / "facts")
    for number, reason in ((0, "a"), (1, "b")):
        rows = [("o/a", 1, reason)] + [("o/a", 2 + number, "z")]
        spark.createDataFrame(rows, "repository string, job_id long, error_reason string").write.parquet(f"{path}/batch={number}")
    ingest.compact_facts(spark, path)
    spark.createDataFrame([("o/a", 1, "c")], "repository string, job_id long, error_reason string").write.parquet(f"{path}/batch=1")
    ingest.compact_facts(spark, path)
    assert sorted(tuple(r) for r in ingest.load_facts(spark, path).collect()) == [("o/a", 1, "c"), ("o/a", 2, "z"), ("o/a", 3, "z")]


def _there(spark, df):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_tables_are_removed(spark):
    with session.temporary_tables(spark):
        kept = session.cut_lineage(spark.range(3))
        with session.temporary_tables(spark):
            inner = session.cut_lineage(spark.range(2))
            assert _there(spark, inner)
        gone, files = inner.inputFiles(), kept.inputFiles()
        assert kept.count() == 3
    loose = session.cut_lineage(spark.range(4))
    exists = lambda name: spark.sparkContext._jvm.java.io.File(name.replace("file://", "")).exists()
    assert not any(map(exists, [*gone, *files])) and _there(spark, loose)
    session.remove_tables(spark)
    assert not any(map(exists, loose.inputFiles()))


def test_blocks_leave_the_tables_of_other_threads(spark):
    open_, written, found = threading.Event(), threading.Event(), []

    def other():
        with session.temporary_tables(spark):
            open_.wait(60)
            table = session.cut_lineage(spark.range(5))
            written.set()
            closed.wait(60)
            found.append(table.count())

    closed = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with session.temporary_tables(spark):
        open_.set()
        assert written.wait(60)
    closed.set()
    thread.join(60)
    assert found == [5]


def test_unclosed_blocks_are_not_sought(spark):
    log = "Failed to execute goal x\n" * 20_000
    closed = "Failed to execute goal y Compilation failure cannot find symbol Re-run Maven using the -X switch to enable full debug logging"
    df = spark.createDataFrame([(log,), (closed,)], "log string")
    got = [r.error_reason for r in errors.with_error_reason(df).collect()]
    assert got[0] is None and got[1] == "compile failed due to cannot find symbol"


def test_all_missing_ids_are_at_hand(spark):
    asked = spark.createDataFrame([("o/a", str(i)) for i in range(150)], "repository string, run_id string")
    with pytest.raises(payloads.MissingIds, match="150 in all") as error:
        payloads.require_ids(asked, spark.createDataFrame([], "repository string, run_id long"))
    assert error.value.missing.count() == 150


def test_git_logs_of_several_repositories(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text(f"sha-{name}-1\n\nsha-{name}-2")
    paths = {f"o/{name}": str(tmp_path / f"{name}.txt") for name in ("a", "b")}
    got = sorted(tuple(r) for r in payloads.read_git_log(spark, paths).select("repository", "block").collect())
    assert got == [("o/a", "sha-a-1"), ("o/a", "sha-a-2"), ("o/b", "sha-b-1"), ("o/b", "sha-b-2")]


def _exchanged(df):
    """Names of the columns that pass an exchange."""
    found, queue = set(), [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        name = node.getClass().getSimpleName()
        if "Exchange" in name:
            columns = node.output()
            found |= {columns.apply(i).name() for i in range(columns.size())}
        if name == "AdaptiveSparkPlanExec":
            queue.append(node.initialPlan())
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
    return found


def test_exchanges_are_seen(spark):
    assert _exchanged(spark.range(9).selectExpr("id % 3 AS a", "id AS b").groupBy("a").agg({"b": "max"})) >= {"a"}


def test_bloom_filter_keeps_every_key_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(pruning, "BROADCAST_KEYS", 10)
    rows = spark.range(200_000).selectExpr("concat('o/', id % 100) as repository", "id as job_id", "repeat('x', 20) as log")
    keys = rows.filter("job_id % 10 = 3").selectExpr("repository", "cast(job_id as int) as job_id").union(spark.sql("select null, 5"))
    got = pruning.likely(rows, keys, ["repository", "job_id"])
    assert "log" not in _exchanged(got)
    passed = got.selectExpr("sum(int(job_id % 10 = 3)) as good", "count(*) as every").first()
    assert passed.good == 20_000 and passed.every < 22_000
    assert pruning.likely(rows.limit(0), keys, ["repository", "job_id"]).count() == 0
    unknown = spark.createDataFrame([(None, 1, "x")], rows.schema)
    assert pruning.likely(unknown, keys, ["repository", "job_id"]).count() == 0


def test_ten_million_keys_exchange_no_log(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.range(0, 20_000_000, 1000).selectExpr("'o/a' as repository", "id as job_id", "'warning' as log").write.parquet(path)
    keys = spark.range(0, 10_000_000).selectExpr("'o/a' as repository", "id as job_id")
    logs = pruning.likely(spark.read.parquet(path), keys, ["repository", "job_id"])
    facts = jobs.log_facts(logs)
    assert "log" not in _exchanged(facts)
    passed = facts.selectExpr("sum(int(job_id < 10000000)) as good", "count(*) as every").first()
    assert passed.good == 10_000 and passed.every < 10_000 * 1.1


def test_large_selections_give_the_rows_of_small_ones(data, monkeypatch):
    tables = job_tables(data)
    selected = tables["jobs"].filter("job_id % 3 = 0")
    order = lambda df: sorted(map(str, df.collect()))
    want = order(plan.job_features(tables, selected))
    runs = run_tables(data) | {"file_metrics": data["file_metrics"]}
    some = runs["runs"].filter("run_id % 7 = 0")
    settled = order(run_features(runs, some).drop("job_details"))
    monkeypatch.setattr(pruning, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(pruning, "LISTED", 1)
    assert order(plan.job_features(tables, selected)) == want
    asked = plan.job_features(tables, selected, materialise=False)
    assert not {"log", "__plain", "__text"} & _exchanged(asked)
    wide = run_features(runs, some).drop("job_details")
    assert order(wide) == settled
    assert not {"log", "content", "patch"} & _exchanged(wide)


def test_entities_are_picked_once(data, monkeypatch):
    """Extraction reads its selection many times, so what it hands on is stored and not joined again."""
    handed = []
    monkeypatch.setitem(extract.__globals__, "job_features", lambda tables, selected, settings: handed.append(selected) or plan.job_features(tables, selected, settings))
    listed = data["jobs"].select("repository", F.col("job_id").cast("string").alias("job_id"), F.lit(0).cast("bigint").alias("collected"))
    want = listed.filter("repository = 'org/r2'").count()
    out = extract(listed, job_tables(data), "job", ["org/r2"])
    assert out.filter("collected = 1").count() == want == handed[0].count()
    shown = handed[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shown and "Aggregate" not in shown


def test_a_derived_log_is_tested_once(spark):
    """A condition on a log that is derived makes the log again, so there is one; marks are found as they stand."""
    logs = spark.range(4).selectExpr("'r' as repository", "id as job_id", "CASE id WHEN 0 THEN '' WHEN 1 THEN 'x]) [warn] warn: [WARNING]' WHEN 2 THEN repeat('Deprecated', 3) END as log")
    facts = jobs.log_facts(logs)
    assert {r.job_id: r.log_warn_nums for r in facts.collect()} == {1: 3, 2: 3}
    assert facts._jdf.queryExecution().optimizedPlan().toString().split("Filter ")[1].split("\n")[0].count("CASE") <= 1
