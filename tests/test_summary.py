"""The jobs of a run, and times of payloads."""

import datetime as dt

from pyspark.sql import functions as F

from runlore.operators.runs import job_summary
from runlore.sources.payloads import utc_time

AT = dt.datetime(2024, 1, 5, 10, 0, 0)


def _rows(table):
    step = ("Run tests", "success", AT, None)
    jobs = table("jobs", [
        {"repository": "a", "run_id": 1, "job_id": 2, "name": "lint", "started_at": AT, "conclusion": "failure", "steps": [step]},
        {"repository": "a", "run_id": 1, "job_id": 1, "name": "x", "completed_at": AT.replace(microsecond=500), "steps": None},
        {"repository": "a", "run_id": 1, "job_id": 1, "name": "b", "steps": [step, (None, None, None, None)]},
        {"repository": "a", "run_id": 1, "job_id": None, "name": None, "steps": None},
        {"repository": "a", "run_id": 2, "job_id": 5, "name": "x", "steps": None},
    ])
    return table("runs", [{"repository": "a", "run_id": i} for i in (1, 2, 3)]), jobs


def test_jobs_of_a_run_in_order(table):
    got = {r.run_id: r for r in job_summary(*_rows(table)).collect()}
    assert [(r.gh_job_id, r.total_jobs, r.concurrent_jobs, r.tests_ran) for r in (got[1], got[2], got[3])] == [
        ([None, 1, 1, 2], 4, 4, True), ([5], 1, 1, False), ([], 0, 1, False),
    ]
    details = [d.asDict(recursive=True) for d in got[1].job_details]
    assert [d["job_name"] for d in details] == [None, "b", "x", "lint"]
    assert [len(d["steps"]) for d in details] == [0, 2, 0, 1]
    assert details[2]["job_end"] == "2024-01-05 10:00:00.0005" and details[3]["job_start"] == "2024-01-05 10:00:00"
    shown = {"step_name": "Run tests", "step_conclusion": "success", "step_start": "2024-01-05 10:00:00", "step_end": None, "step_duration": None}
    assert details[3]["steps"] == [shown]
    assert got[3].job_details is None


def _aggregate(df):
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return next(line for line in lines if "Aggregate [" in line)


def test_details_travel_only_when_they_are_asked_for(table):
    assert "started_at" not in _aggregate(job_summary(*_rows(table)).drop("job_details"))
    # and then the times as they are, not as texts
    whole = _aggregate(job_summary(*_rows(table)))
    assert "started_at" in whole and "as string" not in whole


def test_plain_times_and_others(spark):
    texts = [
        "2024-01-05T10:00:00Z", "2024-01-05T10:00:00.123Z", " 2024-01-05T10:00:00Z ", "2024-01-05T10:00:00", "2024-01-05",
        "2024-01-05 10:00:00", "2024-01-05T12:00:00+02:00", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.unix_micros(utc_time(F.col("t")))).collect()]
    at = 1704448800000000
    assert got == [at, at + 123000, at, at, at - 36000000000, at, at, None]
