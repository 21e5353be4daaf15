"""Whole feature tables."""

import pytest
from pyspark.sql import functions as F

from contract.case import Tables, comparable
from contract.job_cases import job_tables
from contract.plan_cases import RUN_FEATURES
from contract.text_cases import run_tables
from contract.views import oracle
from runlore import schemas
from runlore.plans.extract import extract
from runlore.plans.run_features import run_features
from runlore.plans.settings import Settings
from runlore.sources.tasks import normalise_tasks
from tests.check_oracle import connection, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


def test_run_features_with_hot_repositories(spark):
    """Splitting every repository gives the same table as not splitting any."""

    def build(spark, sf_dir):
        t = Tables(spark, sf_dir)
        whole = run_tables(t) | {"file_metrics": t["file_metrics"]}
        return comparable(run_features(whole, settings=Settings(target_rows=60)).drop("job_details"))

    assert difference(spark, connection(SF_DIR), build, oracle(RUN_FEATURES), SF_DIR) is None


def test_run_features_have_the_published_columns(tables):
    df = run_features(run_tables(tables) | {"file_metrics": tables["file_metrics"]})
    groups = [schemas.RUN_BASE, schemas.RUN_SIZE, schemas.RUN_DIFF, schemas.RUN_SYMBOLS, schemas.RUN_HISTORY, schemas.RUN_TESTS, schemas.RUN_JOBS]
    expected = [c for g in groups for c in g] + ["gh_is_pr", "gh_num_pr_comments", "git_merged_with"]
    assert df.columns == ["repository", "run_id", *expected]
    assert len(set(df.columns)) == len(df.columns)


def test_selected_runs_only(tables):
    chosen = tables["runs"].filter("conclusion = 'cancelled'")
    df = run_features(run_tables(tables), chosen, Settings(fetch_all=False))
    assert df.count() == chosen.count()
    assert df.agg(F.max("total_builds")).first()[0] < chosen.count()


def test_extract_jobs(spark, tables):
    one = tables["jobs"].orderBy("job_id").first()
    listed = spark.createDataFrame([(one.repository, str(one.job_id), "", "kept"), ("o/z", "1", "0", "")], "repository string, job_id string, collected string, mine string")
    tasks = normalise_tasks(listed, "job_id")
    got = {r.job_id: r for r in extract(tasks, job_tables(tables), "job", [one.repository]).collect()}
    mine = got[str(one.job_id)]
    assert (mine.collected, mine.mine, mine.job_name, mine.actor_name[0]) == (1, "kept", one.name, "u")
    assert (got["1"].collected, got["1"].job_name) == (0, None)
    with pytest.raises(ValueError, match="Missing"):
        extract(tasks, job_tables(tables), "job", ["o/z"])
    with pytest.raises(ValueError, match="at least one repository"):
        extract(tasks, job_tables(tables), "job")


def test_extract_named_run_that_has_no_task(spark, tables):
    run = tables["runs"].filter("head_commit is null").first()
    tasks = normalise_tasks(spark.createDataFrame([], schemas.TABLES["tasks"]))
    settings = Settings(fetch_all=False)
    got = extract(tasks, run_tables(tables), "run", [run.repository], run_ids=[run.run_id], settings=settings).collect()
    assert [(r.run_id, r.collected, r.gh_first_commit_created_at) for r in got] == [(str(run.run_id), 1, "N/A")]
