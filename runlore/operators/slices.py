"""Slices of run history and the experience of committers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.functions.values import DAY, WEEK, micros
from runlore.operators.ordered import NO_CUTS, Cuts, asof_sums, join_facts, too_large
from runlore.operators.runs import RUN_KEY, repository_cuts, with_actor
from runlore.session import cut_lineage

# Conclusions that count as finished, and the size of the latest slice.
FINISHED = ("success", "failure")
LATEST_RUNS = 50


def _time(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def runs_in_period(runs: DataFrame, start, end) -> DataFrame:
    """Successful or failed runs created in [start, end], each run once."""
    return runs.filter(
        (F.col("created_at") >= _time(start))
        & (F.col("created_at") <= _time(end))
        & F.col("conclusion").isin(*FINISHED)
    ).dropDuplicates(RUN_KEY)


def runs_in_past_weeks(runs: DataFrame, end, weeks: int = 3) -> DataFrame:
    """Successful or failed runs of the ``weeks`` up to ``end``."""
    end = _time(end)
    return runs_in_period(runs, F.timestamp_micros(micros(end) - weeks * WEEK), end)


def latest_runs(runs: DataFrame, until, count: int = LATEST_RUNS) -> DataFrame:
    """The newest ``count`` successful or failed runs of each repository up to ``until``.

    The rank filter is applied before the exchange too, so a task sees at most ``count`` rows of a
    repository from each input partition.
    """
    newest = Window.partitionBy("repository").orderBy(F.desc("created_at"), F.desc("run_id"))
    return (
        runs.filter((F.col("created_at") <= _time(until)) & F.col("conclusion").isin(*FINISHED))
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= count)
    )


def runs_in_range(runs: DataFrame, start, end) -> DataFrame:
    """Runs of any conclusion created in [start, end]."""
    return runs.filter((F.col("created_at") >= _time(start)) & (F.col("created_at") <= _time(end)))


def repository_experience(
    runs: DataFrame,
    commits: DataFrame,
    weeks: int = 4,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Commits of the run's actor in the repository during the ``weeks`` before the run."""
    if cuts is None:
        cuts = repository_cuts(runs, commits, target_rows=target_rows)
    probes = (
        with_actor(runs)
        .filter(F.col("actor_login").isNotNull() & F.col("created_at").isNotNull())
        .select(*RUN_KEY, F.col("actor_login").alias("login"), micros("created_at").alias("__at"))
    )
    events = commits.filter(F.col("author_login").isNotNull() & F.col("committed_at").isNotNull()).select(
        "repository", "sha", F.col("author_login").alias("login"), micros("committed_at").alias("__at")
    )
    counted = asof_sums(
        events,
        {"commits": F.lit(1)},
        probes,
        {"hi": (F.col("__at"), True), "lo": (F.col("__at") - weeks * WEEK, False)},
        levels={"all": ["repository", "login"]},
        ids=RUN_KEY,
        at="__at",
        cuts=cuts,
        target_rows=target_rows,
    )
    return (
        runs.select(*RUN_KEY)
        .join(counted, RUN_KEY, "left")
        .select(
            *RUN_KEY,
            F.coalesce(F.col("hi_all_commits") - F.col("lo_all_commits"), F.lit(0)).cast("long").alias("git_committer_repo_exp"),
        )
    )


def cross_project_experience(
    runs: DataFrame, all_runs: DataFrame, min_runs: int = 1000, min_repositories: int = 3
) -> DataFrame:
    """Whether the actor owns at least ``min_repositories`` repositories above ``min_runs`` runs."""
    owner = F.substring_index("repository", "/", 1).alias("owner")
    experienced = (
        all_runs.groupBy("repository")
        .agg(F.count(F.lit(1)).alias("__runs"))
        .filter(F.col("__runs") > min_runs)
        .groupBy(owner)
        .agg(F.count(F.lit(1)).alias("__large"))
        .select("owner", (F.col("__large") >= min_repositories).alias("__experienced"))
    )
    return (
        with_actor(runs)
        .select(*RUN_KEY, F.when(F.col("actor_login") != "", F.col("actor_login")).alias("owner"))
        .transform(lambda asked: join_facts(asked, experienced, ["owner"], "run_id", True, "left"))
        .select(
            *RUN_KEY,
            F.when(F.col("owner").isNotNull(), F.coalesce("__experienced", F.lit(False))).alias(
                "committer_cross_project_exp"
            ),
        )
    )


def _touching_runs(runs: DataFrame, run_commits: DataFrame) -> DataFrame:
    """One row per (run, commit) of the runs that have a conclusion."""
    return (
        runs.filter(F.col("conclusion").isNotNull() & (F.col("conclusion") != "") & F.col("created_at").isNotNull())
        .select(*RUN_KEY, micros("created_at").alias("__at"), (F.col("conclusion") == "failure").cast("int").alias("__bad"))
        .join(run_commits, RUN_KEY)
    )


def _named_files(commit_files: DataFrame) -> DataFrame:
    return commit_files.filter(F.col("filename").isNotNull() & (F.col("filename") != "")).select("repository", "sha", "filename")


def run_file_touches(runs: DataFrame, run_commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """One row per (run, commit, file) of the runs that have a conclusion."""
    return _touching_runs(runs, run_commits).join(_named_files(commit_files), ["repository", "sha"])


def _hot(total: Column, failures: Column, min_total: int, min_rate: float) -> Column:
    return (total >= min_total) & (failures * 100.0 / total >= min_rate)


def hotspot_files(
    runs: DataFrame,
    run_commits: DataFrame,
    commit_files: DataFrame,
    as_of,
    days: int = 30,
    min_total: int = 5,
    min_rate: float = 20,
) -> DataFrame:
    """Files often touched by failing runs in the ``days`` up to ``as_of``, by repository."""
    end = _time(as_of)
    window = runs_in_range(runs, F.timestamp_micros(micros(end) - days * DAY), end)
    rate = F.col("failures") * 100.0 / F.col("total")
    return (
        run_file_touches(window, run_commits, commit_files)
        .groupBy("repository", "filename")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("__bad").alias("failures"))
        .filter(_hot(F.col("total"), F.col("failures"), min_total, min_rate))
        .withColumns({"failure_rate": F.round(rate, 2), "success_rate": F.round(100 - rate, 2)})
    )


def hotspot_touched(
    runs: DataFrame,
    context: DataFrame,
    run_commits: DataFrame,
    commit_files: DataFrame,
    days: int = 30,
    min_total: int = 5,
    min_rate: float = 20,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Runs whose head commit touches a file that is hot as of the run (1; other runs are absent)."""
    if cuts is None:
        # a file is touched at most once per commit of a run
        cuts = repository_cuts(runs, run_commits, target_rows=target_rows)
    touching = _touching_runs(context, run_commits)
    probing = runs.filter(F.col("created_at").isNotNull()).select(
        "repository", "run_id", F.col("head_sha").alias("sha"), micros("created_at").alias("__at")
    )
    # How often a commit's files are touched and asked for, counted by commit before its files are joined.
    none = F.lit(0)
    weights = (
        touching.select("repository", "sha", F.lit(1).alias("__n"), "__bad", none.alias("__p"))
        .unionByName(probing.select("repository", "sha", none.alias("__n"), none.alias("__bad"), F.lit(1).alias("__p")))
        .groupBy("repository", "sha")
        .agg(*[F.sum(c).alias(c) for c in ("__n", "__bad", "__p")])
    )
    files = (
        _named_files(commit_files)
        .join(weights, ["repository", "sha"])
        .groupBy("repository", "sha", "filename", "__n", "__bad", "__p")
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    # read for the totals, the touches and the files that are asked for
    files = cut_lineage(files)
    totals = files.groupBy("repository", "filename").agg(
        F.sum(F.col("__copies") * F.col("__n")).alias("__all"),
        F.sum(F.col("__copies") * F.col("__bad")).alias("__all_bad"),
        F.sum(F.col("__n") + 2 * F.col("__p")).alias("__rows"),
    )
    # A file that never reaches the limits over all time cannot reach them in any window.
    candidates = totals.filter(
        (F.col("__all") > 0) & (F.col("__all") >= min_total) & ((F.col("__all_bad") > 0) | F.lit(min_rate <= 0))
    )
    if cuts is None and not too_large(candidates.agg(F.max("__rows")).first()[0], target_rows):
        # the repository is hot, but what is put in order are its files
        cuts = NO_CUTS
    kept = files.join(candidates.select("repository", "filename"), ["repository", "filename"], "left_semi")
    events = touching.join(kept.select("repository", "sha", "filename", "__copies"), ["repository", "sha"])
    probes = probing.join(kept.select("repository", "sha", "filename"), ["repository", "sha"])
    counted = asof_sums(
        events,
        {"total": F.col("__copies"), "failures": F.col("__copies") * F.col("__bad")},
        probes,
        {"hi": (F.col("__at"), True), "lo": (F.col("__at") - days * DAY, False)},
        levels={"all": ["repository", "filename"]},
        ids=[*RUN_KEY, "filename"],
        at="__at",
        cuts=cuts,
        target_rows=target_rows,
    )
    total = F.col("hi_all_total") - F.col("lo_all_total")
    failures = F.col("hi_all_failures") - F.col("lo_all_failures")
    return (
        counted.filter(_hot(total, failures, min_total, min_rate))
        .select(*RUN_KEY)
        .distinct()
        .withColumn("gh_hotspot_files_touched", F.lit(1))
    )
