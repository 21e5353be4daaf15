"""Run rows: base columns, position, previous run, failure rates and committer trust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions.values import WEEK, micros, seconds_between
from runlore.operators.ordered import (
    NO_CUTS,
    Cuts,
    has_hot_group,
    join_facts,
    previous_row,
    running_sums,
    trailing_sums,
)

RUN_KEY = ["repository", "run_id"]

# Weight of the prior in the trust score.
PRIOR_WEIGHT = 5


def with_actor(runs: DataFrame) -> DataFrame:
    """Lift the actor's login and id out of the nested column."""
    if "actor_id" in runs.columns:
        return runs
    return runs.withColumns({"actor_login": F.col("actor.login"), "actor_id": F.col("actor.id")})


def repository_cuts(*tables: DataFrame, target_rows: int | None = None) -> Cuts | None:
    """NO_CUTS when no repository is hot in any of the tables, else None: operators then look closer.

    A group by (repository, ...) is never larger than its repository, so this look at the stored
    tables, one column each, serves every operator that orders rows derived from them.
    """
    hot = any(has_hot_group(t.select("repository"), ["repository"], target_rows) for t in tables)
    return None if hot else NO_CUTS


def run_base(runs: DataFrame) -> DataFrame:
    """Base columns of a run row. Texts for missing values are put in at the CSV sink only."""
    return runs.select(
        "repository",
        "run_id",
        "workflow_id",
        F.coalesce(F.col("actor.login"), F.lit("unknown")).alias("actor_name"),
        F.col("head_branch").alias("branch"),
        F.col("head_sha").alias("commit_sha"),
        "status",
        F.col("event").alias("workflow_event_trigger"),
        F.col("event").alias("trigger_event"),
        "conclusion",
        "created_at",
        "updated_at",
        F.col("head_commit.timestamp").alias("gh_first_commit_created_at"),
        seconds_between("created_at", "updated_at").alias("build_duration"),
    )


def build_duration(runs: DataFrame) -> DataFrame:
    """Seconds from creation to last update; null when either is missing."""
    return runs.select(*RUN_KEY, seconds_between("created_at", "updated_at").alias("build_duration"))


def total_builds(selected: DataFrame, cuts: Cuts | None = None, target_rows: int | None = None) -> DataFrame:
    """1-based position of each selected run in its repository, newest first."""
    narrow = selected.select(*RUN_KEY, (-micros("created_at")).alias("__back"), (-F.col("run_id")).alias("__id"))
    # runs without a creation time are the oldest, so they come last
    narrow = narrow.withColumn("__undated", F.col("__back").isNull())
    return running_sums(
        narrow,
        ["repository"],
        ["__undated", "__back", "__id"],
        {"total_builds": F.lit(1).cast("long")},
        cuts=cuts,
        target_rows=target_rows,
    ).select(*RUN_KEY, "total_builds")


def run_context(
    runs: DataFrame, selected: DataFrame, history_weeks: int = 4, spread: bool = False
) -> DataFrame:
    """History that the features of the selected runs look at.

    Successful and failed runs from ``history_weeks`` before the earliest selected run of the
    repository up to the latest, and every selected run whatever its conclusion. ``spread`` deals
    the runs of a repository out over several tasks.
    """
    span = selected.groupBy("repository").agg(
        (F.min(micros("created_at")) - history_weeks * WEEK).alias("__from"),
        F.max(micros("created_at")).alias("__to"),
    )
    chosen = selected.select(*RUN_KEY).distinct().withColumn("__selected", F.lit(True))
    at = micros("created_at")
    return (
        join_facts(runs, span, ["repository"], "run_id", spread)
        .join(chosen, RUN_KEY, "left")
        .filter(
            F.col("__selected")
            | (F.col("conclusion").isin("success", "failure") & at.between(F.col("__from"), F.col("__to")))
        )
        .drop("__from", "__to", "__selected")
    )


def previous_run(
    context: DataFrame, cuts: Cuts | None = None, target_rows: int | None = None
) -> DataFrame:
    """Whether the next older run of the repository has the same actor, and how it ended.

    Two missing actors are the same actor; without an older run both answers are null.
    """
    narrow = with_actor(context).select(*RUN_KEY, "created_at", "actor_id", "conclusion")
    joined = previous_row(
        narrow,
        ["repository"],
        ["created_at", "run_id"],
        ["actor_id", "conclusion"],
        "__previous",
        cuts=cuts,
        target_rows=target_rows,
    )
    same = F.col("__previous.actor_id").eqNullSafe(F.col("actor_id"))
    return joined.select(
        *RUN_KEY,
        F.when(F.col("__previous").isNotNull(), same).alias("git_same_committer"),
        F.col("__previous.conclusion").alias("gh_previous_build_result"),
    )


def failure_history(
    context: DataFrame,
    history_weeks: int = 4,
    recent_weeks: int = 1,
    *,
    denominator: str = "context",
    include_current: bool = True,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Failure rate of the repository and trust in the actor over two trailing windows.

    The rate divides the failures of the window by all runs of the context; ``denominator='window'``
    divides by the runs of the window, and ``include_current=False`` leaves the run itself out.
    """
    if denominator not in ("context", "window"):
        raise ValueError("denominator must be 'context' or 'window'")
    spans = {"history": history_weeks * WEEK, "recent": recent_weeks * WEEK}
    narrow = with_actor(context).select(
        *RUN_KEY,
        "actor_id",
        micros("created_at").alias("__at"),
        F.col("conclusion").eqNullSafe("failure").cast("int").alias("__bad"),
    )
    sums = trailing_sums(
        narrow,
        {"runs": F.lit(1), "failures": F.col("__bad")},
        spans,
        levels={"repo": ["repository"], "actor": ["repository", "actor_id"]},
        ids=[*RUN_KEY, "__bad"],
        at="__at",
        cuts=cuts,
        target_rows=target_rows,
    )
    if denominator == "context":
        # runs without a time count as well, so this is a plain count and no point of the time line
        totals = narrow.groupBy("repository").agg(F.count(F.lit(1)).alias("all_repo_runs"))
        spread = cuts.any if cuts is not None else has_hot_group(narrow, ["repository"], target_rows)
        sums = join_facts(sums, totals, ["repository"], "run_id", spread, source=narrow)
    return failure_rates(sums, list(spans), denominator, include_current)


def failure_rates(sums: DataFrame, tags: list[str], denominator: str = "context", include_current: bool = True) -> DataFrame:
    """Rates and trust from the sums of each run's windows: ``<tag>_repo_*``, ``<tag>_actor_*``, ``all_repo_runs``."""
    own_run = F.lit(0) if include_current else F.lit(1)
    own_failure = F.lit(0) if include_current else F.col("__bad")
    columns = []
    for tag in tags:
        failures = F.col(f"{tag}_repo_failures") - own_failure
        size = F.col("all_repo_runs") if denominator == "context" else F.col(f"{tag}_repo_runs") - own_run
        rate = F.when(size > 0, failures / size).otherwise(F.lit(0.0))
        n = F.col(f"{tag}_actor_runs") - own_run
        f = F.col(f"{tag}_actor_failures") - own_failure
        trust = F.when(n > 0, ((n - f) + PRIOR_WEIGHT * (1 - rate)) / (n + PRIOR_WEIGHT)).otherwise(F.lit(0.0))
        columns += [
            rate.alias(f"repo_fail_rate_{tag}"),
            trust.alias(f"gh_committer_bayesian_trust_score_{tag}"),
        ]
    return sums.select(*RUN_KEY, *columns)


def workflow_names(runs: DataFrame, workflows: DataFrame, spread: bool = False) -> DataFrame:
    """Name and path of the first listed workflow with the run's workflow id."""
    first = (
        workflows.withColumn("__id", F.col("id").cast("string"))
        .groupBy("repository", "__id")
        .agg(F.min_by(F.struct("name", "path"), "list_pos").alias("__w"))
    )
    asked = runs.select(*RUN_KEY, F.col("workflow_id").cast("string").alias("__id"))
    return (
        join_facts(asked, first, ["repository", "__id"], "run_id", spread, "left")
        .select(*RUN_KEY, F.col("__w.name").alias("workflow_name"), F.col("__w.path").alias("path"))
    )


def job_summary(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Ids, details and number of a run's jobs, and whether a job or step looks like a test."""
    step = (
        "struct(s.name as step_name, s.conclusion as step_conclusion, "
        "cast(s.started_at as string) as step_start, cast(s.completed_at as string) as step_end, "
        "cast(null as double) as step_duration)"
    )

    detail = (
        "struct(j.job_id as job_id, j.name as job_name, cast(j.started_at as string) as job_start, "
        "cast(j.completed_at as string) as job_end, cast(null as double) as job_duration, j.conclusion as job_result, "
        f"transform(coalesce(j.steps, array()), s -> {step}) as steps)"
    )
    tested = F.lower("name").contains("test") | F.exists(
        F.coalesce("steps", F.array().cast(jobs.schema["steps"].dataType)),
        lambda s: F.coalesce(F.lower(s["name"]).contains("test"), F.lit(False)),
    )
    # ids and details are lists of their own, so that details travel only where they are asked for, and as they
    # are stored; texts are made of them after the exchange
    per_run = (
        jobs.select(*RUN_KEY, "job_id", "name", "started_at", "completed_at", "conclusion", "steps", F.coalesce(tested, F.lit(False)).alias("__test"))
        .groupBy(*RUN_KEY)
        .agg(
            F.array_sort(F.collect_list(F.struct("job_id"))).alias("__ids"),
            F.collect_list(F.struct("job_id", "name", "started_at", "completed_at", "conclusion", "steps")).alias("__jobs"),
            F.bool_or("__test").alias("__tested"),
        )
    )
    listed = F.coalesce(F.size("__ids"), F.lit(0)).cast("long")
    details = F.expr(f"array_sort(transform(__jobs, j -> {detail}))")
    return (
        runs.select(*RUN_KEY)
        .join(per_run, RUN_KEY, "left")
        .select(
            *RUN_KEY,
            F.coalesce(F.col("__ids.job_id"), F.array().cast("array<bigint>")).alias("gh_job_id"),
            listed.alias("total_jobs"),
            F.transform(details, lambda j: j.dropFields("job_id")).alias("job_details"),
            F.greatest(listed, F.lit(1)).cast("long").alias("concurrent_jobs"),
            F.coalesce("__tested", F.lit(False)).alias("tests_ran"),
        )
    )


def concurrent_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Number of a run's jobs, 1 for a run without any."""
    counted = jobs.groupBy(*RUN_KEY).agg(F.count(F.lit(1)).alias("concurrent_jobs"))
    return (
        runs.select(*RUN_KEY)
        .join(counted, RUN_KEY, "left")
        .select(*RUN_KEY, F.coalesce("concurrent_jobs", F.lit(1)).cast("long").alias("concurrent_jobs"))
    )


def tests_ran(jobs: DataFrame) -> DataFrame:
    """Per run: some job name or step name contains 'test'."""
    named = F.coalesce(F.lower("name").contains("test"), F.lit(False))
    stepped = F.coalesce(
        F.exists("steps", lambda s: F.coalesce(F.lower(s["name"]).contains("test"), F.lit(False))),
        F.lit(False),
    )
    return jobs.groupBy(*RUN_KEY).agg(F.bool_or(named | stepped).alias("tests_ran"))
