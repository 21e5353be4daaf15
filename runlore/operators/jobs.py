"""Job rows: parent run, log facts, the previous comparable job and what changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.functions.errors import ESCAPE, error_reason, strip_colors, strip_stamps
from runlore.functions.logs import (
    action_name,
    actions_used,
    operating_system,
    runner_image,
    runner_type,
    warning_count,
)
from runlore.functions.rules import step_kind
from runlore.functions.values import DAY, micros, seconds_between, truthy
from runlore.operators.ordered import Cuts, join_few, previous_row
from runlore.session import cut_lineage

JOB_KEY = ["repository", "job_id"]

# Actions that share artifacts and the one that caches.
ARTIFACT_ACTIONS = ["actions/upload-artifact", "actions/download-artifact"]
CACHE_ACTION = "actions/cache"


def job_with_run(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs with the columns of their parent run.

    What features take from the steps is taken here, before the exchange, so that steps travel only where they
    are asked for: ``__step_count`` and ``__error_step``.
    """
    if "steps" in jobs.columns:
        jobs = jobs.withColumns({"__step_count": step_count(F.col("steps")), "__error_step": first_error_step(F.col("steps"))})
    parents = runs.select(
        "repository",
        "run_id",
        "workflow_id",
        "head_branch",
        "head_sha",
        F.col("event").alias("run_event"),
        F.col("status").alias("run_status"),
        F.col("conclusion").alias("run_conclusion"),
        F.col("created_at").alias("run_created_at"),
        F.col("actor.login").alias("actor_login"),
        F.lit(True).alias("__run"),
    )
    return jobs.join(parents, ["repository", "run_id"], "left")


def job_base(enriched: DataFrame, workflows: DataFrame, spread: bool = False) -> DataFrame:
    """Base columns of a job row."""
    first = (
        workflows.withColumn("__id", F.col("id").cast("string"))
        .groupBy("repository", "__id")
        .agg(F.min_by("name", "list_pos").alias("workflow_name"))
    )
    asked = enriched.withColumn("__id", F.col("workflow_id").cast("string"))
    return (
        join_few(asked, first, ["repository", "__id"], "job_id", spread, "left")
        .select(
            *JOB_KEY,
            "run_id",
            "workflow_id",
            "workflow_name",
            F.col("name").alias("job_name"),
            F.col("status").alias("job_status"),
            F.col("conclusion").alias("job_conclusion"),
            F.col("started_at").alias("job_started_at"),
            F.col("completed_at").alias("job_completed_at"),
            seconds_between("started_at", "completed_at").alias("job_duration"),
            F.col("head_branch").alias("branch"),
            F.col("head_sha").alias("commit_sha"),
            F.col("run_event").alias("workflow_event_trigger"),
            "run_status",
            "run_conclusion",
            F.coalesce("actor_login", F.lit("unknown")).alias("actor_name"),
            "steps",
            "__step_count" if "__step_count" in enriched.columns else step_count(F.col("steps")).alias("__step_count"),
            "labels",
            "runner_name",
            "runner_group_name",
        )
        .withColumnRenamed("__step_count", "step_count")
    )


def log_facts(job_logs: DataFrame) -> DataFrame:
    """Everything the features need from a log, read in one pass; the text goes no further.

    Runs without an exchange, so it is bounded by the scan of the logs. One comparison leaves out logs that are
    null or empty: where a log is derived, each condition on it makes it once more.
    """
    return (
        job_logs.filter(F.col("log") > "")
        .withColumn("__plain", strip_stamps(F.col("log")))
        .withColumn("__text", strip_colors(F.col("__plain")))
        .withColumn("__plain_lowered", F.lower("__plain"))
        .withColumn(
            "__text_lowered",
            F.when(F.col("log").contains(ESCAPE), F.lower("__text")).otherwise(F.col("__plain_lowered")),
        )
        .select(
            *JOB_KEY,
            error_reason(F.col("log"), F.col("__text"), F.col("__text_lowered")).alias("error_reason"),
            runner_image(F.col("__plain")).alias("runner_image"),
            operating_system(F.col("__plain")).alias("operation_system"),
            warning_count(F.col("__plain_lowered")).alias("log_warn_nums"),
            actions_used(F.col("__plain")).alias("actions"),
            truthy(F.col("__plain")).alias("has_text"),
        )
    )


def previous_attempts(jobs: DataFrame, cuts: Cuts | None = None, target_rows: int | None = None) -> DataFrame:
    """For each job, the job of the same name in the same run that started before it."""
    started = F.coalesce("started_at", "created_at")
    narrow = jobs.select("repository", "run_id", "name", "job_id", started.alias("__start")).filter(
        F.col("__start").isNotNull() & F.col("name").isNotNull()
    )
    return previous_row(
        narrow, ["repository", "run_id", "name"], ["__start", "job_id"], ["job_id"], "__p",
        cuts=cuts, target_rows=target_rows,
    ).select(*JOB_KEY, F.col("__p.job_id").alias("prev_attempt_id"))


def previous_workflow_runs(
    runs: DataFrame, days: int = 30, cuts: Cuts | None = None, target_rows: int | None = None
) -> DataFrame:
    """For each run, the next older finished run of its workflow if it is at most ``days`` older.

    Runs that succeeded or failed are candidates, whatever is selected; every run is a probe.
    """
    narrow = runs.select("repository", "run_id", "workflow_id", "created_at", "conclusion").filter(
        F.col("workflow_id").isNotNull() & F.col("created_at").isNotNull()
    )
    paired = previous_row(
        narrow, ["repository", "workflow_id"], ["created_at", "run_id"], ["run_id", "created_at"], "__p",
        where=F.col("conclusion").isin("success", "failure"), cuts=cuts, target_rows=target_rows,
    )
    near = micros(F.col("__p.created_at")) >= micros("created_at") - days * DAY
    return paired.select("repository", "run_id", F.when(near, F.col("__p.run_id")).alias("prev_run_id"))


def previous_jobs(
    jobs: DataFrame,
    runs: DataFrame,
    days: int = 30,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
    selected: DataFrame | None = None,
) -> DataFrame:
    """For each job, the previous comparable job: an earlier attempt, else the same job one run before.

    With ``selected`` only those jobs are answered, from the same candidates.
    """
    asked = (jobs if selected is None else selected).select(*JOB_KEY, "run_id", "name")
    earlier_runs = previous_workflow_runs(runs, days, cuts, target_rows).filter(
        F.col("prev_run_id").isNotNull()
    )
    siblings = jobs
    if selected is not None:
        run_key = ["repository", "run_id"]
        wanted = asked.select(*run_key).distinct()
        earlier_runs = earlier_runs.join(wanted, run_key, "left_semi")
        siblings = jobs.join(wanted, run_key, "left_semi")
        jobs = jobs.join(
            earlier_runs.select("repository", F.col("prev_run_id").alias("run_id")).distinct(), run_key, "left_semi"
        )
    attempts = previous_attempts(siblings, cuts, target_rows)
    # of several jobs with the name, the first listed one is compared
    named = (
        jobs.filter(F.col("name").isNotNull())
        .groupBy("repository", F.col("run_id").alias("prev_run_id"), "name")
        .agg(F.min("job_id").alias("prev_named_id"))
    )
    return (
        asked.join(attempts, JOB_KEY, "left")
        .join(earlier_runs, ["repository", "run_id"], "left")
        .join(named, ["repository", "prev_run_id", "name"], "left")
        .select(*JOB_KEY, F.coalesce("prev_attempt_id", "prev_named_id").alias("prev_job_id"))
    )


def job_pairs(facts: DataFrame, previous: DataFrame) -> DataFrame:
    """Log facts of each job next to those of its previous job.

    The previous jobs' facts are brought to the jobs, not the other way round: a job without one takes no facts along.
    """
    before = facts.select(
        "repository",
        F.col("job_id").alias("prev_job_id"),
        F.col("runner_image").alias("prev_image"),
        F.col("actions").alias("prev_actions"),
        F.col("has_text").alias("has_prev"),
    )
    return facts.select(*JOB_KEY, "runner_image", "actions").join(
        previous.join(before, ["repository", "prev_job_id"], "left"), JOB_KEY, "left"
    )


def changes_since_previous(facts: DataFrame, previous: DataFrame) -> DataFrame:
    """Whether the runner image and the pinned actions differ from the previous job's; null without one.

    The previous jobs are stored first, so what finding them takes of the disk is free again before the facts travel.
    """
    previous = cut_lineage(previous)

    def other_sha(action: Column) -> Column:
        return F.exists(
            "prev_actions", lambda p: (p["action"] == action["action"]) & (p["sha"] != action["sha"])
        )

    compared = F.coalesce("has_prev", F.lit(False))
    return job_pairs(facts, previous).select(
        *JOB_KEY,
        F.when(compared, ~F.col("runner_image").eqNullSafe(F.col("prev_image"))).alias("is_runner_changed"),
        F.when(compared, F.exists("actions", other_sha)).alias("is_action_changed"),
    )


def job_actions(facts: DataFrame) -> DataFrame:
    """One row per job and action."""
    # a plain explode adds a filter on the array's size, which would move below the facts and read
    # every log twice; the outer form with a filter on its result does not
    used = facts.select(*JOB_KEY, F.explode_outer("actions").alias("a")).filter(F.col("a").isNotNull())
    return used.select(*JOB_KEY, "a.action", "a.sha")


def action_flags(facts: DataFrame, repositories: DataFrame) -> DataFrame:
    """Whether a job uses an action of no known organisation, shares artifacts, or caches.

    Sharing and caching are read from the job's own list, before the exchange. The names of unknown actions are
    brought to the jobs, so an action that nearly all jobs use is no hot key.
    """
    owned = (
        repositories.filter(F.col("has_organization")).select(F.col("repository").alias("name")).distinct()
    )
    used = job_actions(facts).select(*JOB_KEY, action_name(F.col("action")).alias("name")).filter("name is not null")
    unknown = used.select("name").distinct().join(owned, "name", "left_anti")
    unverified = (
        join_few(used, unknown, ["name"], "job_id", True)
        .select(*JOB_KEY, F.lit(True).alias("__unverified"))
        .distinct()
    )

    def uses(names: list[str]) -> Column:
        return F.coalesce(F.exists("actions", lambda a: action_name(a["action"]).isin(names)), F.lit(False))

    own = facts.select(*JOB_KEY, uses(ARTIFACT_ACTIONS).alias("is_artifact_share"), uses([CACHE_ACTION]).alias("is_action_cache"))
    return own.join(unverified, JOB_KEY, "left").select(
        *JOB_KEY,
        F.coalesce("__unverified", F.lit(False)).alias("use_unverified_action"),
        "is_artifact_share",
        "is_action_cache",
    )


def parsed_steps(steps: Column) -> Column:
    """Steps given as text, with ' for "; null when the text is no list of steps."""
    schema = "array<struct<name:string,conclusion:string,started_at:string,completed_at:string>>"
    return F.from_json(F.regexp_replace(steps, "'", '"'), schema)


def step_count(steps: Column) -> Column:
    """Number of steps, 0 without a list."""
    return F.coalesce(F.size(steps), F.lit(0)).cast("long")


def first_error_step(steps: Column) -> Column:
    """Kind of the first failed step; null when none failed."""
    failed = F.filter(steps, lambda s: s["conclusion"] == "failure")
    return step_kind(F.try_element_at(failed, F.lit(1))["name"])


def day_and_hour(started: str) -> tuple[Column, Column]:
    """Day of the week (Monday is 0) and hour, in UTC whatever the session's time zone."""
    # 1 January 1970 was a Thursday
    day = F.pmod(F.floor(micros(started) / F.lit(DAY)) + 3, F.lit(7))
    return day.cast("long"), F.pmod(F.floor(micros(started) / F.lit(DAY // 24)), F.lit(24)).cast("long")


def _default_branches(enriched: DataFrame, repositories: DataFrame) -> DataFrame:
    """Default branches of the repositories that have jobs."""
    names = enriched.select("repository").distinct()
    return repositories.select("repository", "default_branch").join(names, "repository", "left_semi")


def default_branch_flag(enriched: DataFrame, repositories: DataFrame) -> DataFrame:
    """Whether the job ran on the default branch of its repository; false without a known one.

    In ``job_diagnostics`` the flag is null instead where the repository is unknown.
    """
    defaults = _default_branches(enriched, repositories)
    return join_few(enriched, defaults, ["repository"], "job_id", True, "left").select(
        *JOB_KEY, F.coalesce(F.col("head_branch").eqNullSafe(F.col("default_branch")), F.lit(False)).alias("is_master")
    )


def job_diagnostics(
    enriched: DataFrame,
    facts: DataFrame,
    previous: DataFrame,
    repositories: DataFrame,
    spread: bool = False,
    store: bool = True,
) -> DataFrame:
    """Diagnostic columns of each job; all null without a run context, repository or log.

    ``facts`` is read in several places, so pass it materialised when logs are large. With ``store`` the parts
    are stored one after the other, and the disk holds the exchanges of one of them at a time.
    """
    kept = cut_lineage if store else lambda df: df
    day, hour = day_and_hour("started_at")
    dated = enriched.filter(F.coalesce("run_created_at", "created_at").isNotNull())
    known = join_few(dated, _default_branches(enriched, repositories), ["repository"], "job_id", spread)
    shown = known.select(
        *JOB_KEY,
        (F.col("__error_step") if "__error_step" in enriched.columns else first_error_step(F.col("steps"))).alias("gh_first_error_step"),
        day.alias("day_of_week"),
        hour.alias("time_of_day"),
        F.col("head_branch").eqNullSafe(F.col("default_branch")).alias("is_master"),
    )
    texts = facts.select(
        *JOB_KEY, "error_reason", "log_warn_nums", "operation_system", runner_type(F.col("operation_system")).alias("runner_type")
    )
    return (
        shown.join(texts, JOB_KEY)
        .join(kept(changes_since_previous(facts, previous)), JOB_KEY, "left")
        .join(kept(action_flags(facts, repositories)), JOB_KEY, "left")
    )
