"""Queries over jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.case import Tables, case
from contract.history_cases import DAY_US
from contract.text_cases import FACTS_BODY, FIRST_ERROR
from runlore.operators import jobs, runs
from runlore.plans.job_features import job_features
from runlore.plans.settings import Settings
from runlore.session import cut_lineage

_PARENT = """
SELECT j.repository, j.job_id, j.run_id, r.workflow_id, r.head_branch, r.head_sha, r.event AS run_event, r.status AS run_status,
  r.conclusion AS run_conclusion, r.actor.login AS actor_login FROM {jobs} j LEFT JOIN {tied_runs} r ON r.repository = j.repository AND r.run_id = j.run_id"""

JOB_BASE = f"""
SELECT j.repository, j.job_id, j.run_id, p.workflow_id, w.workflow_name, j.name AS job_name, j.status AS job_status, j.conclusion AS job_conclusion,
  epoch_us(j.started_at) AS job_started_at, epoch_us(j.completed_at) AS job_completed_at,
  round((epoch_us(j.completed_at) - epoch_us(j.started_at)) / 1e6, 6) AS job_duration, p.head_branch AS branch, p.head_sha AS commit_sha,
  p.run_event AS workflow_event_trigger, p.run_status, p.run_conclusion, coalesce(p.actor_login, 'unknown') AS actor_name,
  coalesce(len(j.steps), 0) AS step_count, array_to_string(j.labels, ',') AS labels, j.runner_name, j.runner_group_name
FROM {{jobs}} j JOIN ({_PARENT}) p ON p.repository = j.repository AND p.job_id = j.job_id
LEFT JOIN (SELECT repository, id, arg_min(name, list_pos) AS workflow_name FROM {{workflows}} GROUP BY 1, 2) w ON w.repository = j.repository AND w.id = p.workflow_id"""

ATTEMPTS = """
SELECT repository, job_id, lag(job_id) OVER (PARTITION BY repository, run_id, name ORDER BY coalesce(started_at, created_at), job_id) AS prev_attempt_id FROM {jobs}"""

EARLIER_RUNS = f"""
SELECT r.repository, r.run_id, arg_max(p.run_id, (epoch_us(p.created_at), p.run_id)) FILTER (epoch_us(r.created_at) - epoch_us(p.created_at) <= {30 * DAY_US}) AS prev_run_id
FROM (SELECT * FROM {{tied_runs}} %s) r LEFT JOIN {{tied_runs}} p ON p.repository = r.repository AND p.workflow_id = r.workflow_id AND p.conclusion IN ('success', 'failure')
  AND (p.created_at, p.run_id) < (r.created_at, r.run_id) AND p.created_at >= r.created_at - INTERVAL 30 DAY GROUP BY 1, 2"""

PREVIOUS = f"""
SELECT j.repository, j.job_id, coalesce(a.prev_attempt_id, k.prev_named_id) AS prev_job_id
FROM {{jobs}} j JOIN ({ATTEMPTS}) a ON a.repository = j.repository AND a.job_id = j.job_id
LEFT JOIN ({EARLIER_RUNS}) e ON e.repository = j.repository AND e.run_id = j.run_id
LEFT JOIN (SELECT repository, run_id, name, min(job_id) AS prev_named_id FROM {{jobs}} GROUP BY 1, 2, 3) k
  ON k.repository = j.repository AND k.run_id = e.prev_run_id AND k.name = j.name"""

CHANGED_BODY = f"""
{FACTS_BODY}, prev AS ({PREVIOUS}),
paired AS (SELECT f.repository, f.job_id, f.runner_image, g.job_id AS prev_job_id, g.runner_image AS prev_image, coalesce(g.has_text, false) AS compared
  FROM facts f LEFT JOIN prev p ON p.repository = f.repository AND p.job_id = f.job_id LEFT JOIN facts g ON g.repository = f.repository AND g.job_id = p.prev_job_id),
moved AS (SELECT DISTINCT p.repository, p.job_id FROM paired p JOIN acts a ON a.repository = p.repository AND a.job_id = p.job_id
  JOIN acts b ON b.repository = p.repository AND b.job_id = p.prev_job_id AND b.action = a.action AND b.sha <> a.sha),
changed AS (SELECT p.repository, p.job_id, CASE WHEN compared THEN runner_image IS DISTINCT FROM prev_image END AS is_runner_changed,
  CASE WHEN compared THEN m.job_id IS NOT NULL END AS is_action_changed FROM paired p LEFT JOIN moved m ON m.repository = p.repository AND m.job_id = p.job_id)"""

FLAGS_BODY = """
owned AS (SELECT DISTINCT repository AS name FROM {repositories} WHERE has_organization),
flags AS (SELECT f.repository, f.job_id, coalesce(bool_or(a.action IS NOT NULL AND o.name IS NULL), false) AS use_unverified_action,
  coalesce(bool_or(trim(split_part(a.action, '@', 1)) IN ('actions/upload-artifact', 'actions/download-artifact')), false) AS is_artifact_share,
  coalesce(bool_or(trim(split_part(a.action, '@', 1)) = 'actions/cache'), false) AS is_action_cache
  FROM facts f LEFT JOIN acts a ON a.repository = f.repository AND a.job_id = f.job_id LEFT JOIN owned o ON o.name = trim(split_part(a.action, '@', 1)) GROUP BY 1, 2)"""

DIAGNOSTICS_BODY = f"""
{CHANGED_BODY}, {FLAGS_BODY},
diagnosed AS (SELECT j.repository, j.job_id, f.error_reason, c.is_runner_changed, c.is_action_changed, f.log_warn_nums, f.operation_system,
  {FIRST_ERROR.replace('steps', 'j.steps')} AS gh_first_error_step, f.runner_type, g.use_unverified_action, g.is_artifact_share, g.is_action_cache,
  isodow(j.started_at) - 1 AS day_of_week, hour(j.started_at) AS time_of_day, p.head_branch = d.default_branch AS is_master
FROM {{jobs}} j JOIN facts f ON f.repository = j.repository AND f.job_id = j.job_id
JOIN ({_PARENT}) p ON p.repository = j.repository AND p.job_id = j.job_id JOIN {{repositories}} d ON d.repository = j.repository
LEFT JOIN changed c ON c.repository = j.repository AND c.job_id = j.job_id LEFT JOIN flags g ON g.repository = j.repository AND g.job_id = j.job_id)"""

JOB_FEATURES = f"""
WITH {DIAGNOSTICS_BODY.replace(EARLIER_RUNS, EARLIER_RUNS)}
SELECT * FROM ({JOB_BASE}) b LEFT JOIN diagnosed USING (repository, job_id)"""


@case("e01_job_with_run", _PARENT)
def _(t: Tables):
    columns = ["repository", "job_id", "run_id", "workflow_id", "head_branch", "head_sha", "run_event", "run_status", "run_conclusion", "actor_login"]
    return jobs.job_with_run(t["jobs"], t["tied_runs"]).select(*columns)


@case("e02_job_base", JOB_BASE)
def _(t: Tables):
    return jobs.job_base(jobs.job_with_run(t["jobs"], t["tied_runs"]), t["workflows"]).drop("steps")


@case("e05_previous_attempts", ATTEMPTS)
def _(t: Tables):
    return jobs.previous_attempts(t["jobs"])


@case("e05_previous_attempts_split", ATTEMPTS)
def _(t: Tables):
    return jobs.previous_attempts(t["jobs"], target_rows=3)


@case("e05_previous_workflow_runs", EARLIER_RUNS % "")
def _(t: Tables):
    return jobs.previous_workflow_runs(t["tied_runs"])


@case("e05_previous_jobs", PREVIOUS % "")
def _(t: Tables):
    return jobs.previous_jobs(t["jobs"], t["tied_runs"])


def _facts(t: Tables):
    return cut_lineage(jobs.log_facts(t["job_logs"]))


@case("e06_e08_changes_since_previous", f"WITH {CHANGED_BODY % ''} SELECT * FROM changed")
def _(t: Tables):
    return jobs.changes_since_previous(_facts(t), jobs.previous_jobs(t["jobs"], t["tied_runs"]))


@case("e13_e14_action_flags", f"WITH {FACTS_BODY}, {FLAGS_BODY} SELECT * FROM flags")
def _(t: Tables):
    return jobs.action_flags(_facts(t), t["repositories"])


@case("e15_day_and_hour", "SELECT repository, job_id, isodow(started_at) - 1 AS day_of_week, hour(started_at) AS time_of_day FROM {jobs}")
def _(t: Tables):
    day, hour = jobs.day_and_hour("started_at")
    return t["jobs"].select("repository", "job_id", day.alias("day_of_week"), hour.alias("time_of_day"))


@case("e16_default_branch", f"SELECT p.repository, p.job_id, coalesce(p.head_branch = d.default_branch, false) AS is_master FROM ({_PARENT}) p LEFT JOIN {{repositories}} d ON d.repository = p.repository")
def _(t: Tables):
    return jobs.default_branch_flag(jobs.job_with_run(t["jobs"], t["tied_runs"]), t["repositories"])


@case("e17_job_diagnostics", f"WITH {DIAGNOSTICS_BODY % ''} SELECT * FROM diagnosed")
def _(t: Tables):
    enriched = jobs.job_with_run(t["jobs"], t["tied_runs"])
    previous = jobs.previous_jobs(t["jobs"], t["tied_runs"])
    return jobs.job_diagnostics(enriched, _facts(t), previous, t["repositories"])


def job_tables(t: Tables) -> dict:
    """The tables of a job feature extraction."""
    return {n: t[n] for n in ("jobs", "job_logs", "workflows", "repositories")} | {"runs": t["tied_runs"]}


@case("job_features", JOB_FEATURES % '')
def _(t: Tables):
    return job_features(job_tables(t)).drop("steps")


@case("job_features_split", JOB_FEATURES % '')
def _(t: Tables):
    return job_features(job_tables(t), settings=Settings(target_rows=200)).drop("steps")


# a few jobs, some of whose runs lie between finished ones without being finished themselves
_FEW = "job_id % 7 = 3 AND repository IN ('org/r1', 'org/r3')"


@case("e05_previous_jobs_subset", f"SELECT * FROM ({PREVIOUS % ''}) p WHERE {_FEW}")
def _(t: Tables):
    return jobs.previous_jobs(t["jobs"], t["tied_runs"], selected=t["jobs"].filter(_FEW))


@case("job_features_subset", f"SELECT * FROM ({JOB_FEATURES % ''}) f WHERE {_FEW}")
def _(t: Tables):
    return job_features(job_tables(t), t["jobs"].filter(_FEW)).drop("steps")


TESTS_RAN = """
SELECT repository, run_id, bool_or(lower(name) LIKE '%test%' OR len(list_filter(coalesce(steps, []), lambda s: lower(s.name) LIKE '%test%')) > 0) AS tests_ran
FROM {jobs} GROUP BY 1, 2"""

JOB_SUMMARY = f"""
SELECT r.repository, r.run_id, coalesce(k.ids, '') AS gh_job_id, coalesce(k.n, 0) AS total_jobs, greatest(coalesce(k.n, 0), 1) AS concurrent_jobs,
  coalesce(t.tests_ran, false) AS tests_ran
FROM {{tied_runs}} r LEFT JOIN (SELECT repository, run_id, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) AS ids, count(*) AS n FROM {{jobs}} GROUP BY 1, 2) k
  ON k.repository = r.repository AND k.run_id = r.run_id LEFT JOIN ({TESTS_RAN}) t ON t.repository = r.repository AND t.run_id = r.run_id"""


@case("c10_job_summary", JOB_SUMMARY)
def _(t: Tables):
    return runs.job_summary(t["tied_runs"], t["jobs"]).drop("job_details")


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@case("c10_job_details", f"""
SELECT repository, run_id, unnest(range(len(l))) AS n, unnest(list_transform(l, lambda x: x.d)) AS detail FROM (
  SELECT repository, run_id, list_sort(list(struct_pack(job_id, d := name || '|' || coalesce({_TIME.format('started_at')}, '-') || '|' || coalesce({_TIME.format('completed_at')}, '-')
    || '|' || conclusion || '|' || coalesce(len(steps), 0) || '|' || coalesce(steps[2].name || steps[2].conclusion || {_TIME.format('steps[2].started_at')}, '-')))) AS l
  FROM {{jobs}} GROUP BY 1, 2)""")
def _(t: Tables):
    details = runs.job_summary(t["tied_runs"], t["jobs"]).select("repository", "run_id", F.posexplode("job_details").alias("n", "d"))
    step = "coalesce(try_element_at(d.steps, 2).step_name || try_element_at(d.steps, 2).step_conclusion || try_element_at(d.steps, 2).step_start, '-')"
    whole = "regexp_replace(coalesce({}, '-'), '\\\\.[0-9]+$', '')"
    text = (
        f"d.job_name || '|' || {whole.format('d.job_start')} || '|' || {whole.format('d.job_end')} || '|' || d.job_result || '|' || size(d.steps) || '|' || {step}"
    )
    return details.select("repository", "run_id", F.col("n").cast("bigint").alias("n"), F.expr(text).alias("detail"))


@case("c11_tests_ran", TESTS_RAN)
def _(t: Tables):
    return runs.tests_ran(t["jobs"])
