"""Queries over the run history: slices, windows, experience, committers."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.case import Tables, case
from runlore.operators import ancestry, commits, people, runs, slices

DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US
SPLIT_ROWS = 150  # small enough for every repository of the test data to be split

FROM, TO = "2024-01-05 00:00:00", "2024-01-20 12:00:00"

RUN_BASE = """
SELECT repository, run_id, workflow_id, coalesce(actor.login, 'unknown') AS actor_name, head_branch AS branch,
  head_sha AS commit_sha, status, event AS workflow_event_trigger, event AS trigger_event, conclusion,
  epoch_us(created_at) AS created_at, epoch_us(updated_at) AS updated_at,
  epoch_us(head_commit."timestamp") AS gh_first_commit_created_at,
  round((epoch_us(updated_at) - epoch_us(created_at)) / 1e6, 6) AS build_duration
FROM {runs}"""

DURATION = """
SELECT repository, run_id, round((epoch_us(updated_at) - epoch_us(created_at)) / 1e6, 6) AS build_duration
FROM {runs}"""

TOTAL_BUILDS = """
SELECT repository, run_id, row_number() OVER (PARTITION BY repository ORDER BY created_at DESC, run_id DESC) AS total_builds
FROM {%s}"""

PREVIOUS_RUN = """
SELECT repository, run_id,
  CASE WHEN row_number() OVER w > 1 THEN lag(actor.id) OVER w IS NOT DISTINCT FROM actor.id END AS git_same_committer,
  lag(conclusion) OVER w AS gh_previous_build_result
FROM {%s} WINDOW w AS (PARTITION BY repository ORDER BY created_at, run_id)"""

_RATED = f"""
WITH h AS (
  SELECT repository, run_id, actor.id AS actor_id, epoch_us(created_at) AS us,
    CASE WHEN conclusion = 'failure' THEN 1 ELSE 0 END AS bad FROM {{%s}}
), f AS (
  SELECT *, count(*) OVER (PARTITION BY repository) AS total,
    sum(bad) OVER (PARTITION BY repository ORDER BY us RANGE BETWEEN {4 * WEEK_US} PRECEDING AND CURRENT ROW) AS bad4,
    sum(bad) OVER (PARTITION BY repository ORDER BY us RANGE BETWEEN {WEEK_US} PRECEDING AND CURRENT ROW) AS bad1,
    count(*) OVER (PARTITION BY repository ORDER BY us RANGE BETWEEN {4 * WEEK_US} PRECEDING AND CURRENT ROW) AS all4,
    count(*) OVER (PARTITION BY repository ORDER BY us RANGE BETWEEN {WEEK_US} PRECEDING AND CURRENT ROW) AS all1,
    count(*) OVER (PARTITION BY repository, actor_id ORDER BY us RANGE BETWEEN {4 * WEEK_US} PRECEDING AND CURRENT ROW) AS n4,
    sum(bad) OVER (PARTITION BY repository, actor_id ORDER BY us RANGE BETWEEN {4 * WEEK_US} PRECEDING AND CURRENT ROW) AS f4,
    count(*) OVER (PARTITION BY repository, actor_id ORDER BY us RANGE BETWEEN {WEEK_US} PRECEDING AND CURRENT ROW) AS n1,
    sum(bad) OVER (PARTITION BY repository, actor_id ORDER BY us RANGE BETWEEN {WEEK_US} PRECEDING AND CURRENT ROW) AS f1
  FROM h
)"""

FAILURE_HISTORY = _RATED + """
SELECT repository, run_id, round(bad4 / total, 6) AS repo_fail_rate_history,
  round(((n4 - f4) + 5 * (1 - bad4 / total)) / (n4 + 5), 6) AS gh_committer_bayesian_trust_score_history,
  round(bad1 / total, 6) AS repo_fail_rate_recent,
  round(((n1 - f1) + 5 * (1 - bad1 / total)) / (n1 + 5), 6) AS gh_committer_bayesian_trust_score_recent
FROM f"""

FAILURE_BEFORE = _RATED + """
, g AS (SELECT repository, run_id,
  CASE WHEN all4 > 1 THEN (bad4 - bad) / (all4 - 1) ELSE 0.0 END AS m4, CASE WHEN all1 > 1 THEN (bad1 - bad) / (all1 - 1) ELSE 0.0 END AS m1,
  n4 - 1 AS n4, f4 - bad AS f4, n1 - 1 AS n1, f1 - bad AS f1 FROM f)
SELECT repository, run_id, round(m4, 6) AS repo_fail_rate_history,
  CASE WHEN n4 > 0 THEN round(((n4 - f4) + 5 * (1 - m4)) / (n4 + 5), 6) ELSE 0.0 END AS gh_committer_bayesian_trust_score_history,
  round(m1, 6) AS repo_fail_rate_recent,
  CASE WHEN n1 > 0 THEN round(((n1 - f1) + 5 * (1 - m1)) / (n1 + 5), 6) ELSE 0.0 END AS gh_committer_bayesian_trust_score_recent
FROM g"""

CONTEXT = f"""
WITH s AS (SELECT repository, run_id, epoch_us(created_at) AS us FROM {{runs}} WHERE conclusion = 'cancelled' AND event = 'push'),
b AS (SELECT repository, min(us) - {WEEK_US} AS lo, max(us) AS hi FROM s GROUP BY 1)
SELECT r.repository, r.run_id, r.conclusion FROM {{runs}} r JOIN b USING (repository)
WHERE (r.conclusion IN ('success', 'failure') AND epoch_us(r.created_at) BETWEEN lo AND hi)
  OR (r.conclusion = 'cancelled' AND r.event = 'push')"""


@case("c01_run_base", RUN_BASE)
def _(t: Tables):
    return runs.run_base(t["runs"])


@case("c02_build_duration", DURATION)
def _(t: Tables):
    return runs.build_duration(t["runs"])


@case("c03_total_builds", TOTAL_BUILDS % "tied_runs")
def _(t: Tables):
    return runs.total_builds(t["tied_runs"])


@case("c03_total_builds_split", TOTAL_BUILDS % "tied_runs")
def _(t: Tables):
    return runs.total_builds(t["tied_runs"], target_rows=SPLIT_ROWS)


@case("run_context", CONTEXT)
def _(t: Tables):
    chosen = t["runs"].filter("conclusion = 'cancelled' and event = 'push'")
    return runs.run_context(t["runs"], chosen, 1).select("repository", "run_id", "conclusion")


@case("run_context_spread", CONTEXT)
def _(t: Tables):
    chosen = t["runs"].filter("conclusion = 'cancelled' and event = 'push'")
    return runs.run_context(t["runs"], chosen, 1, spread=True).select("repository", "run_id", "conclusion")


@case("c13_previous_run", PREVIOUS_RUN % "runs")
def _(t: Tables):
    return runs.previous_run(t["runs"])


@case("c13_previous_run_ties", PREVIOUS_RUN % "tied_runs")
def _(t: Tables):
    return runs.previous_run(t["tied_runs"])


@case("c13_previous_run_split", PREVIOUS_RUN % "tied_runs")
def _(t: Tables):
    return runs.previous_run(t["tied_runs"], target_rows=SPLIT_ROWS)


@case("c14_c15_failure_history", FAILURE_HISTORY % "runs")
def _(t: Tables):
    return runs.failure_history(t["runs"])


@case("c14_c15_failure_history_ties", FAILURE_HISTORY % "tied_runs")
def _(t: Tables):
    return runs.failure_history(t["tied_runs"])


@case("c14_c15_failure_history_split", FAILURE_HISTORY % "runs")
def _(t: Tables):
    return runs.failure_history(t["runs"], target_rows=SPLIT_ROWS)


@case("c14_c15_failure_before", FAILURE_BEFORE % "runs")
def _(t: Tables):
    return runs.failure_history(t["runs"], denominator="window", include_current=False)


_FINISHED = "conclusion IN ('success', 'failure')"


@case("b1_runs_in_period", f"SELECT repository, run_id, epoch_us(created_at) AS created_at FROM {{runs}} WHERE {_FINISHED} AND created_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'")
def _(t: Tables):
    return slices.runs_in_period(t["runs"], FROM, TO).select("repository", "run_id", "created_at")


@case("b2_runs_in_past_weeks", f"SELECT repository, run_id, epoch_us(created_at) AS created_at FROM {{runs}} WHERE {_FINISHED} AND created_at BETWEEN TIMESTAMP '{TO}' - INTERVAL 14 DAY AND TIMESTAMP '{TO}'")
def _(t: Tables):
    return slices.runs_in_past_weeks(t["runs"], TO, 2).select("repository", "run_id", "created_at")


@case("b3_latest_runs", f"""
SELECT * FROM (SELECT repository, run_id, row_number() OVER (PARTITION BY repository ORDER BY created_at DESC, run_id DESC) AS position
FROM {{tied_runs}} WHERE {_FINISHED} AND created_at <= TIMESTAMP '2000-01-01 00:00:00') WHERE position <= 50""")
def _(t: Tables):
    return slices.latest_runs(t["tied_runs"], "2000-01-01 00:00:00").select("repository", "run_id", "position")


@case("b4_runs_in_range", f"SELECT repository, run_id, conclusion FROM {{runs}} WHERE created_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'")
def _(t: Tables):
    return slices.runs_in_range(t["runs"], FROM, TO).select("repository", "run_id", "conclusion")


EXPERIENCE = f"""
SELECT r.repository, r.run_id, count(c.sha) AS git_committer_repo_exp
FROM {{runs}} r LEFT JOIN {{commits}} c ON c.repository = r.repository AND c.author_login = r.actor.login
  AND epoch_us(c.committed_at) BETWEEN epoch_us(r.created_at) - {4 * WEEK_US} AND epoch_us(r.created_at)
GROUP BY 1, 2"""


@case("b5_repository_experience", EXPERIENCE)
def _(t: Tables):
    return slices.repository_experience(t["runs"], t["commits"])


@case("b5_repository_experience_split", EXPERIENCE)
def _(t: Tables):
    return slices.repository_experience(t["runs"], t["commits"], target_rows=20)


# In the test data the login is matched with the owner through a renamed repository.
CROSS_PROJECT = """
WITH l AS (SELECT 'u' || CAST(CAST(replace(repository, 'org/r', '') AS BIGINT) + 1 AS VARCHAR) AS owner, repository, head_branch, count(*) AS n FROM {runs} GROUP BY ALL),
e AS (SELECT owner FROM l WHERE n > 20 GROUP BY owner HAVING count(*) >= 3)
SELECT r.repository, r.run_id, CASE WHEN r.actor.login IS NOT NULL THEN e.owner IS NOT NULL END AS committer_cross_project_exp
FROM {runs} r LEFT JOIN e ON e.owner = r.actor.login"""


@case("b6_cross_project_experience", CROSS_PROJECT)
def _(t: Tables):
    number = F.regexp_replace("repository", "org/r", "").cast("bigint") + 1
    owned = t["runs"].withColumn(
        "repository", F.concat(F.lit("u"), number.cast("string"), F.lit("/"), F.col("head_branch"))
    )
    return slices.cross_project_experience(t["runs"], owned, 20, 3)


TOUCHES = """
SELECT r.repository, r.run_id, epoch_us(r.created_at) AS us, f.filename, CASE WHEN r.conclusion = 'failure' THEN 1 ELSE 0 END AS bad
FROM {runs} r JOIN {run_commits} c ON c.repository = r.repository AND c.run_id = r.run_id
JOIN {commit_files} f ON f.repository = c.repository AND f.sha = c.sha WHERE r.conclusion IS NOT NULL"""

HOTSPOTS = f"""
WITH t AS ({TOUCHES})
SELECT repository, filename, count(*) AS total, CAST(sum(bad) AS BIGINT) AS failures,
  round(sum(bad) * 100.0 / count(*), 2) AS failure_rate, round(100 - sum(bad) * 100.0 / count(*), 2) AS success_rate
FROM t WHERE us BETWEEN epoch_us(TIMESTAMP '{TO}') - {30 * DAY_US} AND epoch_us(TIMESTAMP '{TO}')
GROUP BY 1, 2 HAVING count(*) >= 5 AND sum(bad) * 100.0 / count(*) >= 20"""

HOTSPOT_TOUCHED = f"""
WITH t AS ({TOUCHES}),
p AS (SELECT DISTINCT r.repository, r.run_id, epoch_us(r.created_at) AS us, f.filename
  FROM {{runs}} r JOIN {{commit_files}} f ON f.repository = r.repository AND f.sha = r.head_sha),
u AS (SELECT repository, filename, us, bad, 1 AS n, NULL AS run_id FROM t UNION ALL SELECT repository, filename, us, 0, 0, run_id FROM p),
w AS (SELECT repository, run_id, sum(n) OVER k AS total, sum(bad) OVER k AS failures FROM u
  WINDOW k AS (PARTITION BY repository, filename ORDER BY us RANGE BETWEEN {30 * DAY_US} PRECEDING AND CURRENT ROW))
SELECT repository, run_id, max(CASE WHEN total >= 5 AND failures * 100.0 / total >= 20 THEN 1 ELSE 0 END)::BIGINT AS gh_hotspot_files_touched
FROM w WHERE run_id IS NOT NULL GROUP BY 1, 2
HAVING gh_hotspot_files_touched = 1"""


@case("c16_hotspot_files", HOTSPOTS)
def _(t: Tables):
    return slices.hotspot_files(t["runs"], t["run_commits"], t["commit_files"], TO)


@case("d07_hotspot_touched", HOTSPOT_TOUCHED)
def _(t: Tables):
    return slices.hotspot_touched(t["runs"], t["runs"], t["run_commits"], t["commit_files"])


@case("d07_hotspot_touched_split", HOTSPOT_TOUCHED)
def _(t: Tables):
    return slices.hotspot_touched(t["runs"], t["runs"], t["run_commits"], t["commit_files"], target_rows=10)


COMMITTERS = f"""
WITH c AS (SELECT repository, author_name || ' <' || author_email || '>' AS who, epoch_us(committed_at) AS us FROM {{commits}}),
r AS (SELECT repository, run_id, epoch_us(created_at) - 1000000 AS upto, epoch_us(created_at) - {90 * DAY_US} AS since FROM {{runs}}),
first_seen AS (SELECT repository, who, min(us) AS us FROM c GROUP BY 1, 2),
a AS (SELECT r.repository, r.run_id, count(f.who) AS n FROM r LEFT JOIN first_seen f ON f.repository = r.repository AND f.us <= r.upto GROUP BY 1, 2),
b AS (SELECT r.repository, r.run_id, count(DISTINCT c.who) AS n FROM r LEFT JOIN c ON c.repository = r.repository AND c.us BETWEEN r.since AND r.upto GROUP BY 1, 2)
SELECT a.repository, a.run_id, a.n AS git_num_committers, b.n AS gh_team_size_last_3_month FROM a JOIN b USING (repository, run_id)"""

STANDING = """
WITH c AS (SELECT repository, author_name AS name, author_email, epoch_us(committed_at) AS us,
    row_number() OVER (PARTITION BY repository, author_name, author_email ORDER BY committed_at, sha) AS n FROM {commits}),
k AS (SELECT repository, name, min(us) AS first_us, min(CASE WHEN n = 6 THEN us END) AS core_us FROM c GROUP BY 1, 2)
SELECT r.repository, r.run_id, coalesce(k.core_us <= epoch_us(r.created_at) - 1000000, false) AS is_core_member,
  NOT coalesce(k.first_us <= epoch_us(r.created_at) - 1000000, false) AS gh_committer_first_build
FROM {runs} r LEFT JOIN k ON k.repository = r.repository AND k.name = r.actor.login"""


@case("c17_committer_counts", COMMITTERS)
def _(t: Tables):
    return people.committer_counts(t["runs"], t["commits"])


@case("c17_committer_counts_split", COMMITTERS)
def _(t: Tables):
    return people.committer_counts(t["runs"], t["commits"], target_rows=SPLIT_ROWS)


@case("c18_committer_standing", STANDING)
def _(t: Tables):
    return people.committer_standing(t["runs"], t["commits"])


# what either side of a run's range reaches, commit by commit
_REACHED = """
SELECT r.repository, r.run_id, r.{side}_sha AS sha FROM {{{{run_ranges}}}} r
  WHERE EXISTS (FROM known k WHERE k.repository = r.repository AND k.sha = r.base_sha)
    AND EXISTS (FROM known k WHERE k.repository = r.repository AND k.sha = r.head_sha)
  UNION
  SELECT x.repository, x.run_id, p.parent_sha FROM {side}_reached x
  JOIN {{{{commit_parents}}}} p ON p.repository = x.repository AND p.sha = x.sha WHERE p.parent_sha IS NOT NULL"""
COMMITS_IN_RANGE = f"""
SELECT * FROM (WITH RECURSIVE known AS (SELECT DISTINCT repository, sha FROM {{commit_parents}}),
head_reached AS ({_REACHED.format(side='head').replace('{{', '{').replace('}}', '}')}),
base_reached AS ({_REACHED.format(side='base').replace('{{', '{').replace('}}', '}')})
SELECT h.* FROM head_reached h JOIN known USING (repository, sha) ANTI JOIN base_reached b
  ON b.repository = h.repository AND b.run_id = h.run_id AND b.sha = h.sha) f"""


@case("c28_commits_in_range", COMMITS_IN_RANGE)
def _(t: Tables):
    return ancestry.commits_between(t["run_ranges"], t["commit_parents"])


@case("c20_metrics_of_ranges", """
SELECT r.repository, r.run_id, count(DISTINCT c.sha) AS git_commits
FROM {runs} r LEFT JOIN (%s) c ON c.repository = r.repository AND c.run_id = r.run_id GROUP BY 1, 2""" % COMMITS_IN_RANGE)
def _(t: Tables):
    """The commits of a run derived from the history instead of being handed in."""
    derived = ancestry.commits_between(t["run_ranges"], t["commit_parents"])
    return commits.commit_metrics(t["runs"], derived, t["commits"], t["commit_files"]).select("repository", "run_id", "git_commits")
