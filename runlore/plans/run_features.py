"""One wide feature row per workflow run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore import schemas
from runlore.functions.testlogs import parser_name, test_facts
from runlore.operators import ancestry, changes, commits, people, repositories, runs, slices
from runlore.operators.ordered import join_facts
from runlore.operators.runs import RUN_KEY
from runlore.plans.pruning import likely, only, within
from runlore.plans.settings import Settings
from runlore.session import cut_lineage

# Parts that one stage joins with the rows. Every join keeps at least a page of memory for each task, up to
# 64 MB, however few rows it has; so a stage with all of them would need more than an executor has.
PARTS_AT_ONCE = 5

Tables = Mapping[str, DataFrame]


def repository_facts(tables: Tables) -> DataFrame:
    """One row per repository: language, build tool, frameworks, root dependencies."""
    contents = tables["root_contents"]
    facts = [
        repositories.dominant_language(tables["repo_languages"]),
        repositories.repository_build_language(tables["repo_files"]),
        repositories.detected_frameworks(tables["repo_files"], contents),
        repositories.root_dependencies(tables["repo_files"], contents),
    ]
    joined = facts[0]
    for fact in facts[1:]:
        joined = joined.join(fact, "repository", "full_outer")
    return joined


def test_totals(
    selected: DataFrame, jobs: DataFrame, job_logs: DataFrame, facts: DataFrame, spread: bool = False
) -> DataFrame:
    """Test results of each run: its job logs read with the parser of the first framework found.

    Each log is read once and only the counts of the parsers that matched leave the scan. There is
    no filter on those counts: it would move below them and read the logs a second time.
    """
    read = test_facts(job_logs).withColumnRenamed("results", "__found")
    parsers = facts.select(
        "repository", parser_name(F.get("test_frameworks", F.lit(0)), F.col("build_language")).alias("__parser")
    )
    names = ["passed", "failed", "skipped"]
    placed = read.join(jobs.select("repository", "job_id", "run_id"), ["repository", "job_id"])
    per_run = (
        join_facts(placed, parsers, ["repository"], "job_id", spread)
        .withColumn("__r", F.try_element_at("__found", F.col("__parser")))
        .groupBy(*RUN_KEY)
        .agg(*[F.sum(F.col("__r")[n]).alias(n) for n in names])
    )
    zero = F.lit(0).cast("long")
    joined = selected.select(*RUN_KEY).join(per_run, RUN_KEY, "left")
    counts = {f"tests_{n}": F.coalesce(n, zero) for n in names}
    return joined.select(
        *RUN_KEY, *[c.alias(n) for n, c in counts.items()], sum(counts.values(), zero).alias("tests_total")
    )


def _base(selected: DataFrame, tables: Tables, facts: DataFrame, skew, target_rows) -> DataFrame:
    spread = skew is None
    named = runs.workflow_names(selected, tables["workflows"], spread)
    located = named.join(selected.select(*RUN_KEY, "head_sha"), RUN_KEY)
    files = repositories.workflow_file_facts(located, tables["file_contents"])
    rows = (
        runs.run_base(selected)
        .join(runs.total_builds(selected, skew, target_rows), RUN_KEY)
        .join(named.drop("path"), RUN_KEY, "left")
        .join(files, RUN_KEY, "left")
    )
    return join_facts(rows, facts, ["repository"], "run_id", spread, "left").withColumns(
        {
            "languages": F.coalesce("languages", F.lit(repositories.NO_LANGUAGE)),
            "dependencies_count": F.coalesce("dependencies_count", F.lit(0)).cast("long"),
            "test_frameworks": F.coalesce("test_frameworks", F.array().cast("array<string>")),
        }
    )


def needed_commits(tables: Tables, selected: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """The commit tables with the head commits of the selected runs and, where compared, their parents.

    Patches, symbols and manifests are read after this. Tables with texts are cut in their scans and may
    keep a few other commits, which the joins with the runs leave out.
    """
    key = ["repository", "sha"]
    heads = selected.select("repository", F.col("head_sha").alias("sha"))
    own = only(tables["commits"], heads, key, limit)
    both = heads.unionByName(own.select("repository", F.col("parent_sha").alias("sha")))
    kept = {"commits": own}
    kept |= {n: likely(tables[n], heads, key, limit) for n in ("commit_files", "file_metrics") if n in tables}
    return kept | {n: likely(tables[n], both, key, limit) for n in ("java_symbols", "file_contents")}


def _change_columns(
    selected: DataFrame, tables: Tables, near: Tables, context: DataFrame, s: Settings, skew
) -> DataFrame:
    """Columns of the head commit's own change; only for runs whose head has a parent.

    ``near`` holds the tables of the commits to compare, ``tables`` those of the whole history.
    """
    counts = repositories.manifest_counts(near["file_contents"])
    per_commit = changes.commit_change_features(
        near["commits"], near["commit_files"], near["java_symbols"], counts, s.case_insensitive_docker
    ).withColumnRenamed("dependencies_count", "__commit_dependencies")
    if s.enabled("fetch_sloc"):
        # without a line counter's table the lines are counted in the texts
        sized = near["file_metrics"] if "file_metrics" in near else repositories.content_metrics(near["file_contents"])
        per_commit = per_commit.join(repositories.code_size(sized), ["repository", "sha"], "left")
    per_commit = per_commit.withColumnRenamed("sha", "head_sha")
    hot = slices.hotspot_touched(
        selected, context, tables["run_commits"], tables["commit_files"], s.hotspot_days, cuts=skew, target_rows=s.target_rows
    )
    return (
        selected.select(*RUN_KEY, "head_sha")
        .join(per_commit, ["repository", "head_sha"])
        .drop("head_sha")
        .join(hot, RUN_KEY, "left")
    )


def _history_columns(
    selected: DataFrame, tables: Tables, all_runs: DataFrame, context: DataFrame, s: Settings, skew
) -> list[DataFrame]:
    known, files = tables["commits"], tables["commit_files"]
    limit = {"cuts": skew, "target_rows": s.target_rows}
    return [
        people.committer_counts(selected, known, s.team_days, **limit),
        people.committer_standing(selected, known, s.standing_key),
        commits.base_commit(selected, known),
        commits.commit_metrics(selected, tables["run_commits"], known, files),
        runs.previous_run(context, **limit),
        runs.failure_history(context, s.history_weeks, s.recent_weeks, **limit),
        slices.repository_experience(selected, known, s.experience_weeks, **limit),
        slices.cross_project_experience(selected, all_runs, s.large_repository_runs, s.large_repositories),
        runs.concurrent_jobs(selected, tables["jobs"]),
        commits.same_files_as_previous(context, known, files, **limit),
        commits.ci_config_churn(selected, known, files, s.churn_weeks, **limit),
    ]


def _with_defaults(df: DataFrame) -> DataFrame:
    fill = {c: v for c, v in schemas.RUN_DEFAULTS.items() if c in df.columns}
    return df.na.fill(fill)


def run_features(tables: Tables, selected: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Feature rows of the selected runs (all runs by default), columns by enabled group.

    All parts are keyed by (repository, run_id), so the row side is exchanged once for several joins. Where commit
    details or sizes are on, rows are stored after every PARTS_AT_ONCE of the many parts. With a
    selection, every table is first restricted to its repositories, the commit tables to the commits
    that are compared, and the logs to the selected runs' jobs. Without a table ``run_commits`` the commits
    of the runs are derived from ``commit_parents``.
    """
    s = settings or Settings()
    all_runs, partial = tables["runs"], selected is not None
    selected = all_runs if selected is None else selected
    if partial:
        tables = within(tables, selected, s.broadcast_keys)
    code = s.enabled("fetch_sloc") or s.enabled("fetch_commit_details")
    facts = repository_facts(tables)

    if code and "run_commits" not in tables:
        tables = dict(tables) | {"run_commits": ancestry.commits_of_runs(tables["runs"], tables["commits"], tables["commit_parents"])}
    # one look at the repositories' sizes serves every operator that orders by time
    ordered = [tables["runs"], tables["commits"], tables["run_commits"]] if code else [tables["runs"]]
    skew = runs.repository_cuts(*ordered, target_rows=s.target_rows)
    context = runs.run_context(tables["runs"], selected, s.history_weeks, spread=skew is None)
    rows = _base(selected, tables, facts, skew, s.target_rows)
    columns = list(schemas.RUN_BASE)
    if code:
        near = needed_commits(tables, selected, s.broadcast_keys) if partial else tables
        rows = rows.join(_change_columns(selected, tables, near, context, s, skew), RUN_KEY, "left")
        for number, part in enumerate(_history_columns(selected, tables, all_runs, context, s, skew)):
            if number % PARTS_AT_ONCE == 0:
                rows = cut_lineage(rows)
            rows = rows.join(part, RUN_KEY, "left")
        rows = rows.withColumn(
            "dependencies_count", F.coalesce("__commit_dependencies", "dependencies_count")
        )
        if not s.enabled("fetch_sloc"):
            kinds = {"gh_test_lines_per_kloc": "double"}
            rows = rows.withColumns({c: F.lit(None).cast(kinds.get(c, "long")) for c in schemas.RUN_SIZE})
        columns += schemas.RUN_SIZE + schemas.RUN_DIFF + schemas.RUN_SYMBOLS + schemas.RUN_HISTORY
    if s.enabled("fetch_test_parsing_results"):
        jobs, logs = tables["jobs"], tables["job_logs"]
        if partial:
            jobs = only(jobs, selected, RUN_KEY, s.broadcast_keys)
            logs = likely(logs, jobs, ["repository", "job_id"], s.broadcast_keys)
        tests = test_totals(selected, jobs, logs, facts, spread=skew is None)
        rows = rows.join(tests, RUN_KEY, "left")
        columns += schemas.RUN_TESTS
    if s.enabled("fetch_job_details"):
        summary = runs.job_summary(selected, tables["jobs"]).drop("concurrent_jobs")
        rows = rows.join(summary, RUN_KEY, "left")
        columns += schemas.RUN_JOBS
    details = s.enabled("fetch_pull_request_details")
    if code or details:
        # where both groups are on, the word count replaces the score
        pulls = commits.pull_request_features(selected, tables["pull_requests"], score=not details)
        rows = rows.join(pulls, RUN_KEY, "left")
        columns += [c for c in schemas.RUN_PULL_REQUEST if details and c not in columns]
    return _with_defaults(rows.select(*RUN_KEY, *columns))
