"""Commits behind a run: metrics, overlap with the previous build, CI configuration churn, pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions.manifests import CI_CONFIG_PATH
from runlore.functions.rules import commit_kind
from runlore.functions.values import DAY, micros, word_count
from runlore.operators.ordered import NO_CUTS, Cuts, asof_sums, previous_row
from runlore.operators.runs import RUN_KEY
from runlore.session import cut_lineage


def base_commit(runs: DataFrame, commits: DataFrame) -> DataFrame:
    """First parent of the run's head commit."""
    parents = commits.select("repository", F.col("sha").alias("head_sha"), F.col("parent_sha").alias("base_sha"))
    return (
        runs.select(*RUN_KEY, "head_sha")
        .join(parents, ["repository", "head_sha"], "left")
        .select(*RUN_KEY, "base_sha")
    )


def commit_metrics(
    runs: DataFrame, run_commits: DataFrame, commits: DataFrame, commit_files: DataFrame
) -> DataFrame:
    """Over the commits of a run: issue references, commits with files, kinds, and their number."""
    with_files = commit_files.select("repository", "sha").distinct().withColumn("__files", F.lit(1))
    # classify each commit once, then bring the short answers to the runs
    described = (
        commits.select(
            "repository",
            "sha",
            F.coalesce(F.col("message").rlike(r"(?U)#\d+"), F.lit(False)).alias("__issue"),
            commit_kind(F.col("message")).alias("__kind"),
        )
        .join(with_files, ["repository", "sha"], "left")
    )
    per_run = (
        run_commits.join(described, ["repository", "sha"])
        .groupBy(*RUN_KEY)
        .agg(
            F.bool_or("__issue").alias("commit_message_issue_ref"),
            F.count("__files").alias("gh_commits_on_files_touched"),
            # at most one entry per commit kind
            F.array_sort(F.collect_set("__kind")).alias("git_commit_attention"),
            F.count(F.lit(1)).alias("git_commits"),
        )
    )
    return (
        runs.select(*RUN_KEY)
        .join(per_run, RUN_KEY, "left")
        .select(
            *RUN_KEY,
            F.coalesce("commit_message_issue_ref", F.lit(False)).alias("commit_message_issue_ref"),
            F.coalesce("gh_commits_on_files_touched", F.lit(0)).cast("long").alias("gh_commits_on_files_touched"),
            F.coalesce("git_commit_attention", F.array().cast("array<string>")).alias("git_commit_attention"),
            F.coalesce("git_commits", F.lit(0)).cast("long").alias("git_commits"),
        )
    )


def same_files_as_previous(
    context: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Whether a run's head commit shares a file with that of the run before it on the branch.

    Null without an older run on the branch or when one of the commits is unknown.
    """
    narrow = context.select(*RUN_KEY, "head_branch", "head_sha", "created_at")
    paired = previous_row(
        narrow, ["repository", "head_branch"], ["created_at", "run_id"], ["head_sha"], "__p",
        cuts=cuts, target_rows=target_rows,
    )
    # the runs are read for the pairs and for the result, and put in order once
    paired = cut_lineage(paired.select(*RUN_KEY, "head_sha", F.col("__p.head_sha").alias("__prev")))
    # many runs share a pair of commits, so each pair is compared once
    pairs = (
        paired.filter(F.col("head_sha").isNotNull() & F.col("__prev").isNotNull())
        .select("repository", "head_sha", "__prev")
        .distinct()
    )
    known = commits.select("repository", "sha")
    comparable = pairs.join(
        known.withColumnRenamed("sha", "head_sha"), ["repository", "head_sha"], "left_semi"
    ).join(known.withColumnRenamed("sha", "__prev"), ["repository", "__prev"], "left_semi")
    files = commit_files.select("repository", "sha", "filename")
    shared = (
        comparable.join(files.withColumnRenamed("sha", "head_sha"), ["repository", "head_sha"])
        .join(files.withColumnRenamed("sha", "__prev"), ["repository", "__prev", "filename"], "left_semi")
        .select("repository", "head_sha", "__prev")
        .distinct()
        .withColumn("__shared", F.lit(True))
    )
    answers = comparable.join(shared, ["repository", "head_sha", "__prev"], "left").withColumn(
        "prev_build_same_files_touched", F.coalesce("__shared", F.lit(False))
    )
    return paired.join(answers, ["repository", "head_sha", "__prev"], "left").select(
        *RUN_KEY, "prev_build_same_files_touched"
    )


def ci_config_churn(
    runs: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    weeks: int = 4,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Workflow files changed by commits of the ``weeks`` up to the run, by whole days."""

    def day(column: str):
        return F.floor(micros(column) / F.lit(DAY)).cast("long")

    changed = commit_files.filter(F.col("filename").rlike(CI_CONFIG_PATH)).groupBy("repository", "sha").agg(
        F.count(F.lit(1)).alias("__files")
    )
    events = (
        commits.filter(F.col("committed_at").isNotNull())
        .select("repository", "sha", day("committed_at").alias("__day"))
        .join(changed, ["repository", "sha"])
        .groupBy("repository", "__day")
        .agg(F.sum("__files").alias("__files"))
    )
    dated = runs.filter(F.col("created_at").isNotNull()).select("repository", "run_id", day("created_at").alias("__day"))
    # Runs of one day share the answer, so a repository has a few rows per day here: no group is hot
    # unless a smaller limit is asked for.
    if cuts is None and target_rows is None:
        cuts = NO_CUTS
    counted = asof_sums(
        events,
        {"files": F.col("__files")},
        dated.select("repository", "__day").distinct().withColumn("__probe", F.col("__day")),
        {"hi": (F.col("__probe"), True), "lo": (F.col("__probe") - 7 * weeks, False)},
        levels={"all": ["repository"]},
        ids=["repository", "__day"],
        at="__day",
        cuts=cuts,
        target_rows=target_rows,
    ).withColumn("__churn", F.col("hi_all_files") - F.col("lo_all_files"))
    return (
        runs.select(*RUN_KEY)
        .join(dated.join(counted, ["repository", "__day"]).select(*RUN_KEY, "__churn"), RUN_KEY, "left")
        .select(*RUN_KEY, F.coalesce("__churn", F.lit(0)).cast("long").alias("repo_ci_config_churn_nums"))
    )


def description_score():
    """Complexity of a pull request from its title and body."""
    body = F.coalesce("body", F.lit(""))
    low = F.lower(body)
    refers = body.contains("#") | low.contains("fixes") | low.contains("closes")
    linked = body.contains("http://") | body.contains("https://")

    def points(hit, value: int):
        return F.when(hit, value).otherwise(0)

    return (
        word_count(F.col("title")) * 2
        + word_count(body)
        + points(body.contains("```"), 50)
        + points(refers, 30)
        + points(linked, 20)
    ).cast("long")


def first_pull_requests(pull_requests: DataFrame) -> DataFrame:
    """The first listed pull request of each head commit, with the measures of its text.

    Only the measures travel to the exchange; the body stays where it was read.
    """
    measured = pull_requests.select(
        "repository",
        "head_sha",
        F.struct("list_pos", "number").alias("__rank"),
        F.struct(
            "number",
            "merge_commit_sha",
            "comments",
            word_count(F.col("body")).alias("words"),
            description_score().alias("score"),
        ).alias("__pr"),
    )
    return measured.groupBy("repository", "head_sha").agg(F.min_by("__pr", "__rank").alias("__pr"))


def pull_request_features(runs: DataFrame, pull_requests: DataFrame, score: bool = False) -> DataFrame:
    """Pull request of the run's head commit. Complexity is the body's word count, or the score."""
    joined = (
        runs.select(*RUN_KEY, "head_sha")
        .join(first_pull_requests(pull_requests), ["repository", "head_sha"], "left")
    )
    complexity = F.col("__pr.score") if score else F.col("__pr.words")
    return joined.select(
        *RUN_KEY,
        F.col("__pr").isNotNull().alias("gh_is_pr"),
        F.coalesce("__pr.comments", F.lit(0)).cast("long").alias("gh_num_pr_comments"),
        F.col("__pr.merge_commit_sha").alias("git_merged_with"),
        F.col("__pr.number").alias("pr_number"),
        F.coalesce(complexity, F.lit(0)).cast("long").alias("gh_pr_description_complexity"),
    )
