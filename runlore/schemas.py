"""Input tables and output columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

STEP = "struct<name:string,conclusion:string,started_at:timestamp,completed_at:timestamp>"

TABLES: dict[str, str] = {
    "tasks": "repository string, run_id string, collected string",
    "job_tasks": "repository string, job_id string, collected string",
    "runs": (
        "repository string, run_id bigint, workflow_id bigint, name string, head_sha string,"
        " head_branch string, status string, conclusion string, event string, run_attempt int,"
        " created_at timestamp, updated_at timestamp, actor struct<login:string,id:bigint>,"
        " head_commit struct<timestamp:timestamp>"
    ),
    "jobs": (
        "repository string, job_id bigint, run_id bigint, name string, status string,"
        " conclusion string, created_at timestamp, started_at timestamp, completed_at timestamp,"
        f" run_attempt int, steps array<{STEP}>, labels array<string>, runner_name string,"
        " runner_group_name string"
    ),
    "job_logs": "repository string, job_id bigint, log string",
    "commits": (
        "repository string, sha string, parent_sha string, author_name string, author_email string,"
        " author_login string, message string, committed_at timestamp"
    ),
    "run_commits": "repository string, run_id bigint, sha string",
    "commit_parents": "repository string, sha string, parent_sha string, place int, committed_at timestamp",
    "commit_files": "repository string, sha string, filename string, status string, patch string",
    "pull_requests": (
        "repository string, head_sha string, number bigint, title string, body string,"
        " merge_commit_sha string, comments bigint, list_pos int"
    ),
    "workflows": "repository string, id bigint, name string, path string, list_pos int",
    "file_contents": "repository string, sha string, path string, content string",
    "repo_files": "repository string, name string",
    "repo_languages": "repository string, language string, bytes bigint, list_pos int",
    "repositories": "repository string, default_branch string, has_organization boolean",
    "file_metrics": "repository string, sha string, path string, code_lines bigint, total_lines bigint",
    "java_symbols": (
        "repository string, sha string, path string, kind string, class_name string, name string,"
        " signature string, body_hash string, position int"
    ),
}

RUN_BASE = [
    "workflow_id", "actor_name", "branch", "commit_sha", "languages", "status",
    "workflow_event_trigger", "conclusion", "created_at", "updated_at", "build_duration",
    "total_builds", "gh_first_commit_created_at", "build_language", "dependencies_count",
    "workflow_size", "test_frameworks", "workflow_name",
]
RUN_SIZE = ["gh_sloc", "gh_test_lines_per_kloc", "sloc_initial", "test_lines_initial"]
RUN_DIFF = [
    "gh_files_added", "gh_files_deleted", "gh_files_modified", "gh_lines_added", "gh_lines_deleted",
    "gh_src_churn", "gh_tests_added", "gh_tests_deleted", "gh_test_churn", "gh_src_files",
    "gh_doc_files", "gh_other_files", "gh_config_files", "dockerfile_changed",
    "docker_compose_changed", "gh_files_entropy", "gh_files_type_modified",
    "gh_cross_module_changes", "gh_hotspot_files_touched",
]
RUN_SYMBOLS = [
    "ast_class_added", "ast_class_deleted", "ast_class_modified", "ast_class_changed",
    "ast_met_added", "ast_met_deleted", "ast_met_changed", "ast_met_sig_modified",
    "ast_met_body_modified", "ast_field_added", "ast_field_deleted", "ast_field_changed",
    "ast_import_added", "ast_import_deleted", "ast_import_changed", "src_ast_diff",
    "test_ast_diff", "gh_dependencies_churn",
]
RUN_HISTORY = [
    "gh_commits_on_files_touched", "git_num_committers", "git_commits",
    "gh_team_size_last_3_month", "commit_message_issue_ref", "git_commit_attention",
    "external_github_resource", "git_same_committer", "gh_previous_build_result",
    "repo_fail_rate_history", "gh_committer_bayesian_trust_score_history",
    "repo_fail_rate_recent", "gh_committer_bayesian_trust_score_recent",
    "git_committer_repo_exp", "is_core_member", "concurrent_jobs", "committer_cross_project_exp",
    "gh_committer_first_build", "prev_build_same_files_touched", "repo_ci_config_churn_nums",
    "base_sha", "pr_number", "gh_pr_description_complexity", "trigger_event",
]
RUN_TESTS = ["tests_passed", "tests_failed", "tests_skipped", "tests_total"]
RUN_JOBS = ["gh_job_id", "total_jobs", "job_details", "tests_ran"]
RUN_PULL_REQUEST = [
    "gh_is_pr", "gh_num_pr_comments", "git_merged_with", "gh_pr_description_complexity",
]

JOB_BASE = [
    "run_id", "workflow_id", "workflow_name", "job_name", "job_status", "job_conclusion",
    "job_started_at", "job_completed_at", "job_duration", "branch", "commit_sha",
    "workflow_event_trigger", "run_status", "run_conclusion", "actor_name", "steps", "step_count",
    "labels", "runner_name", "runner_group_name",
]
JOB_DIAGNOSTICS = [
    "error_reason", "is_runner_changed", "is_action_changed", "log_warn_nums", "operation_system",
    "gh_first_error_step", "runner_type", "use_unverified_action", "is_artifact_share",
    "is_action_cache", "day_of_week", "time_of_day", "is_master",
]

# Values of the code and history columns for a run whose change set cannot be read.
RUN_DEFAULTS: dict[str, object] = (
    {c: 0 for c in RUN_DIFF + RUN_SYMBOLS}
    | {
        "gh_commits_on_files_touched": 0,
        "git_num_committers": 0,
        "git_commits": 0,
        "gh_team_size_last_3_month": 0,
        "commit_message_issue_ref": False,
        "external_github_resource": False,
        "repo_fail_rate_history": 0.0,
        "gh_committer_bayesian_trust_score_history": 0.0,
        "repo_fail_rate_recent": 0.0,
        "gh_committer_bayesian_trust_score_recent": 0.0,
        "git_committer_repo_exp": 0,
        "concurrent_jobs": 0,
        "repo_ci_config_churn_nums": 0,
        "gh_pr_description_complexity": 0,
    }
)


def require(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Fail early, naming the columns that ``df`` lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns: {', '.join(missing)}")
    return df
