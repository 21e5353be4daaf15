"""Queries over logs, messages, manifests and workflow files."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from contract.case import Tables, case
from runlore.functions import errors, logs, manifests, rules, testlogs
from runlore.functions.values import line_count
from runlore.operators import commits, jobs, repositories, runs
from runlore.plans.run_features import repository_facts, test_totals


def _quoted(text: str) -> str:
    """A SQL literal inside a query text, with its braces protected."""
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def _chain(column: str, table: list[tuple[str, str]], extra: str = "") -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, {_quoted(extra + p)}) THEN {_quoted(label)}" for label, p in table)
    return f"CASE {whens} END"


def _strip(column: str) -> str:
    once = f"regexp_replace({column}, {_quoted(r'(?m)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s*')}, '', 'g')"
    return f"regexp_replace({once}, {_quoted(r'(?m)^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] \[autobuild\]\s*')}, '', 'g')"


def _uncolored(column: str) -> str:
    return f"regexp_replace({column}, {_quoted(r'\x1B(?:[@-Z\\-_]|\[[0-9;]*m)')}, '', 'g')"


_CLEAN = f"SELECT repository, job_id, log, {_strip('log')} AS plain, {_uncolored(_strip('log'))} AS clean FROM {{job_logs}} WHERE log <> ''"


def _all(pattern: str, group: int, column: str = "clean") -> str:
    return f"regexp_extract_all({column}, {_quoted(pattern)}, {group})"


def _first_reason(pattern: str) -> str:
    reason = (
        f"coalesce(CASE WHEN contains(b, 'Compilation failure') THEN {_chain('b', errors.COMPILE_RULES)} END,"
        f" {_chain('b', errors.MAVEN_RULES)})"
    )
    return f"list_filter(list_transform({_all(pattern, 1)}, lambda b: {reason}), lambda x: x IS NOT NULL)[1]"


_MAVEN = f"coalesce({_first_reason(errors.MAVEN_GOAL)}, {_first_reason(errors.MAVEN_POM)})"
_GRADLE = f"{_all(errors.GRADLE_BLOCK, 1)}[1]"
_ANT = (
    f"CASE WHEN len(list_filter({_all(errors.ANT_BLOCK, 1)}, lambda b: contains(b, 'Compile failed; see the compiler error output for details'))) > 0"
    f" THEN {_chain('clean', errors.ANT_RULES)} END"
)
_COUNTED = " OR ".join(
    f"len(list_filter({_all(p, g)}, lambda n: CAST(n AS BIGINT) > 0)) > 0"
    for _, p in errors.TEST_COUNTS
    for g in range(1, p.count(r"(\d+)") + 1)
)
_SAID = " OR ".join(f"regexp_matches(clean, {_quoted(p)})" for _, p in errors.TEST_MESSAGES)
_TESTS = f"CASE WHEN {_COUNTED} OR {_SAID} THEN 'test_failure' END"
_LINES = "string_split(CASE WHEN ends_with(log, chr(10)) THEN log[:-2] ELSE log END, chr(10))"
_NOT_STARTED = (
    f"CASE WHEN contains(CASE WHEN {_LINES}[-1] = '' THEN {_LINES}[-2] ELSE {_LINES}[-1] END, 'Job is completed before starting')"
    " THEN 'job is completed before starting' END"
)
_REASON = f"coalesce({_NOT_STARTED}, {_MAVEN}, {_ANT}, {_TESTS})"

ERROR_REASON = f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_REASON} AS error_reason FROM l"


def _texts(t: Tables):
    cleaned = t["job_logs"].filter("log <> ''")
    return cleaned.withColumn("clean", errors.clean_log(F.col("log"))).withColumn("plain", errors.strip_stamps(F.col("log")))


@case("e03_log_cleaning", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, plain, clean, regexp_replace(log, {_quoted(r'\x1B\[[0-?]*[ -/]*[@-~]')}, '', 'g') AS unescaped FROM l")
def _(t: Tables):
    return _texts(t).select("repository", "job_id", "plain", "clean", testlogs.strip_escapes(F.col("log")).alias("unescaped"))


@case("e04a_not_started", f"SELECT repository, job_id, {_NOT_STARTED} AS reason FROM {{job_logs}} WHERE log <> ''")
def _(t: Tables):
    return t["job_logs"].filter("log <> ''").select("repository", "job_id", errors.not_started(F.col("log")).alias("reason"))


@case("e04b_maven_reason", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_MAVEN} AS reason FROM l")
def _(t: Tables):
    return _texts(t).select("repository", "job_id", errors.maven_reason(F.col("clean")).alias("reason"))


@case("e04c_gradle_message", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_GRADLE} AS gradle_message FROM l")
def _(t: Tables):
    return _texts(t).select("repository", "job_id", errors.gradle_message(F.col("clean")).alias("gradle_message"))


@case("e04d_ant_reason", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_ANT} AS reason FROM l")
def _(t: Tables):
    return _texts(t).select("repository", "job_id", errors.ant_reason(F.col("clean")).alias("reason"))


@case("e04e_failing_tests", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_TESTS} AS reason FROM l")
def _(t: Tables):
    return _texts(t).select("repository", "job_id", errors.failing_tests(F.col("clean")).alias("reason"))


@case("e04_error_reason", ERROR_REASON)
def _(t: Tables):
    return errors.with_error_reason(t["job_logs"].filter("log <> ''")).select("repository", "job_id", "error_reason")


def _found(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(plain, {_quoted(pattern)}) THEN regexp_extract(plain, {_quoted(pattern)}, 1) END"


_OS = f"trim({_found(logs.OPERATING_SYSTEM.replace('(?d)', ''))}, ' ' || chr(9) || chr(10) || chr(13))"
_IMAGE = _found(logs.RUNNER_IMAGE.replace("(?d)", ""))
_WARNINGS = " + ".join(f"len(regexp_extract_all(plain, {_quoted('(?i)' + m)}))" for m in [re.escape(w) for w in logs.WARNING_MARKS])
_RUNNER = f"CASE WHEN {_OS} IN ('Ubuntu', 'Windows', 'macOS') THEN 'gitHub-hosted runner' ELSE 'self-hosted runner' END"


@case("e06_runner_image", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_IMAGE} AS runner_image FROM l")
def _(t: Tables):
    return _texts(t).select("repository", "job_id", logs.runner_image(F.col("plain")).alias("runner_image"))


def _mentions(pattern: str, first: int) -> str:
    p = _quoted(pattern.replace("(?d)", ""))
    return (
        f"SELECT repository, job_id, unnest(regexp_extract_all(plain, {p}, 1)) AS action,"
        f" unnest(regexp_extract_all(plain, {p}, 2)) AS sha, {first} + unnest(range(len(regexp_extract_all(plain, {p}, 0)))) AS n FROM l"
    )


_ACTIONS = f"""
SELECT repository, job_id, action, arg_max(sha, n) AS sha
FROM ({_mentions(logs.DOWNLOADED_ACTION, 0)} UNION ALL {_mentions(logs.PACKAGED_ACTION, 1000000)}) GROUP BY 1, 2, 3"""


@case("e07_job_actions", f"WITH l AS ({_CLEAN}) {_ACTIONS}")
def _(t: Tables):
    used = _texts(t).select("repository", "job_id", logs.actions_used(F.col("plain")).alias("actions"))
    return jobs.job_actions(used)


@case("e09_log_warnings", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_WARNINGS} AS log_warn_nums FROM l")
def _(t: Tables):
    return _texts(t).select("repository", "job_id", logs.warning_count(F.lower("plain")).alias("log_warn_nums"))


@case("e10_operating_system", f"WITH l AS ({_CLEAN}) SELECT repository, job_id, {_OS} AS operation_system, {_RUNNER} AS runner_type FROM l")
def _(t: Tables):
    named = _texts(t).select("repository", "job_id", logs.operating_system(F.col("plain")).alias("operation_system"))
    return named.withColumn("runner_type", logs.runner_type(F.col("operation_system")))


FACTS_BODY = f"""
l AS ({_CLEAN}),
facts AS (SELECT repository, job_id, {_REASON} AS error_reason, {_IMAGE} AS runner_image, {_OS} AS operation_system,
  {_RUNNER} AS runner_type, CAST({_WARNINGS} AS BIGINT) AS log_warn_nums, plain <> '' AS has_text FROM l),
acts AS ({_ACTIONS})"""


@case("log_facts", f"WITH {FACTS_BODY} SELECT repository, job_id, error_reason, runner_image, operation_system, log_warn_nums, has_text, coalesce((SELECT string_agg(action || '=' || sha, ',' ORDER BY action) FROM acts a WHERE a.job_id = f.job_id AND a.repository = f.repository), '') AS actions FROM facts f")
def _(t: Tables):
    listed = F.transform("actions", lambda a: F.concat(a["action"], F.lit("="), a["sha"]))
    return jobs.log_facts(t["job_logs"]).withColumn("actions", F.array_join(listed, ","))


# -- tests ------------------------------------------------------------------------------------

_UNESCAPED = f"SELECT repository, job_id, regexp_replace(log, {_quoted(r'\x1B\[[0-?]*[ -/]*[@-~]')}, '', 'g') AS log FROM {{job_logs}} WHERE log <> ''"


def _numbers(framework: str, groups: list[int]) -> list[str]:
    pattern = _quoted(testlogs.FRAMEWORK_LINES[framework])
    return [f"coalesce(TRY_CAST(unnest(regexp_extract_all(log, {pattern}, {g})) AS BIGINT), 0)" for g in groups]


def _framework_lines(framework: str) -> str:
    """Rows (passed, failed, skipped) of every result line, by the published rule of the framework."""
    if framework == "junit-gradle":
        g = _numbers(framework, [1, 2, 3, 4])
        return f"SELECT repository, job_id, {g[0]} AS passed, {g[1]} + {g[2]} AS failed, {g[3]} AS skipped FROM u"
    wanted = {"junit-maven": (1, [2, 3], 4), "rspec": (1, [3], None), "cucumber-ruby": (1, [], None), "testunit": (1, [3], 7),
              "go test": (1, [3], None)}.get(framework, (1, [3], 4))
    total, failed, skipped = wanted
    bad = " + ".join(_numbers(framework, failed)) or "0"
    skip = _numbers(framework, [skipped])[0] if skipped else "0"
    return (
        f"SELECT repository, job_id, greatest(total - failed - skipped, 0) AS passed, failed, skipped FROM"
        f" (SELECT repository, job_id, {_numbers(framework, [total])[0]} AS total, {bad} AS failed, {skip} AS skipped FROM u)"
    )


def _sum_of(word: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(log, '(\\d+)\\s+{word}', 1), lambda n: CAST(n AS BIGINT))), 0)"


_PYTEST = f"SELECT repository, job_id, 'pytest' AS parser, {_sum_of('passed')} AS passed, {_sum_of('failed')} AS failed, {_sum_of('skipped')} AS skipped FROM u"
_BY_PARSER = f"SELECT * FROM ({_PYTEST}) WHERE passed + failed + skipped > 0 UNION ALL " + " UNION ALL ".join(
    f"SELECT repository, job_id, '{f}', sum(passed), sum(failed), sum(skipped) FROM ({_framework_lines(f)}) GROUP BY 1, 2 HAVING sum(passed + failed + skipped) > 0"
    for f in testlogs.FRAMEWORK_LINES
)


@case("c12_results_by_parser", f"""WITH u AS ({_UNESCAPED})
SELECT repository, job_id, parser, CAST(passed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed, CAST(skipped AS BIGINT) AS skipped FROM ({_BY_PARSER})""")
def _(t: Tables):
    found = testlogs.test_facts(t["job_logs"].filter("log <> ''"))
    read = found.select("repository", "job_id", F.explode_outer("results").alias("parser", "r")).filter("parser is not null")
    return read.select("repository", "job_id", "parser", "r.passed", "r.failed", "r.skipped")


_FRAMEWORK_OF = ["junit", "rspec", "testunit", "cucumber-ruby", "cucumber-java", "phpunit", "pytest", "unittest", "jest", "mocha"]
_PICK = "CASE job_id % 10 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FRAMEWORK_OF)) + " END"
_TOOL = "CASE WHEN job_id % 20 < 10 THEN 'java-maven' ELSE 'java-gradle' END"


@case("c12_test_results", f"""WITH u AS ({_UNESCAPED}), b AS ({_BY_PARSER}),
p AS (SELECT repository, job_id, CASE WHEN {_PICK} = 'junit' THEN replace({_TOOL}, 'java', 'junit') ELSE {_PICK} END AS parser FROM u)
SELECT p.repository, p.job_id, CAST(coalesce(passed, 0) AS BIGINT) AS passed, CAST(coalesce(failed, 0) AS BIGINT) AS failed, CAST(coalesce(skipped, 0) AS BIGINT) AS skipped
FROM p LEFT JOIN b USING (repository, job_id, parser)""")
def _(t: Tables):
    known = t["job_logs"].filter("log <> ''").select(
        "repository", "job_id", testlogs.strip_escapes(F.col("log")).alias("text"),
        testlogs.parser_name(F.expr(_PICK), F.expr(_TOOL)).alias("parser"),
    )
    read = known.select("repository", "job_id", testlogs.test_results(F.col("text"), F.col("parser")).alias("r"))
    return read.select("repository", "job_id", "r.*")


# -- commits, steps, pull requests --------------------------------------------------------------


def _kind(column: str, table: list[tuple[str, str]]) -> str:
    return f"CASE WHEN trim(coalesce({column}, '')) <> '' THEN coalesce({_chain(f'lower({column})', table)}, 'other') END"


COMMIT_KIND = _kind("message", rules.COMMIT_RULES)


@case("c21_commit_kind", f"SELECT repository, sha, {COMMIT_KIND} AS kind FROM {{commits}}")
def _(t: Tables):
    return t["commits"].select("repository", "sha", rules.commit_kind(F.col("message")).alias("kind"))


COMMIT_METRICS = f"""
WITH c AS (SELECT repository, sha, coalesce(regexp_matches(message, '#\\d+'), false) AS issue, {COMMIT_KIND} AS kind FROM {{commits}}),
f AS (SELECT DISTINCT repository, sha FROM {{commit_files}})
SELECT r.repository, r.run_id, coalesce(bool_or(c.issue), false) AS commit_message_issue_ref,
  count(f.sha) AS gh_commits_on_files_touched, coalesce(string_agg(DISTINCT c.kind, ',' ORDER BY c.kind), '') AS git_commit_attention,
  count(c.sha) AS git_commits
FROM {{runs}} r LEFT JOIN {{run_commits}} rc ON rc.repository = r.repository AND rc.run_id = r.run_id
LEFT JOIN c ON c.repository = rc.repository AND c.sha = rc.sha LEFT JOIN f ON f.repository = c.repository AND f.sha = c.sha GROUP BY 1, 2"""


@case("c20_commit_metrics", COMMIT_METRICS)
def _(t: Tables):
    return commits.commit_metrics(t["runs"], t["run_commits"], t["commits"], t["commit_files"])


_STEP_FAILED = "list_filter(steps, lambda s: s.conclusion = 'failure')[1].name"
FIRST_ERROR = _kind(_STEP_FAILED, rules.STEP_RULES)


@case("e11_first_error_step", f"SELECT repository, job_id, {FIRST_ERROR} AS gh_first_error_step FROM {{jobs}}")
def _(t: Tables):
    return t["jobs"].select("repository", "job_id", jobs.first_error_step(F.col("steps")).alias("gh_first_error_step"))


@case("e12_step_kind", f"SELECT repository, job_id, n AS step, {_kind('name', rules.STEP_RULES)} AS kind FROM (SELECT repository, job_id, unnest(range(len(steps))) AS n, unnest(list_transform(steps, lambda s: s.name)) AS name FROM {{jobs}})")
def _(t: Tables):
    steps = t["jobs"].select("repository", "job_id", F.posexplode("steps").alias("step", "s"))
    return steps.select("repository", "job_id", "step", rules.step_kind(F.col("s.name")).alias("kind"))


_WORDS = "len(regexp_extract_all(coalesce({}, ''), '\\S+'))"
_SCORE = f"""2 * {_WORDS.format('title')} + {_WORDS.format('body')}
  + CASE WHEN contains(coalesce(body, ''), '```') THEN 50 ELSE 0 END
  + CASE WHEN regexp_matches(coalesce(body, ''), '#|(?i:fixes|closes)') THEN 30 ELSE 0 END
  + CASE WHEN regexp_matches(coalesce(body, ''), 'https?://') THEN 20 ELSE 0 END"""

PULLS = f"""
WITH p AS (SELECT *, {_WORDS.format('body')} AS words, {_SCORE} AS score,
  row_number() OVER (PARTITION BY repository, head_sha ORDER BY list_pos, number) AS n FROM {{pull_requests}})
SELECT r.repository, r.run_id, p.number IS NOT NULL AS gh_is_pr, coalesce(p.comments, 0) AS gh_num_pr_comments,
  p.merge_commit_sha AS git_merged_with, p.number AS pr_number, CAST(coalesce(p.%s, 0) AS BIGINT) AS gh_pr_description_complexity
FROM {{runs}} r LEFT JOIN p ON p.repository = r.repository AND p.head_sha = r.head_sha AND p.n = 1"""


@case("c22_pull_request", PULLS % "words")
def _(t: Tables):
    return commits.pull_request_features(t["runs"], t["pull_requests"])


@case("c23_description_score", f"SELECT repository, number, CAST({_SCORE} AS BIGINT) AS score FROM {{pull_requests}}")
def _(t: Tables):
    return t["pull_requests"].select("repository", "number", commits.description_score().alias("score"))


# -- repositories -------------------------------------------------------------------------------

LANGUAGE = """
SELECT repository, language AS languages FROM (
  SELECT *, row_number() OVER (PARTITION BY repository ORDER BY bytes DESC, list_pos) AS n FROM {%s}) WHERE n = 1"""


@case("c05_dominant_language", LANGUAGE % "repo_languages")
def _(t: Tables):
    return repositories.dominant_language(t["repo_languages"])


_HAS = "bool_or(name IN ({}))"
BUILD_LANGUAGE = "SELECT repository, CASE " + " ".join(
    f"WHEN {_HAS.format(', '.join(_quoted(f) for f in files))} THEN '{language}'" for language, files in manifests.BUILD_FILES.items()
) + " END AS build_language FROM {repo_files} GROUP BY 1"


@case("c06_build_language", BUILD_LANGUAGE)
def _(t: Tables):
    return repositories.repository_build_language(t["repo_files"])


_ROOTED = "SELECT DISTINCT c.repository, c.path, c.content FROM {root_contents} c JOIN {repo_files} f ON f.repository = c.repository AND f.name = c.path"
_DECLARED = " UNION ".join(
    f"SELECT repository, {i} AS i, '{framework}' AS f FROM m WHERE path IN ({', '.join(_quoted(p) for p in files)})"
    f" AND regexp_matches(content, {_quoted(manifests.FRAMEWORK_MARKS[framework])})"
    for i, (framework, files) in enumerate(manifests.FRAMEWORK_FILES.items())
)
FRAMEWORKS = f"WITH m AS ({_ROOTED}), d AS ({_DECLARED}) SELECT repository, string_agg(f, ',' ORDER BY i) AS test_frameworks FROM d GROUP BY 1"


@case("c07_test_frameworks", FRAMEWORKS)
def _(t: Tables):
    return repositories.detected_frameworks(t["repo_files"], t["root_contents"])


_JSON = "CASE WHEN json_valid(content) THEN coalesce(len(json_keys(content, {})), 0) + coalesce(len(json_keys(content, {})), 0) ELSE 0 END"
COUNT = f"""CASE WHEN coalesce(content, '') = '' THEN 0
  WHEN path IN ('pom.xml', 'build.gradle', 'build.gradle.kts') THEN len(regexp_extract_all(content, '<dependency>|implementation|compile|api|testImplementation'))
  WHEN path = 'requirements.txt' THEN len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '#')))
  WHEN path = 'package.json' THEN {_JSON.format("'$.dependencies'", "'$.devDependencies'")}
  WHEN path = 'Gemfile' THEN len(regexp_extract_all(content, '(?m)^gem '))
  WHEN path = 'composer.json' THEN {_JSON.format("'$.require'", "'$.\"require-dev\"'")} ELSE 0 END"""
ROOT_DEPENDENCIES = f"WITH m AS ({_ROOTED}) SELECT repository, CAST(sum({COUNT}) AS BIGINT) AS dependencies_count FROM m WHERE path <> 'build.gradle.kts' GROUP BY 1"
_MANIFESTS = ", ".join(_quoted(p) for p in manifests.COMMIT_MANIFESTS)
MANIFEST_COUNTS = f"SELECT repository, sha, path, CAST({COUNT} AS BIGINT) AS n FROM {{file_contents}} WHERE path IN ({_MANIFESTS}) AND content <> ''"


@case("c08_root_dependencies", ROOT_DEPENDENCIES)
def _(t: Tables):
    return repositories.root_dependencies(t["repo_files"], t["root_contents"])


@case("c08_manifest_counts", MANIFEST_COUNTS)
def _(t: Tables):
    return repositories.manifest_counts(t["file_contents"])


_END = "chr(13) || chr(10) || '|' || chr(10)"
_LINE_COUNT = "CASE WHEN content IS NOT NULL THEN CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END END"
_EXTERNAL = " OR ".join(f"regexp_matches(content, {_quoted(p.replace('(?d)', ''))})" for p in manifests.EXTERNAL_MARKS)
NAMES = """
SELECT r.repository, r.run_id, w.name AS workflow_name, w.path FROM {runs} r LEFT JOIN (
  SELECT repository, id, arg_min(name, list_pos) AS name, arg_min(path, list_pos) AS path FROM {workflows} GROUP BY 1, 2) w
ON w.repository = r.repository AND w.id = r.workflow_id"""
WORKFLOW_FILE = f"""
WITH n AS ({NAMES})
SELECT r.repository, r.run_id, {_LINE_COUNT} AS workflow_size, coalesce({_EXTERNAL}, false) AS external_github_resource
FROM {{runs}} r JOIN n USING (repository, run_id) LEFT JOIN {{file_contents}} c ON c.repository = r.repository AND c.sha = r.head_sha AND c.path = n.path"""


@case("c04_workflow_names", NAMES)
def _(t: Tables):
    return runs.workflow_names(t["runs"], t["workflows"])


@case("c09_c25_workflow_file", WORKFLOW_FILE)
def _(t: Tables):
    named = runs.workflow_names(t["runs"], t["workflows"]).join(t["runs"].select("repository", "run_id", "head_sha"), ["repository", "run_id"])
    return repositories.workflow_file_facts(named, t["file_contents"])


@case("c09_line_count", f"SELECT repository, sha, path, {_LINE_COUNT} AS line_count FROM {{file_contents}}")
def _(t: Tables):
    return t["file_contents"].select("repository", "sha", "path", line_count(F.col("content")).alias("line_count"))


@case("c25_external_reference", f"SELECT repository, sha, path, coalesce({_EXTERNAL}, false) AS external FROM {{file_contents}}")
def _(t: Tables):
    return t["file_contents"].select("repository", "sha", "path", manifests.has_external_reference(F.col("content")).alias("external"))


REPOSITORY_FACTS = f"""
SELECT * FROM ({LANGUAGE % 'run_languages'}) FULL JOIN ({BUILD_LANGUAGE}) USING (repository)
FULL JOIN ({FRAMEWORKS}) USING (repository) FULL JOIN ({ROOT_DEPENDENCIES}) USING (repository)"""


def run_tables(t: Tables) -> dict:
    """The tables of a run feature extraction."""
    names = ["runs", "workflows", "repo_files", "root_contents", "file_contents", "commits", "run_commits", "commit_files",
             "java_symbols", "file_metrics", "pull_requests", "jobs", "job_logs"]
    return {n: t[n] for n in names} | {"repo_languages": t["run_languages"]}


@case("repository_facts", REPOSITORY_FACTS)
def _(t: Tables):
    return repository_facts(run_tables(t))


TEST_TOTALS = f"""
WITH u AS ({_UNESCAPED}), b AS ({_BY_PARSER}), f AS ({REPOSITORY_FACTS}),
p AS (SELECT repository, CASE WHEN split_part(test_frameworks, ',', 1) = 'junit' AND build_language IN ('java-maven', 'java-gradle')
  THEN replace(build_language, 'java', 'junit') ELSE split_part(test_frameworks, ',', 1) END AS parser FROM f),
s AS (SELECT j.repository, j.run_id, sum(passed) AS passed, sum(failed) AS failed, sum(skipped) AS skipped
  FROM {{jobs}} j JOIN p ON p.repository = j.repository JOIN b ON b.repository = j.repository AND b.job_id = j.job_id AND b.parser = p.parser GROUP BY 1, 2)
SELECT r.repository, r.run_id, CAST(coalesce(passed, 0) AS BIGINT) AS tests_passed, CAST(coalesce(failed, 0) AS BIGINT) AS tests_failed,
  CAST(coalesce(skipped, 0) AS BIGINT) AS tests_skipped, CAST(coalesce(passed + failed + skipped, 0) AS BIGINT) AS tests_total
FROM {{%s}} r LEFT JOIN s USING (repository, run_id)"""


@case("c12_test_totals", TEST_TOTALS % "tied_runs")
def _(t: Tables):
    return test_totals(t["tied_runs"], t["jobs"], t["job_logs"], repository_facts(run_tables(t)))
