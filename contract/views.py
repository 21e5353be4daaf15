"""The driver's tables seen as continuous-integration tables.

Each view is one SELECT that Spark and DuckDB both run; the few functions that differ come from a
dialect. ``{name}`` in a view's text stands for a driver table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

SPREAD = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


@dataclass(frozen=True)
class Dialect:
    us: Callable[[str], str]
    ts: Callable[[str], str]
    idiv: Callable[[str, str], str]
    struct: Callable[..., str]
    array: Callable[..., str]
    explode: Callable[..., str]


SPARK = Dialect(
    us=lambda e: f"unix_micros(CAST({e} AS TIMESTAMP))",
    ts=lambda e: f"timestamp_micros({e})",
    idiv=lambda a, b: f"(({a}) div ({b}))",
    struct=lambda **f: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in f.items()) + ")",
    array=lambda *e: "array(" + ", ".join(e) + ")",
    explode=lambda *e: "explode(array(" + ", ".join(e) + "))",
)
DUCKDB = Dialect(
    us=lambda e: f"epoch_us({e})",
    ts=lambda e: f"make_timestamp({e})",
    idiv=lambda a, b: f"(({a}) // ({b}))",
    struct=lambda **f: "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in f.items()) + ")",
    array=lambda *e: "[" + ", ".join(e) + "]",
    explode=lambda *e: "unnest([" + ", ".join(e) + "])",
)

NL = "chr(10)"
ESC = "chr(27)"


def text(e: str) -> str:
    return f"CAST({e} AS STRING)"


def repository(number: str) -> str:
    return f"'org/r' || {text(f'{number} % 5')}"


def job_id(d: Dialect) -> str:
    day = d.idiv(d.us("l_shipdate"), "86400000000")
    return (
        "((l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000) * 1000000"
        f" + (l_partkey * 31 + l_suppkey * 7919 + {day}) % 1000000"
    )


def runs(d: Dialect) -> str:
    return f"""
SELECT {repository('user_id')} AS repository, event_id AS run_id, event_id % 7 AS workflow_id,
  'wf' || {text('event_id % 7')} AS name,
  'c' || {text('event_id - event_id % 5 + user_id % 5')} AS head_sha,
  CASE event_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' ELSE 'topic' END AS head_branch,
  'completed' AS status,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'cancelled' ELSE 'success' END AS conclusion,
  CASE event_id % 4 WHEN 0 THEN 'push' WHEN 1 THEN 'pull_request' WHEN 2 THEN 'schedule' ELSE 'workflow_dispatch' END AS event,
  CAST(1 + event_id % 2 AS INT) AS run_attempt,
  {d.ts(d.us('ts'))} AS created_at,
  CASE WHEN event_id % 11 <> 0 THEN {d.ts(d.us('ts') + ' + CAST(round(value * 100) AS BIGINT) * 10000')} END AS updated_at,
  CASE WHEN event_id % 13 <> 0 THEN {d.struct(login="'u' || " + text('user_id'), id='user_id')} END AS actor,
  CASE WHEN event_id % 17 <> 0 THEN {d.struct(timestamp=d.ts(d.us('ts') + ' - 3600000000'))} END AS head_commit
FROM {{events}}"""


def tied_runs(d: Dialect) -> str:
    """Runs with whole-day times, so that many share one."""
    return f"""
SELECT {repository('o_orderkey')} AS repository, o_orderkey AS run_id, o_custkey % 7 AS workflow_id,
  'wf' || {text('o_custkey % 7')} AS name, 'c' || {text('o_orderkey')} AS head_sha,
  CASE o_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' ELSE 'topic' END AS head_branch,
  'completed' AS status,
  CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' END AS conclusion,
  CASE o_orderkey % 2 WHEN 0 THEN 'push' ELSE 'pull_request' END AS event,
  CAST(1 AS INT) AS run_attempt,
  {d.ts(d.us('o_orderdate'))} AS created_at,
  {d.ts(d.us('o_orderdate') + ' + CAST(round(o_totalprice) AS BIGINT) * 1000')} AS updated_at,
  CASE WHEN o_orderkey % 19 <> 0 THEN {d.struct(login="'u' || " + text('o_custkey % 150'), id='o_custkey % 150')} END AS actor,
  {d.struct(timestamp=d.ts(d.us('o_orderdate')))} AS head_commit
FROM {{orders}}"""


def commits(d: Dialect) -> str:
    when = f"1696291200000000 + (o_orderkey * 7919 + o_custkey * 31) % 10368000 * 1000000"
    return f"""
SELECT {repository('o_orderkey')} AS repository, 'c' || {text('o_orderkey')} AS sha,
  CASE WHEN o_orderkey >= 5 AND o_orderkey % 23 <> 0 THEN 'c' || {text('o_orderkey - 5')} END AS parent_sha,
  'u' || {text('o_custkey % 150')} AS author_name,
  'u' || {text('o_custkey % 150')} || '@h' || {text('o_orderkey % 2')} || '.org' AS author_email,
  CASE WHEN o_custkey % 9 <> 0 THEN 'u' || {text('o_custkey % 150')} END AS author_login,
  CASE o_orderkey % 14
    WHEN 0 THEN 'Fix crash #' || {text('o_custkey')} WHEN 1 THEN 'Add feature for ' || o_orderpriority
    WHEN 2 THEN 'Update README' WHEN 3 THEN 'Refactoring of ' || o_orderstatus
    WHEN 4 THEN 'ci: new pipeline' WHEN 5 THEN 'Optimize loop' WHEN 6 THEN 'Revert "x"'
    WHEN 7 THEN 'bump deps (#' || {text('o_orderkey')} || ')' WHEN 8 THEN 'more testing'
    WHEN 9 THEN 'misc ' || o_orderpriority WHEN 10 THEN '  ' WHEN 11 THEN 'prefix # only'
    WHEN 12 THEN 'HOTFIX for build' END AS message,
  {d.ts(when)} AS committed_at
FROM {{orders}}"""


def run_commits(d: Dialect) -> str:
    """Head commit of a run, and for merges the two commits before it."""
    number = "CAST(substring(head_sha, 2) AS BIGINT)"
    return f"""
SELECT repository, run_id, 'c' || {text('n - back')} AS sha
FROM (SELECT repository, run_id, {number} AS n, {d.explode('0', '5', '10')} AS back FROM {{runs}}) r
WHERE back = 0 OR (n % 3 = 0 AND n >= back)"""


def commit_parents(d: Dialect) -> str:
    """A history with forks and merges, in stretches of forty commits of a repository; clocks are often wrong."""
    m = d.idiv("o_orderkey", "5")
    when = "1696291200000000 + (o_orderkey * 7919 + o_custkey * 31) % 10368000 * 1000000"
    back = f"CASE WHEN place = 1 THEN 15 WHEN m % 40 = 0 THEN NULL WHEN m % 4 = 3 THEN 10 ELSE 5 END"
    return f"""
SELECT {repository('n')} AS repository, 'c' || {text('n')} AS sha, 'c' || {text(f'n - {back}')} AS parent_sha,
  CAST(place AS INT) AS place, {d.ts('us')} AS committed_at
FROM (SELECT o_orderkey AS n, {m} AS m, {when} AS us, {d.explode('0', '1')} AS place FROM {{orders}}) o
WHERE place = 0 OR (m % 6 = 0 AND m % 40 >= 3)"""


def run_ranges(d: Dialect) -> str:
    """The head commit of a run and a commit some way before it, which may be missing or on another branch."""
    number = "CAST(substring(head_sha, 2) AS BIGINT)"
    return f"""
SELECT repository, run_id, head_sha,
  CASE WHEN run_id % 19 <> 0 THEN 'c' || {text(f'{number} - 5 * (run_id % 13 - 1)')} END AS base_sha
FROM {{runs}}"""


def commit_files(d: Dialect) -> str:
    return f"""
SELECT {repository('l_orderkey')} AS repository, 'c' || {text('l_orderkey')} AS sha,
  CASE p_size % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'docs/' WHEN 3 THEN '.github/workflows/'
    WHEN 4 THEN 'src/test/' WHEN 5 THEN 'docker/dockerfile.' WHEN 6 THEN 'docker-compose/' ELSE '' END
  || replace(p_name, ' ', '_')
  || CASE p_partkey % 13 WHEN 0 THEN '.java' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.yml' WHEN 4 THEN '.json'
    WHEN 5 THEN '.JAVA' WHEN 6 THEN '' WHEN 7 THEN '.xml' WHEN 8 THEN '.txt' WHEN 9 THEN '.tar.GZ' WHEN 10 THEN '.HTML'
    WHEN 11 THEN '.gradle' ELSE '.yaml' END AS filename,
  CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'D'
    WHEN l_returnflag = 'R' THEN 'R' ELSE 'M' END AS status,
  '--- a/f' || {NL} || '+++ b/f' || {NL} || ' same' || {NL}
  || repeat('+new' || {NL}, CAST(l_quantity AS INT) % 7) || repeat('-old' || {NL}, l_linenumber % 4) || '-' AS patch
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""


def jobs(d: Dialect) -> str:
    started = f"{d.us('l_shipdate')} + l_partkey % 1440 * 60000000"

    def step(name: str, conclusion: str) -> str:
        return d.struct(
            name=name, conclusion=conclusion, started_at=d.ts(d.us("l_shipdate")), completed_at=d.ts(d.us("l_shipdate") + " + 1000000")
        )

    failed = "CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END"
    steps = d.array(
        step("'Set up job'", "'success'"),
        step(
            "CASE l_partkey % 7 WHEN 0 THEN 'Run actions/checkout@v4' WHEN 1 THEN 'Install things' WHEN 2 THEN 'Compile'"
            " WHEN 3 THEN 'Run pytest' WHEN 4 THEN 'xyz' WHEN 5 THEN 'Upload it' ELSE ' ' END",
            failed,
        ),
        step("'Publish'", "CASE WHEN l_linestatus = 'O' THEN 'failure' ELSE 'skipped' END"),
    )
    return f"""
SELECT {repository('l_orderkey')} AS repository, {job_id(d)} AS job_id, l_orderkey AS run_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'Unit Tests' WHEN 2 THEN 'lint' ELSE 'package' END AS name,
  'completed' AS status, {failed} AS conclusion,
  {d.ts(d.us('l_shipdate'))} AS created_at,
  CASE WHEN l_partkey % 23 <> 0 THEN {d.ts(started)} END AS started_at,
  CASE WHEN l_partkey % 29 <> 0 THEN {d.ts(started + ' + CAST(l_quantity AS BIGINT) * 60500000')} END AS completed_at,
  CAST(1 AS INT) AS run_attempt,
  CASE WHEN l_partkey % 31 <> 0 THEN {steps} END AS steps,
  {d.array("'ubuntu-latest'", "l_linestatus")} AS labels,
  'runner-' || {text('l_suppkey % 10')} AS runner_name, 'default' AS runner_group_name
FROM {{lineitem}}"""


def job_logs(d: Dialect) -> str:
    stamp = "'2024-03-01T10:00:00.1234567Z '"

    def line(*parts: str) -> str:
        return " || ".join([stamp, *parts, NL])

    def plain(*parts: str) -> str:
        return " || ".join([*parts, NL])

    def when(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE '' END"

    end = "'Re-run Maven using the -X switch to enable full debug logging'"
    k, o, q = "l_partkey", "l_orderkey", "CAST(l_quantity AS INT)"
    failures = [
        plain("'Failed to execute goal x: Compilation failure'") + " || " + plain("'A.java: ' || " + ESC + " || '[31mcannot' || " + ESC + " || '[0m find symbol'") + " || " + plain(end),
        plain("'FAILED TO EXECUTE GOAL y: Compilation failure'") + " || " + plain("'incompatible types: String cannot be converted to int'") + " || " + plain(end),
        plain("'Failed to execute goal z: You have '", text(q), "' Checkstyle violations'") + " || " + plain(end),
        plain("'Failed to execute goal z: nothing known'") + " || " + plain(end) + " || " + plain("'Failed to execute goal w: Java heap space'") + " || " + plain(end),
        plain("'Some problems were encountered while processing the POMs: EOFException'") + " || " + plain(end),
        plain("'* What went wrong:'") + " || " + plain("'Execution failed for task '", text(k)) + " || " + plain("'* Try:'"),
        plain("'BUILD FAILED'") + " || " + plain("'Compile failed; see the compiler error output for details.'") + " || " + plain("'Total time: 3 seconds'") + " || " + plain("'error: incompatible types: incompatible parameter types in lambda expression'"),
        plain("'BUILD FAILED'") + " || " + plain("'Total time: 3 seconds'"),
        plain("'Tests run: 5, Failures: '", text("l_linenumber % 2"), "', Errors: 0, Skipped: 2'") + " || " + plain("'Tests run: 9, Failures: 0, Errors: '", text(f"{k} % 2"), "', Skipped: 1'"),
        plain("'=== '", text(f"{q} % 3"), "' failed, 4 passed, 1 warnings'"),
        plain("'3 passed, '", text(f"{q} % 5"), "' failed, 2 skipped in 3s'"),
        plain("'There are test failures'"),
        plain("'Please refer to /x/'", text(k), "' for the individual test results'"),
        plain("'Tests: '", text(f"{q} + 9"), "' total, 5 passed, 3 failed, 1 skipped'"),
        plain("'Passed: 5, Failed: '", text(f"{q} % 4"), "', Errors: 1, Skipped: 2'"),
        plain(text(q), "' examples, 1 failure, 2 pending'") + " || " + plain("'1 example, 0 failures'"),
        plain("'Tests: 9, Assertions: 12, Failures: '", text(f"{q} % 3"), "', Skipped: 1'"),
        plain("'4 scenarios (1 failed, 3 passed)'") + " || " + plain(text(q), "' steps (1 failed, 9 passed)'"),
        plain(text(q), "' tests, 9 assertions, 2 failures, 0 errors, 0 pendings, 1 omissions, 3 notifications'"),
        plain("'all good'"),
    ]
    choose = f"CASE ({o} * 7 + {k}) % {len(failures)} " + " ".join(
        f"WHEN {i} THEN {body}" for i, body in enumerate(failures)
    ) + " ELSE '' END"
    os = when(f"{o} % 6 <> 5", line("'##[group]Operating System'") + " || " + line(f"CASE {o} % 6 WHEN 0 THEN 'Ubuntu' WHEN 1 THEN 'Windows' WHEN 2 THEN 'macOS' WHEN 3 THEN 'Debian ' ELSE 'Ubuntu' END"))
    image = when(f"{o} % 7 <> 6", line("'##[group]Runner Image'") + " || " + line("'Image: base'") + " || " + line("'Version: 1.'", text(f"{k} % 3"), "'.0'"))

    def action(name: str, sha: str) -> str:
        return line(f"'Download action repository ''{name}'' (SHA:'", text(sha), "')'")

    actions = " || ".join([
        when(f"{k} % 8 <> 7", action("actions/checkout@v4", f"{k} % 3")),
        when(f"{k} % 2 = 0", action("actions/cache@v4", f"{o} % 2")),
        when(f"{k} % 5 = 0", line(f"'Download action repository ''org/r' || {text(k + ' % 9')} || '@v1'' (SHA:7)'")),
        when(f"{k} % 9 = 0", action("actions/upload-artifact@v4", "1")),
        when(f"{k} % 4 = 0", action("actions/checkout@v4", f"10 + {o} % 2")),
        when(f"{k} % 6 = 0", line("'##[group]Download immutable action package ''org/r1@v3'''") + " || " + line("'Version: 3'") + " || " + line("'Digest: sha256:0'") + " || " + line("'Source commit SHA: '", text(f"{k} % 4"))),
    ])
    warnings = f"repeat('Warning: slow' || {NL}, {q} % 4) || repeat('[WARN] deprecated' || {NL}, l_linenumber % 2) || repeat('[2024-01-01 00:00:00] [autobuild] x [warning] warn: y' || {NL}, {k} % 2)"
    last = when(f"{k} % 37 = 0", f"'Job is completed before starting' || " + when(f"{k} % 2 = 0", NL))
    return f"""
SELECT {repository('l_orderkey')} AS repository, {job_id(d)} AS job_id,
  CASE WHEN l_partkey % 41 = 0 THEN '' WHEN l_partkey % 43 <> 0 THEN
  {os} || {image} || {actions} || {warnings} || {choose} || {last} END AS log
FROM {{lineitem}}"""


def pull_requests(d: Dialect) -> str:
    return f"""
SELECT {repository('conv_id')} AS repository, 'c' || {text('conv_id')} AS head_sha,
  conv_id * 100 + turn AS number,
  role || ' asks' AS title,
  CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || ' fixes #1' WHEN 2 THEN text || ' ```x``` see https://x.org'
    WHEN 3 THEN 'Closes it' END AS body,
  CASE WHEN turn % 2 = 0 THEN 'm' || {text('conv_id')} END AS merge_commit_sha,
  turn AS comments, CAST(8 - turn AS INT) AS list_pos
FROM {{conversations}}"""


def workflows(d: Dialect) -> str:
    """Workflows of the repositories; some ids are listed twice, one is missing."""
    return f"""
SELECT {repository('n_nationkey')} AS repository, CAST(n_nationkey % 6 AS BIGINT) AS id,
  'Workflow ' || n_name AS name, '.github/workflows/w' || {text('n_nationkey % 6')} || '.yml' AS path,
  CAST(n_nationkey * 2 + source AS INT) AS list_pos
FROM (SELECT n_nationkey, n_name, 0 AS source FROM {{nation}} UNION ALL SELECT s_suppkey, s_name, 1 FROM {{supplier}}) n"""


def file_contents(d: Dialect) -> str:
    """Manifests of the commits, and documents as workflow files."""
    c = "o_custkey"
    dependency = "'<dependency> x'"
    parts = [
        ("pom.xml", f"repeat({dependency} || {NL}, CAST({c} % 4 AS INT)) || 'junit'"),
        ("build.gradle", f"repeat('implementation y' || {NL}, CAST({c} % 3 AS INT)) || 'compile z' || {NL} || 'cucumber-java'"),
        ("build.gradle.kts", f"repeat('api y' || {NL}, CAST({c} % 2 AS INT))"),
        ("requirements.txt", f"'# head' || {NL} || repeat('pytest==1' || {NL} || {NL} || ' # x' || {NL}, CAST({c} % 3 AS INT))"),
        ("package.json", f"CASE WHEN {c} % 7 = 0 THEN '[broken' ELSE '{{{{\"dependencies\": {{{{\"a\": \"1\", \"b\": \"2\"}}}}, \"devDependencies\": {{{{\"jest\": \"' || {text(c)} || '\"}}}}}}}}' END"),
        ("Gemfile", f"repeat('gem ''rspec''' || {NL}, CAST({c} % 5 AS INT)) || ' gem z'"),
        ("composer.json", f"'{{{{\"require\": {{{{\"phpunit/phpunit\": \"9\"}}}}' || CASE WHEN {c} % 2 = 0 THEN ', \"require-dev\": {{{{\"x\": \"1\", \"y\": \"2\"}}}}' ELSE '' END || '}}}}'"),
    ]
    # not every commit has every manifest: these rules leave gaps, as real repositories do
    keep = {"pom.xml": "o_orderkey % 10 < 7", "build.gradle": "o_orderkey % 3 > 0", "build.gradle.kts": "o_orderkey % 4 = 0",
            "requirements.txt": "o_orderkey % 4 > 0", "package.json": "o_orderkey % 8 > 1", "Gemfile": "o_orderkey % 6 > 2",
            "composer.json": "o_orderkey % 9 > 3"}
    body = "CASE path " + " ".join(f"WHEN '{path}' THEN {b}" for path, b in parts) + " END"
    kept = "CASE path " + " ".join(f"WHEN '{path}' THEN {condition}" for path, condition in keep.items()) + " END"
    paths = d.explode(*[f"'{path}'" for path, _ in parts])
    selects = [
        f"SELECT {repository('o_orderkey')} AS repository, 'c' || {text('o_orderkey')} AS sha, path, {body} AS content"
        f" FROM (SELECT o_orderkey, o_custkey, {paths} AS path FROM {{orders}}) o WHERE {kept}"
    ]
    selects.append(
        f"SELECT {repository('doc_id')} AS repository, 'c' || {text('doc_id')} AS sha,"
        f" '.github/workflows/w' || {text('doc_id % 7')} || '.yml' AS path,"
        f" CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || {NL} WHEN 2 THEN 'uses: https://github.com/a/b' || chr(13) || {NL} || text"
        f" WHEN 3 THEN 'uses: a/b/.github/workflows/x.yml@v1' ELSE 'uses: git@github.com:x.git' || {NL} || {NL} END AS content FROM {{documents}}"
    )
    return "\nUNION ALL\n".join(selects)


def root_contents(d: Dialect) -> str:
    """Manifests of the default branch: those of the newest commit that has any, per repository."""
    number = "CAST(substring(sha, 2, 20) AS BIGINT)"
    return f"""
SELECT f.repository, f.path, f.content FROM {{file_contents}} f
JOIN (SELECT repository, max({number}) AS newest FROM {{file_contents}} WHERE path NOT LIKE '.github%' GROUP BY 1) n
  ON n.repository = f.repository AND n.newest = CAST(substring(f.sha, 2, 20) AS BIGINT)
WHERE f.path NOT LIKE '.github%'"""


def repo_files(d: Dialect) -> str:
    names = ["pom.xml", "build.gradle", "Gemfile", "build.xml", "requirements.txt", "package.json", "composer.json", "README.md", "settings.gradle", "Rakefile"]
    pick = "CASE n_nationkey % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
    return f"SELECT {repository('(n_nationkey + n_regionkey)')} AS repository, {pick} AS name FROM {{nation}}"


def repo_languages(d: Dialect) -> str:
    return """
SELECT source AS repository, lang AS language, CAST(sum(n_chars) - sum(n_chars) % 20000 AS BIGINT) AS bytes,
  CAST(min(doc_id) AS INT) AS list_pos
FROM {documents} GROUP BY source, lang"""


def run_languages(d: Dialect) -> str:
    """Languages of the repositories that have runs."""
    return f"""
SELECT {repository('doc_id')} AS repository, lang AS language, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(min(doc_id) AS INT) AS list_pos
FROM {{documents}} GROUP BY 1, 2"""


def repositories(d: Dialect) -> str:
    return f"""
SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'actions/' || CASE s_suppkey % 3 WHEN 0 THEN 'checkout' WHEN 1 THEN 'cache' ELSE 'upload-artifact' END
    ELSE 'org/r' || {text('s_suppkey')} END AS repository,
  CASE min(s_nationkey) % 2 WHEN 0 THEN 'main' ELSE 'dev' END AS default_branch, bool_or(s_nationkey % 3 > 0) AS has_organization
FROM {{supplier}} GROUP BY 1"""


def file_metrics(d: Dialect) -> str:
    return f"""
SELECT {repository('l_orderkey')} AS repository, 'c' || {text('l_orderkey')} AS sha,
  CASE l_partkey % 4 WHEN 0 THEN 'src/Test' WHEN 1 THEN 'spec/x' ELSE 'src/m' END || {text('l_partkey')} || '.py' AS path,
  CAST(l_quantity AS BIGINT) - CASE WHEN l_orderkey % 50 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS code_lines,
  CAST(l_quantity AS BIGINT) + l_linenumber AS total_lines
FROM {{lineitem}}"""


def java_symbols(d: Dialect) -> str:
    """Symbols of Java files; the files are the changed .java files of the commit and of its child."""
    kinds = ["class", "class", "method", "method", "method", "field", "field", "import", "import"]
    entries = [d.struct(kind=f"'{k}'", p=str(i)) for i, k in enumerate(kinds, 1)]
    number = "CAST(substring(sha, 2) AS BIGINT)"
    return f"""
SELECT repository, sha, path, kind,
  CASE WHEN kind IN ('method', 'field') THEN 'C' || {text('h % 2')} END AS class_name,
  CASE kind WHEN 'class' THEN 'C' || {text('(h + p % 2 * h) % 3')} WHEN 'import' THEN 'i.' || {text('(h + p) % 4')}
    ELSE 'm' || {text('(h * p) % 5')} END AS name,
  '(' || {text('h % 3')} || ')' AS signature, 'b' || {text('(h + p) % 4')} AS body_hash, CAST(p AS INT) AS position
FROM (SELECT repository, sha, path, h, e.kind AS kind, e.p AS p FROM (
  SELECT repository, sha, path, h, {d.explode(*entries)} AS e FROM (
    SELECT repository, sha, filename AS path, {number} * 7 + length(filename) AS h
    FROM {{commit_files}} WHERE filename LIKE '%.java'
    UNION
    SELECT repository, 'c' || {text(number + ' - 5')}, filename, ({number} - 5) * 7 + length(filename)
    FROM {{commit_files}} WHERE filename LIKE '%.java' AND {number} % 4 <> 1
  ) f) g) s
WHERE h % p <> 1"""


def tasks(d: Dialect) -> str:
    """Tasks for the runs, some listed twice with another state."""
    return f"""
SELECT {repository('user_id')} AS repository, ' ' || {text('event_id')} || ' ' AS run_id,
  CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '' ELSE ' 0 ' END AS collected, event_type AS note, event_id * 2 AS row_number
FROM {{events}}
UNION ALL
SELECT {repository('user_id')}, {text('event_id')}, CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '2' END, 'again', event_id * 2 + 1
FROM {{events}} WHERE event_id % 5 = 0"""


VIEWS: dict[str, Callable[[Dialect], str]] = {
    f.__name__: f
    for f in (
        runs, tied_runs, commits, run_commits, commit_parents, run_ranges, commit_files, jobs, job_logs, pull_requests, workflows,
        file_contents, root_contents, repo_files, repo_languages, run_languages, repositories,
        file_metrics, java_symbols, tasks,
    )
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(_PLACEHOLDER.findall(sql)))


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over them, as a Spark DataFrame."""
    if name in DRIVER_TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # a table in one small file is one task; spread its rows before texts are built from them
        cores = spark.sparkContext.defaultParallelism
        if name in SPREAD and len(table.inputFiles()) < cores:
            table = table.repartition(cores, SPREAD[name])
        return table
    sql = VIEWS[name](SPARK)
    return spark.sql(sql, **{r: spark_view(spark, sf_dir, r) for r in references(sql)})


def oracle(body: str) -> str:
    """``body`` with the views it mentions as ``{name}`` put before it as common table expressions."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in DRIVER_TABLES or name in ordered:
            return
        sql = VIEWS[name](DUCKDB)
        for r in references(sql):
            add(r)
        ordered[name] = _resolve(sql)

    for r in references(body):
        add(r)
    text_ = _resolve(body).strip()
    if not ordered:
        return text_
    ctes = ",\n".join(f"{n} AS ({s.strip()})" for n, s in ordered.items())
    if text_.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text_[5:]}"
    return f"WITH {ctes}\n{text_}"


def _resolve(sql: str) -> str:
    return _PLACEHOLDER.sub(r"\1", sql).replace("{{", "{").replace("}}", "}")
