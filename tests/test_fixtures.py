"""Operators on hand-written rows, one test per rule or quirk."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runlore.functions import errors, files, logs, manifests, rules, testlogs
from runlore.functions.values import line_count, lines, word_count
from runlore.operators import changes, commits, jobs, people, repositories, runs, slices


def ts(text):
    return datetime.fromisoformat(text) if text else None


RUNS = [
    (1, 7, "main", 10, "success", "2024-01-01 00:00:00", "2024-01-01 00:01:30"),
    (2, 7, "main", 10, "failure", "2024-01-10 00:00:00", None),
    (3, 8, "dev", 11, "failure", "2024-01-12 00:00:00", "2024-01-12 00:02:00"),
    (4, 7, "main", None, "success", "2024-01-29 00:00:00", "2024-01-29 00:00:10"),
]


@pytest.fixture
def four_runs(table):
    return table(
        "runs",
        [
            dict(
                repository="o/a", run_id=i, workflow_id=w, head_branch=b, head_sha=f"s{i}", conclusion=c,
                actor=(f"u{a}", a) if a else None, created_at=ts(t0), updated_at=ts(t1),
            )
            for i, w, b, a, c, t0, t1 in RUNS
        ],
    )


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expression(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("target", [None, 1])
def test_rates_trust_and_previous(four_runs, target):
    got = {r.run_id: r for r in runs.failure_history(four_runs, target_rows=target).collect()}
    want = {1: (0, 1, 0, 1), 2: (0.25, 0.678571, 0.25, 0.625), 3: (0.5, 0.416667, 0.5, 0.416667), 4: (0.5, 0.583333, 0, 1)}
    for i, w in want.items():
        assert [round(x, 6) for x in got[i][2:]] == pytest.approx(list(w), abs=1e-6)
    previous = {r.run_id: (r[2], r[3]) for r in runs.previous_run(four_runs, target_rows=target).collect()}
    assert previous == {1: (None, None), 2: (True, "success"), 3: (False, "failure"), 4: (False, "failure")}
    assert {r.run_id: r.build_duration for r in runs.build_duration(four_runs).collect()} == {1: 90, 2: None, 3: 120, 4: 10}
    assert {r.run_id: r.total_builds for r in runs.total_builds(four_runs, target_rows=target).collect()} == {4: 1, 3: 2, 2: 3, 1: 4}


def test_first_run_without_actor_has_no_previous(table):
    got = runs.previous_run(table("runs", [dict(repository="o/a", run_id=1, created_at=ts("2024-01-01"))])).first()
    assert (got.git_same_committer, got.gh_previous_build_result) == (None, None)


def test_run_without_time_is_last_and_has_no_rates(table, four_runs):
    more = four_runs.unionByName(table("runs", [dict(repository="o/a", run_id=9, conclusion="failure")]))
    assert {r.run_id: r.total_builds for r in runs.total_builds(more).collect()}[9] == 5
    got = {r.run_id: r.repo_fail_rate_history for r in runs.failure_history(more).collect()}
    assert got == {1: 0, 2: 0.2, 3: 0.4, 4: 0.4}  # it counts in the context only


def test_distinct_committers(table, four_runs):
    rows = [("a", "2023-10-01"), ("a", "2024-01-05"), ("b", "2023-12-30"), ("c", "2024-01-28 23:59:59"), ("d", "2024-01-29")]
    known = table("commits", [dict(repository="o/a", sha=f"c{i}", author_name=n, author_email="e", committed_at=ts(t)) for i, (n, t) in enumerate(rows)])
    for target in (None, 1):
        got = {r.run_id: (r[2], r[3]) for r in people.committer_counts(four_runs, known, target_rows=target).collect()}
        assert got == {1: (2, 1), 2: (2, 2), 3: (2, 2), 4: (3, 3)}


def test_core_member_needs_more_than_five_commits(table, four_runs):
    known = table("commits", [dict(repository="o/a", sha=f"c{i}", author_name="u11", author_email="e", committed_at=ts(f"2024-01-0{i + 1}")) for i in range(6)])
    got = {r.run_id: (r[2], r[3]) for r in people.committer_standing(four_runs, known).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (True, False), 4: (False, True)}


def test_cross_project_experience(spark, four_runs):
    counts = {"u10/a": 4, "u10/b": 4, "u10/c": 4, "u11/a": 4, "u11/b": 4, "u11/c": 3}
    listed = spark.createDataFrame([(r,) for r, n in counts.items() for _ in range(n)], "repository string")
    got = {r.run_id: r[2] for r in slices.cross_project_experience(four_runs, listed, 3, 3).collect()}
    assert got == {1: True, 2: True, 3: False, 4: None}  # more than three runs are needed


def test_hotspots(table, four_runs):
    run_commits = table("run_commits", [dict(repository="o/a", run_id=i, sha=f"s{i}") for i in (1, 2, 3, 4)])
    touched = table("commit_files", [dict(repository="o/a", sha=f"s{i}", filename=f) for i in (1, 2, 3, 4) for f in ("x", "y") if (i, f) != (2, "y")])
    hot = slices.hotspot_files(four_runs, run_commits, touched, "2024-01-29 00:00:00", min_total=4, min_rate=50).collect()
    assert [(r.filename, r.total, r.failures, r.failure_rate, r.success_rate) for r in hot] == [("x", 4, 2, 50.0, 50.0)]
    for target in (None, 1):
        got = slices.hotspot_touched(four_runs, four_runs, run_commits, touched, min_total=3, min_rate=40, target_rows=target)
        assert sorted(r.run_id for r in got.collect()) == [3, 4]


def test_same_files_as_previous(table, four_runs):
    known = table("commits", [dict(repository="o/a", sha=f"s{i}") for i in (1, 2)])
    touched = table("commit_files", [dict(repository="o/a", sha="s1", filename="x"), dict(repository="o/a", sha="s2", filename="x")])
    got = {r.run_id: r[2] for r in commits.same_files_as_previous(four_runs, known, touched).collect()}
    assert got == {1: None, 2: True, 3: None, 4: None}  # the head of run 4 is unknown


KINDS = {
    "src/test/A.java": "test", "latest.py": "test", "src/A.java": "production", "pom.xml": "production", "requirements.txt": "doc",
    "docs/x.rst": "doc", "build.gradle": "config", ".github/workflows/ci.yml": "config", "LICENSE": "other", "guide/a": "doc",
    "x.HTML": "other", "help.HTML": "doc", "a.PY": "other", "Spec.md": "test",
}


@pytest.mark.parametrize("path", KINDS)
def test_file_kind(spark, path):
    assert one(spark, path, files.file_kind) == KINDS[path]


@pytest.mark.parametrize(("path", "suffix"), [("a/b.tar.GZ", ".gz"), (".gitignore", ""), ("a/.x.py", ".py"), ("a.b/c", ""), ("x.", "")])
def test_file_suffix(spark, path, suffix):
    assert one(spark, path, files.file_suffix) == suffix


def test_patch_lines_and_entropy(spark, table):
    assert one(spark, "+++ b\n+a\n+\n ctx\n-x\n--- a\n--", files.lines_added) == 2
    assert one(spark, "+++ b\n+a\n-x\n--- a\n--\n-", files.lines_deleted) == 3
    rows = [dict(repository="o/a", sha="s", filename=f, status="M") for f in ("a.java", "b.java", "c.py", "x/d.py")]
    rows += [dict(repository="o/a", sha="t", filename=f"f{i}.java", status="A") for i in range(4)]
    got = {r.sha: r for r in changes.diff_stats(table("commit_files", rows)).collect()}
    assert (got["s"].gh_files_entropy, got["t"].gh_files_entropy) == (1.0, 0.0)
    assert (got["s"].gh_files_modified, got["t"].gh_files_added, got["s"].gh_cross_module_changes) == (4, 4, 1)


def test_docker_names_are_case_sensitive_by_default(table):
    rows = table("commit_files", [dict(repository="o/a", sha="s", filename="Dockerfile")])
    assert changes.diff_stats(rows).first().dockerfile_changed == 0
    assert changes.diff_stats(rows, case_insensitive_docker=True).first().dockerfile_changed == 1


def test_symbol_diff(table):
    known = table("commits", [dict(repository="o/a", sha="h", parent_sha="b")])
    touched = table("commit_files", [dict(repository="o/a", sha="h", filename=f) for f in ("src/A.java", "src/New.java", "x.py")])

    def symbol(sha, path, kind, name, cls=None, sig=None, body=None, position=0):
        return dict(repository="o/a", sha=sha, path=path, kind=kind, name=name, class_name=cls, signature=sig, body_hash=body, position=position)

    a, n = "src/A.java", "src/New.java"
    symbols = table("java_symbols", [
        symbol("b", a, "class", "A"), symbol("h", a, "class", "A"), symbol("b", a, "class", "Old"),
        symbol("b", a, "method", "m", "A", "()", "1"), symbol("h", a, "method", "m", "A", "(int)", "1"),
        symbol("b", a, "method", "k", "A", "()", "1"), symbol("h", a, "method", "k", "A", "()", "2"),
        # overloads: the last declaration stands for the name
        symbol("b", a, "method", "o", "A", "()", "1", 1), symbol("b", a, "method", "o", "A", "(x)", "9", 2), symbol("h", a, "method", "o", "A", "(x)", "9"),
        symbol("h", a, "method", "added", "A", "()", "1"), symbol("b", a, "field", "f", "A"), symbol("b", a, "method", "gone", "Old", "()", "1"),
        symbol("h", a, "import", "i.x"), symbol("h", n, "class", "New"), symbol("h", n, "method", "m", "New", "()", "1"),
    ])
    r = changes.symbol_diff(known, touched, symbols).first()
    assert (r.ast_class_added, r.ast_class_deleted, r.ast_class_modified, r.ast_class_changed) == (1, 1, 1, 3)
    assert (r.ast_met_added, r.ast_met_deleted, r.ast_met_sig_modified, r.ast_met_body_modified) == (1, 0, 1, 1)
    assert (r.ast_field_added, r.ast_field_deleted, r.ast_import_added, r.src_ast_diff, r.test_ast_diff) == (0, 1, 1, 1, 0)


def test_commit_and_step_kinds(spark):
    for message, kind in [("Fix crash #12", "fix"), ("Add feature", "feat"), ("", None), (" \t", None), ("prefix", "other"), ("fixé", "other"), ("docs and test", "test")]:
        assert one(spark, message, rules.commit_kind) == kind
    for name, kind in [("Setup JDK", "setup"), ("Run pytest", "test"), ("xyz", "other"), ("  ", None), (None, None)]:
        assert one(spark, name, rules.step_kind) == kind


LOG = (
    "2024-01-01T00:00:00.1Z ##[group]Operating System\n2024-01-01T00:00:00.1Z Ubuntu\n##[group]Runner Image\nImage: x\nVersion: 1.2.3\n"
    "Download action repository 'actions/cache@v4' (SHA:abc)\nDownload action repository 'actions/cache@v4' (SHA:def)\n"
    "Warning: a\n[WARN] b\ndeprecated\n"
)


def test_log_facts(spark):
    text = lambda f: one(spark, LOG, lambda c: f(errors.strip_stamps(c)))
    assert text(logs.operating_system) == "Ubuntu"
    assert text(logs.runner_image) == "1.2.3"
    assert text(lambda c: logs.warning_count(F.lower(c))) == 3
    assert [tuple(a) for a in text(logs.actions_used)] == [("actions/cache@v4", "def")]
    assert one(spark, "none", logs.operating_system) is None
    kinds = {s: one(spark, s, logs.runner_type) for s in ("Ubuntu", "Debian")} | {None: one(spark, None, logs.runner_type)}
    assert kinds == {"Ubuntu": logs.HOSTED, "Debian": logs.SELF_HOSTED, None: logs.SELF_HOSTED}


END = "Re-run Maven using the -X switch to enable full debug logging"
REASONS = {
    f"Failed to execute goal x\nCompilation failure\ncannot find symbol\n{END}": "compile failed due to cannot find symbol",
    f"Failed to execute goal x\n{END} Failed to execute goal y You have 3 Checkstyle violations {END}": "checkstyle violation detected",
    f"Failed to execute goal x Compilation failure, Java heap space {END}": "java heap space",
    f"Failed to execute goal x cannot find symbol {END}": None,
    "Tests run: 5, Failures: 1, Errors: 0, Skipped: 2": "test_failure",
    "Tests run: 5, Failures: 0, Errors: 00, Skipped: 2": None,
    "ok\nJob is completed before starting": "job is completed before starting",
    "ok\nJob is completed before starting\n\n": "job is completed before starting",
    "ok\nJob is completed before starting\n\n\n": None,
    "* What went wrong:\nbad\n* Try:": None,
    "\n": None,
    "": None,
}


@pytest.mark.parametrize("log", REASONS)
def test_error_reason(spark, log):
    df = spark.createDataFrame([(log,)], "log string")
    assert errors.with_error_reason(df).first().error_reason == REASONS[log]


@pytest.mark.parametrize(
    ("framework", "tool", "text", "want"),
    [
        ("junit", "java-maven", "Tests run: 5, Failures: 1, Errors: 0, Skipped: 2", (2, 1, 2)),
        ("junit", "java-gradle", "Passed: 3, Failed: 1, Errors: 1, Skipped: 4", (3, 2, 4)),
        ("junit", "ruby", "Tests run: 5, Failures: 1, Errors: 0, Skipped: 2", (0, 0, 0)),
        ("pytest", None, "1 failed, 2 passed, 3 skipped", (2, 1, 3)),
        ("rspec", None, "10 examples, 1 failure, 2 pending", (8, 2, 0)),
        ("Jest", None, "Tests: 9 total, 5 passed, 3 failed, 1 skipped", (5, 3, 1)),
        ("cucumber-ruby", None, "4 scenarios (1 failed, 3 passed)\n12 steps (1 failed, 11 passed)", (4, 0, 0)),
        ("testunit", None, "9 tests, 9 assertions, 2 failures, 0 errors, 0 pendings, 1 omissions, 3 notifications", (4, 2, 3)),
        ("unknown", None, "1 passed", (0, 0, 0)),
        (None, None, "1 passed", (0, 0, 0)),
    ],
)
def test_test_results(spark, framework, tool, text, want):
    df = spark.createDataFrame([(framework, tool, text)], "f string, b string, t string")
    parser = testlogs.parser_name(F.col("f"), F.col("b"))
    assert tuple(df.select(testlogs.test_results(F.col("t"), parser).alias("r")).first().r) == want


def test_manifests(spark, table):
    def count(path, content):
        df = spark.createDataFrame([(content, path)], "c string, p string")
        return df.select(manifests.dependency_count(F.col("c"), F.col("p")).alias("n")).first().n

    assert count("pom.xml", "<dependency> <dependency>") == 2
    assert count("build.gradle.kts", "implementation x\napi y\ntestImplementation z") == 3
    assert count("requirements.txt", "a\n\n# c\n  # d\n") == 2
    assert count("package.json", '{"dependencies": {"a": 1, "b": 2}, "devDependencies": {"c": 3}}') == 3
    assert count("package.json", "{broken") == 0
    assert count("composer.json", '{"require": {"a": 1}, "require-dev": {"b": 1}}') == 2
    assert count("Gemfile", "gem 'a'\n gem 'b'\ngem 'c'") == 2
    assert count("other", "api") == 0 and count("pom.xml", None) == 0
    tie = table("repo_languages", [dict(repository="o/a", language=l, bytes=5, list_pos=i) for i, l in enumerate("cab")])
    assert repositories.dominant_language(tie).first().languages == "c"


def test_texts(spark):
    assert one(spark, "a\r\nb\rc\n\n", lines) == ["a", "b", "c", ""]
    for text, n in [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("a\r\nb", 2), ("a\u2028b", 2)]:
        assert one(spark, text, line_count) == len(text.splitlines()) == n
    assert one(spark, " a  b\tc\u00a0d ", word_count) == 4


def test_previous_jobs(table):
    def job(i, run, name, started):
        return dict(repository="o/a", job_id=i, run_id=run, name=name, started_at=ts(started))

    # candidates are finished runs; run 6 was cancelled and lies between runs 2 and 4
    context = table("runs", [dict(repository="o/a", run_id=i, workflow_id=w, conclusion=c, created_at=ts(t)) for i, w, c, t in
                             [(1, 7, "success", "2023-11-01"), (2, 7, "failure", "2024-01-01"), (6, 7, "cancelled", "2024-01-02"),
                              (3, 8, "success", "2024-01-02"), (4, 7, "success", "2024-01-03"), (5, 7, None, "2024-01-04")]])
    listed = table("jobs", [job(10, 1, "t", "2023-11-01"), job(20, 2, "t", "2024-01-01 01:00"), job(40, 4, "t", "2024-01-03 01:00"),
                            job(41, 4, "t", "2024-01-03 02:00"), job(42, 4, "t", "2024-01-03 03:00"), job(50, 5, "other", "2024-01-04")])
    got = {r.job_id: r.prev_job_id for r in jobs.previous_jobs(listed, context).collect()}
    # 20: the run before is too old; 40: the workflow's run before; 41, 42: the attempt before; 50: no such job
    assert got == {10: None, 20: None, 40: 20, 41: 40, 42: 41, 50: None}
    chosen = listed.filter("job_id in (40, 42)")
    assert {r.job_id: r.prev_job_id for r in jobs.previous_jobs(listed, context, selected=chosen).collect()} == {40: 20, 42: 41}


def test_steps(spark):
    text = "[{'name': 'Set up', 'conclusion': 'success'}, {'name': 'Run pytest', 'conclusion': 'failure'}]"
    assert one(spark, text, lambda c: jobs.first_error_step(jobs.parsed_steps(c))) == "test"
    assert one(spark, "no list", lambda c: jobs.first_error_step(jobs.parsed_steps(c))) is None
