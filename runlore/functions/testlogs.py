"""Test totals read from a log, by the test framework in use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.functions.values import has

# Result lines of the test frameworks.
FRAMEWORK_LINES = {
    "jest": r"Tests: (\d+) total, (\d+) passed, (\d+) failed, (\d+) skipped",
    "junit-gradle": r"Passed: (\d+), Failed: (\d+), Errors: (\d+), Skipped: (\d+)",
    "rspec": r"(\d+) examples?, (\d+) failures?(?:, (\d+) pending)?",
    "phpunit": r"Tests: (\d+), Assertions: (\d+), Failures: (\d+), Skipped: (\d+)",
    "nunit": r"Total tests: (\d+) - Passed: (\d+), Failed: (\d+), Skipped: (\d+)",
    "go test": r"PASS: (\d+), FAIL: (\d+), SKIP: (\d+)",
    "junit-maven": r"Tests run: (\d+), Failures: (\d+), Errors: (\d+), Skipped: (\d+)",
    "cucumber-ruby": (
        r"(\d+) scenarios? \((?:(\d+ skipped)(?:, )?)?(?:(\d+ undefined)(?:, )?)?(?:(\d+ failed)(?:, )?)?(?:(\d+ passed))?\)"
        r"[\s\S]*?(\d+) steps? \((?:(\d+ skipped)(?:, )?)?(?:(\d+ undefined)(?:, )?)?(?:(\d+ failed)(?:, )?)?(?:(\d+ passed))?\)"
    ),
    "cucumber-java": r"Tests run: (\d+), Failures: (\d+), Errors: (\d+), Skipped: (\d+)",
    "testunit": r"(\d+) tests, (\d+) assertions, (\d+) failures, (\d+) errors, (\d+) pendings, (\d+) omissions, (\d+) notifications",
}

# Which groups of a line hold the total, the failed and the skipped tests. A line without a total
# states the passed tests instead. Frameworks with neither a third nor a fourth number count as all
# passed.
_TOTAL_GROUPS = {
    "jest": (1, [3], [4]),
    "rspec": (1, [3], []),
    "phpunit": (1, [3], [4]),
    "nunit": (1, [3], [4]),
    "go test": (1, [3], []),
    "junit-maven": (1, [2, 3], [4]),
    "cucumber-ruby": (1, [], []),
    "cucumber-java": (1, [3], [4]),
    "testunit": (1, [3], [7]),
}
_PASSED_GROUPS = {"junit-gradle": (1, [2, 3], [4])}

# A literal that every result line of the framework contains.
_LITERALS = {
    "jest": "Tests: ",
    "junit-gradle": "Passed: ",
    "rspec": " example",
    "phpunit": "Assertions: ",
    "nunit": "Total tests: ",
    "go test": "PASS: ",
    "junit-maven": "Tests run: ",
    "cucumber-ruby": " scenario",
    "cucumber-java": "Tests run: ",
    "testunit": " notifications",
}

_RESULT = "struct<passed:bigint,failed:bigint,skipped:bigint>"


def _number(line: Column, pattern: str, group: int) -> Column:
    digits = F.regexp_extract(line, pattern, group)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def _total(numbers: Sequence[Column]) -> Column:
    return sum(numbers, F.lit(0).cast("bigint"))


def _line_results(text: Column, framework: str) -> Column:
    pattern = FRAMEWORK_LINES[framework]
    stated, failed_groups, skipped_groups = (
        _TOTAL_GROUPS.get(framework) or _PASSED_GROUPS[framework]
    )

    def of_line(line: Column) -> Column:
        first = _number(line, pattern, stated)
        failed = _total([_number(line, pattern, g) for g in failed_groups])
        skipped = _total([_number(line, pattern, g) for g in skipped_groups])
        passed = first
        if framework in _TOTAL_GROUPS:
            passed = F.greatest(first - failed - skipped, F.lit(0).cast("bigint"))
        return F.struct(passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"))

    results = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), of_line)
    empty = F.array().cast(f"array<{_RESULT}>")
    return F.when(has(text, _LITERALS[framework]), results).otherwise(empty)


def _summed(results: Column) -> Column:
    # one fold over the lines: naming ``results`` once keeps the regex from running once per column
    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("passed", "failed", "skipped")])
    return F.aggregate(
        results,
        zero,
        lambda s, r: F.struct(*[(s[n] + r[n]).alias(n) for n in ("passed", "failed", "skipped")]),
    )


def _pytest(text: Column) -> Column:
    # The parts of a pytest summary may stand in any order and alone, so each is summed by itself.
    def count(word: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(\d+)\s+{word}"), 1)
        total = F.aggregate(
            found,
            F.lit(0).cast("bigint"),
            lambda s, n: s + F.coalesce(n.try_cast("bigint"), F.lit(0).cast("bigint")),
        )
        return F.when(has(text, word), total).otherwise(F.lit(0).cast("bigint")).alias(word)

    return F.struct(count("passed"), count("failed"), count("skipped"))


def strip_escapes(log: Column) -> Column:
    """Remove terminal control sequences."""
    plain = F.regexp_replace(log, r"\x1B\[[0-?]*[ -/]*[@-~]", "")
    return F.when(log.contains("\x1b"), plain).otherwise(log)


def parser_name(framework: Column, build_language: Column) -> Column:
    """JUnit results are printed by the build tool, so the build language picks the parser."""
    name = F.lower(framework)
    return (
        F.when((name == "junit") & (build_language == "java-maven"), "junit-maven")
        .when((name == "junit") & (build_language == "java-gradle"), "junit-gradle")
        .otherwise(name)
    )


def test_results(text: Column, parser: Column) -> Column:
    """Struct (passed, failed, skipped) of a log without escapes; zeros for an unknown parser."""
    chain = F.when(parser == "pytest", _pytest(text).cast(_RESULT))
    for framework in FRAMEWORK_LINES:
        chain = chain.when(parser == framework, _summed(_line_results(text, framework)))
    zeros = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("passed", "failed", "skipped")])
    return F.coalesce(chain, zeros)


def results_by_parser(text: Column) -> Column:
    """Map from parser name to (passed, failed, skipped), for every parser that finds something.

    Lets a log be read before its framework is known, so that its text need not be joined.
    """
    found = {"pytest": _pytest(text).cast(_RESULT)}
    found |= {name: _summed(_line_results(text, name)) for name in FRAMEWORK_LINES}
    entries = F.array(
        *[F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in found.items()]
    )
    counted = F.filter(
        entries, lambda e: e["value"]["passed"] + e["value"]["failed"] + e["value"]["skipped"] > 0
    )
    return F.map_from_entries(counted)


def test_facts(job_logs: DataFrame) -> DataFrame:
    """Results by parser of each log: repository, job_id, results."""
    # the cleaned text is a step of its own, so that it is made once for all patterns
    cleaned = job_logs.select("repository", "job_id", strip_escapes(F.col("log")).alias("__text"))
    return cleaned.select("repository", "job_id", results_by_parser(F.col("__text")).alias("results"))
