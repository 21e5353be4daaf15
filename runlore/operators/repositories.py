"""Facts about a repository and its files that a run inherits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions.linecount import language_of, line_counts
from runlore.functions.manifests import (
    BUILD_FILES,
    COMMIT_MANIFESTS,
    FRAMEWORK_FILES,
    ROOT_MANIFESTS,
    build_language,
    declared_frameworks,
    dependency_count,
    has_external_reference,
)
from runlore.functions.values import line_count, truthy
from runlore.operators.runs import RUN_KEY

# Fixed value: answer for a repository without a known language.
NO_LANGUAGE = "No language found"


def dominant_language(repo_languages: DataFrame) -> DataFrame:
    """Language with the most bytes; the first listed one wins a tie."""
    return repo_languages.groupBy("repository").agg(
        F.max_by("language", F.struct("bytes", -F.col("list_pos"))).alias("languages")
    )


def repository_build_language(repo_files: DataFrame) -> DataFrame:
    """Build tool of each repository, from its root files."""
    markers = sorted({f for files in BUILD_FILES.values() for f in files})
    # only marker names are collected, so the set is bounded by their number
    named = F.collect_set(F.when(F.col("name").isin(markers), F.col("name")))
    return repo_files.groupBy("repository").agg(named.alias("__names")).select(
        "repository", build_language(F.col("__names")).alias("build_language")
    )


def _root_contents(repo_files: DataFrame, contents: DataFrame, names: list[str]) -> DataFrame:
    roots = repo_files.filter(F.col("name").isin(names)).select("repository", F.col("name").alias("path")).distinct()
    return contents.filter(F.col("path").isin(names)).join(roots, ["repository", "path"], "left_semi")


def detected_frameworks(repo_files: DataFrame, contents: DataFrame) -> DataFrame:
    """Test frameworks declared by the root manifests, in the fixed order of frameworks.

    ``contents`` holds the manifests of the default branch: repository, path, content.
    """
    manifests = sorted({f for files in FRAMEWORK_FILES.values() for f in files})
    declared = (
        _root_contents(repo_files, contents, manifests)
        .filter(truthy(F.col("content")))
        .select("repository", F.explode_outer(declared_frameworks(F.col("content"), F.col("path"))).alias("f"))
        .filter(F.col("f").isNotNull())
    )
    found = declared.groupBy("repository").agg(F.array_sort(F.collect_set("f")).alias("f"))
    return found.select("repository", F.col("f.framework").alias("test_frameworks"))


def root_dependencies(repo_files: DataFrame, contents: DataFrame) -> DataFrame:
    """Dependencies of the root manifests, added up."""
    counted = _root_contents(repo_files, contents, ROOT_MANIFESTS).select(
        "repository", dependency_count(F.col("content"), F.col("path")).alias("n")
    )
    return counted.groupBy("repository").agg(F.sum("n").alias("dependencies_count"))


def manifest_counts(contents: DataFrame) -> DataFrame:
    """Dependencies of each non-empty manifest at each commit."""
    return (
        contents.filter(F.col("path").isin(COMMIT_MANIFESTS) & truthy(F.col("content")))
        .select("repository", "sha", "path", dependency_count(F.col("content"), F.col("path")).alias("n"))
    )


def workflow_file_facts(runs_with_path: DataFrame, contents: DataFrame) -> DataFrame:
    """Lines of the run's workflow file at its head commit, and whether it refers to other places.

    ``runs_with_path`` has repository, run_id, head_sha and path. Both facts are taken where the
    file is read; its text does not travel.
    """
    facts = contents.select(
        "repository",
        F.col("sha").alias("head_sha"),
        "path",
        line_count(F.col("content")).alias("workflow_size"),
        has_external_reference(F.col("content")).alias("__external"),
    )
    return (
        runs_with_path.select(*RUN_KEY, "head_sha", "path")
        .join(facts, ["repository", "head_sha", "path"], "left")
        .select(*RUN_KEY, "workflow_size", F.coalesce("__external", F.lit(False)).alias("external_github_resource"))
    )


def code_size(file_metrics: DataFrame) -> DataFrame:
    """Source lines of a commit, lines of its test files, and test lines per thousand source lines."""
    low = F.lower("path")
    tested = low.contains("test") | low.contains("spec")
    sized = file_metrics.groupBy("repository", "sha").agg(
        F.sum("code_lines").alias("gh_sloc"),
        F.coalesce(F.sum(F.when(tested, F.col("total_lines"))), F.lit(0)).alias("test_lines_initial"),
    )
    return sized.select(
        "repository",
        "sha",
        "gh_sloc",
        F.when(F.col("gh_sloc") != 0, F.col("test_lines_initial") / F.col("gh_sloc") * 1000).alias("gh_test_lines_per_kloc"),
        F.col("gh_sloc").alias("sloc_initial"),
        "test_lines_initial",
    )


def content_metrics(contents: DataFrame) -> DataFrame:
    """Lines of each file by kind, from its text: the table ``file_metrics`` where no line counter has made it.

    Files of an unknown language have no code lines, all their lines count as lines. The text stays where it
    is read.
    """
    counts = line_counts(F.col("content"), F.col("path"))
    zero = F.lit(0).cast("long")
    # one element exploded: the text is counted once for all columns
    counted = contents.select(
        "repository", "sha", "path", language_of(F.col("path")).alias("language"), line_count(F.col("content")).alias("total_lines"),
        F.explode(F.array(counts)).alias("c"),
    )
    return counted.select(
        "repository", "sha", "path", "language",
        *[F.coalesce(F.col("c")[n].cast("long"), zero).alias(f"{n}_lines") for n in ("code", "comment", "blank")],
        F.coalesce("total_lines", zero).alias("total_lines"),
    )
