"""What the head commit of a run changed: files, lines, kinds, symbols, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.functions.files import (
    CONFIG,
    DOC,
    OTHER,
    PRODUCTION,
    TEST,
    file_kind,
    file_suffix,
    is_test_path,
    lines_added,
    lines_deleted,
    top_directory,
)
from runlore.session import cut_lineage

COMMIT_KEY = ["repository", "sha"]


def classified_files(commit_files: DataFrame) -> DataFrame:
    """Changed files with their kind, suffix and patch size; the patch itself is left behind.

    Columns ``added`` and ``deleted``, as ``content_changes`` gives them, stand in for a patch.
    """
    counted = "patch" not in commit_files.columns
    return commit_files.filter(F.col("filename") != "").select(
        *COMMIT_KEY,
        "filename",
        "status",
        file_kind(F.col("filename")).alias("kind"),
        file_suffix(F.col("filename")).alias("suffix"),
        top_directory(F.col("filename")).alias("top"),
        F.col("added") if counted else lines_added(F.col("patch")).alias("added"),
        F.col("deleted") if counted else lines_deleted(F.col("patch")).alias("deleted"),
    )


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _sum(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def diff_stats(commit_files: DataFrame, case_insensitive_docker: bool = False) -> DataFrame:
    """Counts, churn, entropy of suffixes and spread over directories of each commit.

    Aggregates by (commit, suffix) first, then by commit: the suffix counts give the entropy, and a
    commit with very many files is reduced before it meets a single task.
    """
    kind = F.col("kind")
    touched = F.col("added") + F.col("deleted")
    path = F.lower("filename") if case_insensitive_docker else F.col("filename")
    docker = path.contains("dockerfile")
    compose = path.contains("docker-compose") & ~docker
    sums = {
        "gh_files_added": _count(F.col("status") == "A"),
        "gh_files_deleted": _count(F.col("status") == "D"),
        "gh_files_modified": _count(~F.coalesce(F.col("status").isin("A", "D"), F.lit(False))),
        "gh_lines_added": F.sum("added"),
        "gh_lines_deleted": F.sum("deleted"),
        "gh_tests_added": _sum(kind == TEST, F.col("added")),
        "gh_tests_deleted": _sum(kind == TEST, F.col("deleted")),
        "gh_src_files": _count(kind == PRODUCTION),
        "gh_src_churn": _sum(kind == PRODUCTION, touched),
        "gh_doc_files": _count(kind == DOC),
        "gh_config_files": _count(kind == CONFIG),
        "gh_other_files": _count(kind == OTHER),
        "__docker": _count(docker),
        "__compose": _count(compose),
    }
    per_suffix = (
        classified_files(commit_files)
        .groupBy(*COMMIT_KEY, "suffix")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.min("top").alias("__top_min"),
            F.max("top").alias("__top_max"),
            *[e.alias(n) for n, e in sums.items()],
        )
    )
    per_commit = per_suffix.groupBy(*COMMIT_KEY).agg(
        F.count(F.lit(1)).alias("gh_files_type_modified"),
        F.sum("__n").alias("__files"),
        F.sum(F.col("__n") * F.log2(F.col("__n"))).alias("__weighted"),
        F.min("__top_min").alias("__top_min"),
        F.max("__top_max").alias("__top_max"),
        *[F.sum(n).alias(n) for n in sums],
    )
    entropy = F.log2("__files") - F.col("__weighted") / F.col("__files")
    return per_commit.select(
        *COMMIT_KEY,
        *[n for n in sums if not n.startswith("__")],
        (F.col("gh_tests_added") + F.col("gh_tests_deleted")).alias("gh_test_churn"),
        "gh_files_type_modified",
        F.round(F.greatest(entropy, F.lit(0.0)), 3).alias("gh_files_entropy"),
        (F.col("__top_min") != F.col("__top_max")).cast("int").alias("gh_cross_module_changes"),
        (F.col("__docker") > 0).cast("int").alias("dockerfile_changed"),
        (F.col("__compose") > 0).cast("int").alias("docker_compose_changed"),
    )


def _commit_pairs(commits: DataFrame) -> DataFrame:
    return commits.filter(F.col("parent_sha").isNotNull()).select(
        "repository", F.col("sha").alias("head"), F.col("parent_sha").alias("base")
    )


def symbol_changes(commits: DataFrame, commit_files: DataFrame, java_symbols: DataFrame) -> DataFrame:
    """Symbols of each changed Java file, one row per symbol of the head or the base commit.

    Symbols of both sides are stacked and grouped instead of joined: a group has one entry per
    declaration, and declarations of one name collapse to the last.
    """
    pairs = _commit_pairs(commits)
    changed = (
        commit_files.filter(F.col("filename").endswith(".java"))
        .select("repository", F.col("sha").alias("head"), F.col("filename").alias("path"))
        .distinct()
        .join(pairs, ["repository", "head"])
    )
    symbols = java_symbols.select(
        "repository",
        "sha",
        "path",
        "kind",
        F.when(F.col("kind") == "class", F.col("name")).otherwise(F.coalesce("class_name", F.lit(""))).alias("class_name"),
        "name",
        F.struct("position", "signature", "body_hash").alias("__d"),
    )

    def side(role: str) -> DataFrame:
        return symbols.withColumnRenamed("sha", role).join(changed, ["repository", role, "path"]).select(
            "repository",
            "head",
            "path",
            "kind",
            "class_name",
            "name",
            *[F.when(F.lit(role == r), F.col("__d")).alias(f"__{r}") for r in ("base", "head")],
        )

    # F.max of a struct compares position first, so it keeps the last declaration
    return (
        side("base")
        .unionByName(side("head"))
        .groupBy("repository", "head", "path", "kind", "class_name", "name")
        .agg(F.max("__base").alias("__base"), F.max("__head").alias("__head"))
    )


def symbol_diff(commits: DataFrame, commit_files: DataFrame, java_symbols: DataFrame) -> DataFrame:
    """Classes, methods, fields and imports added, deleted and changed by each commit.

    Members count only in classes that both sides have; 'modified' classes are those common classes.
    """
    kind = F.col("kind")
    old, new = F.col("__base"), F.col("__head")
    added = old.isNull() & new.isNotNull()
    deleted = old.isNotNull() & new.isNull()
    common = old.isNotNull() & new.isNotNull()
    other_signature = ~old["signature"].eqNullSafe(new["signature"])
    other_body = ~other_signature & ~old["body_hash"].eqNullSafe(new["body_hash"])
    in_class = F.when(kind == "import", "").otherwise(F.col("class_name"))

    per_class = (
        symbol_changes(commits, commit_files, java_symbols)
        .groupBy("repository", "head", "path", in_class.alias("in_class"))
        .agg(
            _count((kind == "class") & added).alias("class_added"),
            _count((kind == "class") & deleted).alias("class_deleted"),
            _count((kind == "class") & common).alias("class_modified"),
            _count((kind == "method") & added).alias("met_added"),
            _count((kind == "method") & deleted).alias("met_deleted"),
            _count((kind == "method") & common & other_signature).alias("met_sig_modified"),
            _count((kind == "method") & common & other_body).alias("met_body_modified"),
            _count((kind == "field") & added).alias("field_added"),
            _count((kind == "field") & deleted).alias("field_deleted"),
            _count((kind == "import") & added).alias("import_added"),
            _count((kind == "import") & deleted).alias("import_deleted"),
        )
    )
    shared = F.col("class_modified") > 0
    members = ["met_added", "met_deleted", "met_sig_modified", "met_body_modified", "field_added", "field_deleted"]
    others = ["class_added", "class_deleted", "class_modified", "import_added", "import_deleted"]
    per_file = per_class.groupBy("repository", "head", "path").agg(
        *[_sum(shared, F.col(c)).alias(c) for c in members],
        *[F.sum(c).alias(c) for c in others],
    )
    altered = (F.col("class_added") + F.col("class_deleted") + F.col("class_modified") > 0) | (
        F.col("met_added") + F.col("met_deleted") > 0
    )
    tested = is_test_path(F.col("path"))
    per_commit = per_file.groupBy("repository", F.col("head").alias("sha")).agg(
        *[F.sum(c).alias(c) for c in members + others],
        F.max((altered & ~tested & (file_kind(F.col("path")) == PRODUCTION)).cast("int")).alias("src_ast_diff"),
        F.max((altered & tested).cast("int")).alias("test_ast_diff"),
    )

    def total(*names: str) -> Column:
        return sum([F.col(n) for n in names[1:]], F.col(names[0]))

    return per_commit.select(
        *COMMIT_KEY,
        *[F.col(c).alias(f"ast_{c}") for c in others + members],
        total("class_added", "class_deleted", "class_modified").alias("ast_class_changed"),
        total("met_added", "met_deleted").alias("ast_met_changed"),
        total("field_added", "field_deleted").alias("ast_field_changed"),
        total("import_added", "import_deleted").alias("ast_import_changed"),
        "src_ast_diff",
        "test_ast_diff",
    )


def dependency_changes(commits: DataFrame, manifest_counts: DataFrame) -> DataFrame:
    """Per commit: manifests whose dependency count differs from the parent's, and the total count."""
    # read for both sides; made from texts, the counts cost more than their storage
    manifest_counts = cut_lineage(manifest_counts.select("repository", "sha", "path", "n"))
    head = manifest_counts.select("repository", F.col("sha").alias("head"), "path", F.col("n").alias("__now"))
    base = manifest_counts.select("repository", F.col("sha").alias("base"), "path", F.col("n").alias("__before"))
    compared = (
        _commit_pairs(commits).join(head, ["repository", "head"]).join(base, ["repository", "base", "path"], "left")
    )
    return compared.groupBy("repository", F.col("head").alias("sha")).agg(
        _count(F.col("__now") != F.col("__before")).alias("gh_dependencies_churn"),
        F.sum("__now").alias("dependencies_count"),
    )


def commit_change_features(
    commits: DataFrame,
    commit_files: DataFrame,
    java_symbols: DataFrame,
    manifest_counts: DataFrame,
    case_insensitive_docker: bool = False,
) -> DataFrame:
    """All change columns of each commit that has a parent; what a commit does not have is 0.

    The parts are stored one after the other, so the disk holds the exchanges of one of them at a time.
    """
    with_parent = _commit_pairs(commits).select("repository", F.col("head").alias("sha"))
    joined = (
        with_parent.join(cut_lineage(diff_stats(commit_files, case_insensitive_docker)), COMMIT_KEY, "left")
        .join(cut_lineage(symbol_diff(commits, commit_files, java_symbols)), COMMIT_KEY, "left")
        .join(cut_lineage(dependency_changes(commits, manifest_counts)), COMMIT_KEY, "left")
    )
    return joined.na.fill(0)
