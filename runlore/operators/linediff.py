"""Changed files of a commit, with added and deleted lines, from the contents of the commit and its parent."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.plans.pruning import likely
from runlore.session import cut_lineage

_FILE = ["repository", "sha", "path"]


def split_lines(content: Column) -> Column:
    """The lines of a text; a last line without its newline differs from the same line with one, as in git."""
    body = F.when(F.endswith(content, F.lit("\n")), F.expr("left(content, length(content) - 1)")).otherwise(F.concat(content, F.lit("\0")))
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def common_lines(old: Sequence[int], new: Sequence[int]) -> int:
    """Length of the longest common subsequence.

    Equal beginnings and ends are set aside. For the rest one integer holds a bit for each old line, and
    each new line changes all bits at once, so a step costs a word for 64 old lines and the memory is one bit a line.
    """
    ends = min(len(old), len(new))
    start = 0
    while start < ends and old[start] == new[start]:
        start += 1
    stop = 0
    while stop < ends - start and old[-1 - stop] == new[-1 - stop]:
        stop += 1
    old, new = old[start : len(old) - stop], new[start : len(new) - stop]
    at: dict[int, int] = {}
    for i, line in enumerate(old):
        at[line] = at.get(line, 0) | 1 << i
    whole = (1 << len(old)) - 1
    free = whole
    for line in new:
        met = free & at.get(line, 0)
        if met:
            free = ((free + met) | (free - met)) & whole
    return start + stop + len(old) - free.bit_count()


@F.pandas_udf(T.LongType())
def _common(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([common_lines(a.tolist(), b.tolist()) for a, b in zip(old, new)], dtype="int64")


def content_changes(commits: DataFrame, file_contents: DataFrame, limit: int | None = None) -> DataFrame:
    """(repository, sha, filename, status, added, deleted) of the files that differ from the commit's parent.

    ``file_contents`` has the whole tree of the commits to compare. ``status`` is A, D or M; a moved file is one
    of each. The lines are those of a smallest difference. A null content is no text and has no lines; it differs
    from any text. Commits without a parent have no changes. Of repeated rows for one file the one with the
    smallest hash counts. Unlike in a patch, lines that begin with ``++`` or ``--`` count as well.

    Files are compared by hashes first. Only of modified ones the lines are fetched, as 64-bit hashes made
    in the scan; no text is exchanged.
    """
    pairs = commits.filter("parent_sha IS NOT NULL").select("repository", "sha", "parent_sha").distinct()
    content = F.col("content")
    short = file_contents.dropna(subset=_FILE).select(
        *_FILE,
        F.struct(
            F.xxhash64("content", F.length("content")).alias("hash"),
            F.coalesce(F.size(split_lines(content)), F.lit(0)).cast("long").alias("lines"),
        ).alias("file"),
    )
    short = cut_lineage(short.groupBy(*_FILE).agg(F.min("file").alias("file")))
    new = pairs.join(short, ["repository", "sha"])
    old = pairs.join(short.withColumnRenamed("sha", "parent_sha"), ["repository", "parent_sha"])
    side = ["repository", "sha", "parent_sha", "path"]
    none = F.lit(None).cast(short.schema["file"].dataType)
    met = (
        new.select(*side, F.col("file").alias("new"), none.alias("old"))
        .unionByName(old.select(*side, none.alias("new"), F.col("file").alias("old")))
        .groupBy(*side)
        .agg(F.max("new").alias("new"), F.max("old").alias("old"))
        .filter(~F.col("new.hash").eqNullSafe(F.col("old.hash")))
    )
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    changed = cut_lineage(met.withColumn("status", status))
    modified = changed.filter("status = 'M'")
    versions = modified.select("repository", "sha", "path", F.col("new.hash").alias("hash")).unionByName(
        modified.select("repository", F.col("parent_sha").alias("sha"), "path", F.col("old.hash").alias("hash"))
    )
    hashed = F.transform(split_lines(content), lambda line: F.xxhash64(line))
    texts = likely(file_contents, versions, _FILE, limit).select(
        *_FILE, F.xxhash64("content", F.length("content")).alias("hash"),
        F.coalesce(hashed, F.array().cast("array<long>")).alias("lines"),
    )
    # read for both sides; made from texts, and exchanged to be made, twice otherwise
    texts = cut_lineage(texts.join(versions.distinct(), [*_FILE, "hash"]).groupBy(*_FILE).agg(F.min("lines").alias("lines")))
    compared = (
        modified.select(*side)
        .join(texts.withColumnRenamed("lines", "ours"), _FILE)
        .join(texts.withColumnsRenamed({"sha": "parent_sha", "lines": "theirs"}), ["repository", "parent_sha", "path"])
        .select("repository", "sha", "path", _common("theirs", "ours").alias("same"))
    )
    lines = lambda version: F.coalesce(f"{version}.lines", F.lit(0))
    same = F.coalesce("same", F.lit(0))
    return changed.join(compared, ["repository", "sha", "path"], "left").select(
        "repository", "sha", F.col("path").alias("filename"), "status",
        (lines("new") - same).alias("added"), (lines("old") - same).alias("deleted"),
    )
