"""Facts read from a job log: runner image, operating system, actions, warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlore.functions.values import has

# Log lines written by the runner.
OPERATING_SYSTEM = r"(?d)##\[group\]Operating System\s*(.*?)(\n|$)"
RUNNER_IMAGE = r"(?d)##\[group\]Runner Image\s*.*?(?:\n|$)\s*Version: (.*?)(?:\n|$)"
DOWNLOADED_ACTION = r"(?d)Download action repository '(.*?)' \(SHA:(.*?)\)"
PACKAGED_ACTION = (
    r"(?d)##\[group\]Download immutable action package '(.*?)'\s*Version.*?(?:\n|$)"
    r"\s*Digest.*?(?:\n|$)\s*Source commit SHA: (.*?)(?:\n|$)"
)

# What counts as a warning, whatever its case.
WARNING_MARKS = ["warning:", "warn:", "[warn]", "[warning]", "deprecated"]

# Systems of hosted runners, and the two runner types.
HOSTED_SYSTEMS = ["Ubuntu", "Windows", "macOS"]
HOSTED = "gitHub-hosted runner"
SELF_HOSTED = "self-hosted runner"


def _found(text: Column, literal: str, pattern: str) -> Column:
    """First group of the first match; null without a match, '' for an empty group."""
    return F.when(
        has(text, literal) & text.rlike(pattern), F.regexp_extract(text, pattern, 1)
    )


def operating_system(text: Column) -> Column:
    name = _found(text, "##[group]Operating System", OPERATING_SYSTEM)
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def runner_image(text: Column) -> Column:
    return _found(text, "##[group]Runner Image", RUNNER_IMAGE)


def runner_type(system: Column) -> Column:
    return F.when(system.isin(HOSTED_SYSTEMS), HOSTED).otherwise(SELF_HOSTED)


def _times(text: Column, literal: str) -> Column:
    """How often a literal of plain ASCII stands in a text, by the bytes that go when it is taken out."""
    taken = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
    return F.when(has(text, literal), (taken / len(literal)).cast("long")).otherwise(0)


def warning_count(lowered: Column) -> Column:
    """Warnings in a lower-cased log. Literals are searched as they are, not as ignore-case regexes."""
    counts = [_times(lowered, mark) for mark in WARNING_MARKS]
    return sum(counts[1:], counts[0]).cast("long")


def action_mentions(text: Column) -> Column:
    """Array of (action, sha) in the order in which a later mention replaces an earlier one."""

    def mentions(literal: str, pattern: str) -> Column:
        # two searches of the text cost less than two for each mention
        parts = [F.regexp_extract_all(text, F.lit(pattern), group) for group in (1, 2)]
        pairs = F.arrays_zip(*parts).cast("array<struct<action:string,sha:string>>")
        empty = F.array().cast("array<struct<action:string,sha:string>>")
        return F.when(has(text, literal), pairs).otherwise(empty)

    return F.concat(
        mentions("Download action repository", DOWNLOADED_ACTION),
        mentions("##[group]Download immutable action package", PACKAGED_ACTION),
    )


def actions_used(text: Column) -> Column:
    """Actions of a log, each once with the SHA of its last mention, ordered by action."""
    return last_mentions(action_mentions(text))


def last_mentions(mentions: Column) -> Column:
    # Sorted by action, the latest mention of an action comes first; the fold keeps that one. The
    # sorted array is named once, so it is made once per log and not once per mention.
    numbered = F.transform(
        mentions, lambda m, i: F.struct(m["action"].alias("action"), (-i).alias("back"), m["sha"].alias("sha"))
    )
    empty = F.array().cast("array<struct<action:string,sha:string>>")

    def add(kept: Column, m: Column) -> Column:
        seen = F.try_element_at(kept, F.lit(-1))["action"].eqNullSafe(m["action"])
        entry = F.struct(m["action"].alias("action"), m["sha"].alias("sha"))
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(entry)))

    return F.aggregate(F.array_sort(numbered), empty, add)


def action_name(action: Column) -> Column:
    """The part of an action before '@'."""
    return F.trim(F.substring_index(action, "@", 1))
