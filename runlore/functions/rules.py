"""Ordered text rules: the first pattern found in the text gives the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlore.functions.values import is_blank

# Commit kinds in order of precedence.
COMMIT_RULES = [
    ("fix", r"\bfix(e[ds])?\b|\bbug\b|\bhotfix\b|\bpatch\b"),
    ("test", r"\btest(s|ing)?\b|\bspec\b"),
    ("docs", r"\bdoc(s|umentation)?\b|\breadme\b"),
    ("refactor", r"\brefactor(ing)?\b|\bcleanup\b|\brestructure\b"),
    ("build", r"\bbuild\b|\bci\b|\bworkflow\b|\bgithub actions\b|\bpipeline\b"),
    ("perf", r"\bperf(ormance)?\b|\boptimi[sz]e\b"),
    ("feat", r"\bfeat(ure)?\b|\badd(ed|s|ing)?\b|\bimplement(ed|s|ing)?\b"),
    ("revert", r"\brevert(ed|s|ing)?\b"),
    ("chore", r"\bchore\b|\bbump\b|\bupgrade\b|\bdeps?\b"),
]

# Step kinds in order of precedence.
STEP_RULES = [
    ("checkout", r"\bcheckout\b"),
    ("setup", r"\bsetup\b|\binstall\b|\bprepare\b"),
    ("build", r"\bbuild\b|\bcompile\b|\bpackage\b"),
    ("test", r"\btest\b|\bpytest\b|\bjunit\b|\bunit\b|\bintegration\b"),
    ("lint", r"\blint\b|\bformat\b|\bstyle\b"),
    ("deploy", r"\bdeploy\b|\brelease\b|\bpublish\b"),
    ("cache", r"\bcache\b"),
    ("artifact", r"\bartifact\b|\bupload\b|\bdownload\b"),
    ("security", r"\bsecurity\b|\bscan\b|\bsast\b|\bcodeql\b"),
]


def first_match(text: Column, rules: Sequence[tuple[str, str]], flags: str = "") -> Column:
    """Label of the first (label, pattern) rule found in ``text``; null when none is."""
    chain = None
    for label, pattern in rules:
        hit = text.rlike(flags + pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def _classify(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    # (?U): word boundaries and classes follow Unicode, so accented letters belong to words
    label = first_match(F.lower(text), rules, "(?U)")
    return F.when(~is_blank(text), F.coalesce(label, F.lit("other")))


def commit_kind(message: Column) -> Column:
    """Kind of a commit from its message; null for a blank message."""
    return _classify(message, COMMIT_RULES)


def step_kind(name: Column) -> Column:
    """Kind of a job step from its name; null for a blank name."""
    return _classify(name, STEP_RULES)
