"""Lines of code from texts against a scan by characters; holes in what was fetched."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runlore.functions import linecount
from runlore.operators import repositories
from runlore.operators.ordered import NO_CUTS, find_cuts, running_extreme
from runlore.sources import history


def scanned(text, syntax):
    """(code, comment, blank) by going through the characters."""
    counts, closer, comment_open = [0, 0, 0], "", False
    for line in text.splitlines():
        code, at, begun_in = False, 0, closer
        if closer and closer in syntax.long:
            code = True
        while at < len(line):
            if closer:
                end = line.find(closer, at)
                if end < 0:
                    break
                at, closer = end + len(closer), ""
                continue
            mark = next((m for m in syntax.long if line.startswith(m, at)), None)
            block = next((b for b in syntax.blocks if line.startswith(b[0], at)), None)
            if mark:
                code, closer, at = True, mark, at + len(mark)
            elif block:
                closer, at = block[1], at + len(block[0])
            elif any(line.startswith(m, at) for m in syntax.line):
                break
            elif syntax.texts and line[at] in "\"'":
                quote, end = line[at], at + 1
                while end < len(line) and line[end] != quote:
                    end += 2 if line[end] == "\\" and "\\" in syntax.texts else 1
                if end < len(line) and (quote == "'" or '"' in syntax.texts):
                    code, at = True, end + 1
                else:
                    code, at = True, at + 1
            else:
                code = code or not line[at].isspace()
                at += 1
        kind = 2 if not line.strip() else 0 if code else 1
        counts[kind] += 1
    return tuple(counts)


PIECES = {
    "slashes": ["/*", "*/", "//", '"', "'", "a", " ", "\n", "\n", "/", "*", "\\", '"x"', "/* y */", "int b;"],
    "python": ['"""', "'''", "#", '"', "'", "a", " ", "\n", "\n", "def f():", '"x"', "\\"],
    "hashes": ["#", '"', "a", " ", "\n", "'#'", "key: v"],
    "markup": ["<!--", "-->", "<a>", " ", "\n", "\n", "-", '"'],
    "dashes": ["--", "/*", "*/", "'", "select", " ", "\n", "-", "'--'"],
    "styles": ["/*", "*/", "a {}", "\n", " ", "//"],
    "plain": ["a", " ", "\n", "#", "//"],
}
ENDING = {"slashes": "x/A.java", "python": "p/m.py", "hashes": "Gemfile", "markup": "d/pom.xml", "dashes": "q.sql", "styles": "s.css", "plain": "r.txt"}


def test_lines_equal_a_scan_by_characters(spark):
    pick, rows, want = random.Random(4), [], []
    for family, pieces in PIECES.items():
        for _ in range(250):
            text = "".join(pick.choice(pieces) for _ in range(pick.randrange(14)))
            rows.append((len(rows), ENDING[family], text))
            want.append(scanned(text, linecount.SYNTAX[family]))
    df = spark.createDataFrame(rows, "i int, path string, content string").repartition(4)
    got = df.select("i", linecount.line_counts(F.col("content"), F.col("path")).alias("c")).collect()
    wrong = [(rows[r.i][1:], tuple(r.c)[1:], want[r.i]) for r in got if tuple(r.c)[1:] != want[r.i]]
    assert not wrong, wrong[:5]


def test_metrics_of_odd_files(spark):
    rows = [("A.java", "/* a\n b */ int x;\n\n// c\n"), ("x.unknown", "a\nb"), ("b.py", None), ("c.py", ""), ("T.JAVA", "x\r\ny"), ("m.py", '"""\n# no\n"""\n# yes')]
    df = spark.createDataFrame([("o/a", "s", p, c) for p, c in rows], "repository string, sha string, path string, content string")
    got = {r.path: (r.language, r.code_lines, r.comment_lines, r.blank_lines, r.total_lines) for r in repositories.content_metrics(df).collect()}
    assert got == {
        "A.java": ("Java", 1, 2, 1, 4), "x.unknown": (None, 0, 0, 0, 2), "b.py": ("Python", 0, 0, 0, 0), "c.py": ("Python", 0, 0, 0, 0),
        "T.JAVA": ("Java", 2, 0, 0, 2), "m.py": ("Python", 3, 1, 0, 4),
    }
    assert repositories.code_size(repositories.content_metrics(df)).first().gh_sloc == 6


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_holes_are_what_no_fetch_covers(spark):
    pick, spans, needs = random.Random(9), [], []
    for r in ("o/a", "o/b"):
        for _ in range(15):
            start = pick.randrange(60)
            spans.append((r, at(start), at(start + pick.randrange(5))))
    spans += [("o/a", at(70), at(60)), ("o/a", None, at(1)), spans[0]]
    needs = [("o/a", at(-3), at(50)), ("o/a", at(10), at(12)), ("o/b", at(5), at(100)), ("o/c", at(1), at(2)), ("o/b", at(9), at(2))]
    got = history.inner_gaps(
        spark.createDataFrame(needs, "repository string, need_start timestamp, need_end timestamp"),
        spark.createDataFrame(spans, "repository string, span_start timestamp, span_end timestamp"),
    ).collect()
    found = {}
    for g in got:
        found.setdefault((g.repository, g.need_start, g.need_end), []).append((g.gap_start, g.gap_end))
    for r, lo, hi in needs[:4]:
        quarters, half = int((hi - lo).total_seconds() // 900), dt.timedelta(minutes=7)
        bare = {k for k in range(quarters) if not any(s[0] == r and s[1] and s[1] <= lo + k * dt.timedelta(minutes=15) + half <= s[2] for s in spans)}
        gaps = found.get((r, lo, hi), [])
        assert {k for k in range(quarters) if any(a <= lo + k * dt.timedelta(minutes=15) + half <= b for a, b in gaps)} == bare
        assert all(a < b for a, b in gaps) and len(gaps) == len(set(gaps))
    assert ("o/b", at(9), at(2)) not in found


@pytest.mark.parametrize("target", [None, 20])
def test_running_extreme_in_slices(spark, target):
    pick = random.Random(2)
    rows = [("a" if i % 5 else "b", i, pick.randrange(1000)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    cuts = find_cuts(df, ["k"], ["i"], target) if target else NO_CUTS
    got = {r.i: r.m for r in running_extreme(df, ["k"], ["i"], F.col("v"), "m", cuts=cuts).collect()}
    assert got == {i: max((v for k2, j, v in rows if k2 == k and j < i), default=None) for k, i, _ in rows}
