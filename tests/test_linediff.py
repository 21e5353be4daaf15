"""Line differences from contents against a plain table of common subsequences."""

import random

from runlore.operators.changes import diff_stats
from runlore.operators.linediff import common_lines, content_changes
from tests.test_selection import _exchanged


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_lines():
    pick = random.Random(3)
    for _ in range(600):
        a, b = ([pick.randrange(pick.choice([1, 3, 30])) for _ in range(pick.randrange(90))] for _ in range(2))
        assert common_lines(a, b) == plain(a, b)
        c = a[: len(a) // 2] + b[:5] + a[len(a) // 2 + 3 :]
        assert common_lines(a, c) == plain(a, c)
    # a long file, every second line changed
    long = list(range(40_000))
    assert common_lines(long, [x if x % 2 else -x - 1 for x in long]) == 20_000


def as_lines(text):
    if not text:
        return []
    return text[:-1].split("\n") if text.endswith("\n") else (text + "\0").split("\n")


def test_changes_match_plain_comparison(spark):
    pick = random.Random(5)

    def text():
        return "\n".join(pick.choice("abc+é") * pick.randrange(3) for _ in range(pick.randrange(9))) + pick.choice(["", "\n"])

    files = {(f"s{c}", f"f{p}"): pick.choice([text(), "same\n", "same\n", "", None]) for c in range(30) for p in range(6) if pick.random() < 0.8}
    rows = [("r", s, p, x) for (s, p), x in files.items()]
    rows += rows[:4] + [("r", None, "f", "x"), ("r", "s1", None, "x"), (None, "s1", "f", "x")]
    commits = [("r", f"s{c}", f"s{pick.randrange(c)}" if c else None) for c in range(30)]
    contents = spark.createDataFrame(rows, "repository string, sha string, path string, content string").selectExpr("*", "1 AS lines", "2 AS hash")
    known = spark.createDataFrame(commits + commits[:3], "repository string, sha string, parent_sha string")
    want = []
    for _, sha, parent in commits:
        for p in {p for s, p in files if s in (sha, parent)} if parent else ():
            new, old = files.get((sha, p), 0), files.get((parent, p), 0)
            if new == old:
                continue
            a, b = ([] if x in (0, None) else as_lines(x) for x in (old, new))
            same = plain(a, b) if new != 0 and old != 0 else 0
            want.append((sha, p, "A" if old == 0 else "D" if new == 0 else "M", len(b) - same, len(a) - same))
    for limit in (None, 3):
        got = content_changes(known, contents, limit)
        assert sorted(map(tuple, got.drop("repository").collect())) == sorted(want)
    totals = diff_stats(got).agg({"gh_lines_added": "sum", "gh_lines_deleted": "sum"}).first()
    assert set(totals) == {sum(w[3] for w in want), sum(w[4] for w in want)}
    assert content_changes(known, contents.limit(0)).collect() == []
    assert content_changes(known.limit(0), contents).collect() == []


def test_no_text_is_exchanged(spark):
    contents = spark.createDataFrame([("r", f"s{i}", "f", f"text {i}\n") for i in range(9)], "repository string, sha string, path string, content string")
    known = spark.createDataFrame([("r", f"s{i}", f"s{i - 1}") for i in range(1, 9)], "repository string, sha string, parent_sha string")
    passed = _exchanged(content_changes(known, contents, 2))
    assert "ours" in passed and "content" not in passed
