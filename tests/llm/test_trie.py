"""The trie against one built turn by turn; the radix tree's layouts."""

import hashlib
import random
import re
import zlib

from runlore.llm import art, trie


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], ident(*t[2:])))] for c, ts in convs.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            node = nodes.setdefault(seq[:d], {"members": [], "ends": [], "kids": set()})
            node["members"].append(c)
            if d == len(seq):
                node["ends"].append(c)
            if d:
                nodes[seq[: d - 1]]["kids"].add(seq[:d])
    out = []
    for seq in sorted(nodes, key=len, reverse=True):
        node = nodes[seq]
        kids = [nodes[k] for k in node["kids"]]
        node["leaves"] = sum(k["leaves"] for k in kids) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        node["saved"] = (len(node["members"]) - 1) * words + sum(k["saved"] for k in kids)
        up = min(nodes[seq[:-1]]["members"]) if seq else None
        digest = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.append((min(node["members"]), len(seq), -1 if up is None else up, len(node["members"]), len(kids), node["leaves"], node["saved"], digest))
    return sorted(out)


def ident(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(df, target_rows=None, **more):
    steps, every = trie.rebuilt(df, target_rows=target_rows)
    rows = trie.trie(steps, every, target_rows=target_rows, **more).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


def some(seed, convs, turns, words):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(pick.randrange(turns)):
            rows.append((c, t, pick.choice(["user", "assistant"]), " ".join(pick.choice("ab") for _ in range(pick.randrange(words)))))
    pick.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = some(1, 150, 9, 3)
    want = brute(rows)
    df = frame(spark, rows).withColumn("name", trie.F.lit("x"))
    assert result(df) == want
    # ranges of a few strings and blocks of a few turns: nodes reach over both
    assert result(df, size=2, per_range=20) == want
    assert result(df, size=3, per_range=7) == want


def test_hot_and_long_conversations_and_copies(spark):
    rows = [(7, t, "user", f"w {t % 5}") for t in range(400)]
    rows += [(c, t, "user", "same words here") for c in range(100, 160) for t in range(6)]
    rows += [(c, t, "user", f"w {t % 5}") for c in (300, 301, 333) for t in range(390)]
    rows += some(2, 40, 4, 2)
    want = brute(rows)
    df = frame(spark, rows)
    assert result(df) == want
    assert result(df, target_rows=50, size=16, per_range=60) == want


def test_edge_cases(spark):
    rows = [(None, 1, "user", "x"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (1, None, "u", "b"), (1, 0, "u", "b"), (1, 0, "u", "c"),
            (21, 5, "u", "z " * 100_000), (45, 1, "us", "er"), (46, 1, "u", "ser"), (-5, 1, "a", "b"), (-20, 1, "a", "b"), (-20, 2, "é", "\U0001f388 b c")]
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, rows).limit(0)) == []
    alone = [(21, 0, "u", "x")] if zlib.crc32(b"21") % 4 else [(22, 0, "u", "x")]
    assert result(frame(spark, alone)) == brute(alone)
    kinds = [f.dataType.simpleString() for f in trie.op11(frame(spark, rows)).schema]
    assert kinds == ["bigint"] * 7 + ["string"]


def test_radix_tree_grows_and_splits():
    pick = random.Random(3)
    keys = sorted({bytes(pick.randrange(256) for _ in range(pick.choice([2, 4, 6]))) for _ in range(3000)})
    root = art.build(keys)
    layouts, found = set(), {}
    stack = [(root, b"")]
    while stack:
        node, before = stack.pop()
        whole = before + node.path
        layouts.add(node.layout)
        if node.item >= 0:
            found[whole] = node.item
        stack += [(k, whole) for k in node.children()]
        assert all(node.find(k.path[0]) is k for k in node.children())
    assert found == {k: i for i, k in enumerate(keys)} and layouts == {0, 4, 16, 48, 256} & layouts
    wide = art.build([bytes([b, 1]) for b in range(40)] + [b"\x07\x02"])
    assert wide.layout == 48 and wide.find(7).layout == 4 and wide.find(200) is None
    assert root.layout == 256
