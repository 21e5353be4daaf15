"""Decontamination against a plain search of every window."""

import hashlib
import random
import re
from collections import Counter

from runlore.llm import decontam
from runlore.plans import pruning

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, bench):
    windows = {}
    for item, text in bench:
        w = plain_words(text)
        if item is not None and w:
            n = min(13, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out, pairs = [], rarest_pairs(docs, bench)
    for doc_id, text in docs:
        w = plain_words(text)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    ids |= windows[tuple(w[p : p + n])]
        near = {item for item, one, two, apart in pairs if is_near(w, one, two, apart)}
        digest, near_digest = (hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in (ids, near))
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w), len(near), near_digest))
    return sorted(out, key=repr)


def is_near(w, one, two, apart):
    at = {t: [p for p, x in enumerate(w) if x == t] for t in (one, two)}
    return any(p != q and abs(q - p - apart) <= 4 for p in at[one] for q in at[two])


def rarest_pairs(docs, bench):
    """(item, rarest term, second, distance) of every window, of the terms that documents have."""
    counts = Counter(x for _, text in docs for x in plain_words(text))
    pairs = set()
    for item, text in bench:
        w = plain_words(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if item is not None and w else 0):
            known = sorted((counts[w[j]], j) for j in range(s, s + n) if counts[w[j]])
            if len(known) > 1:
                (_, a), (_, b) = known[:2]
                pairs.add((str(item), w[a], w[b], b - a))
    return pairs


def cases():
    pick = random.Random(2)
    few = [pick.choice(["of", "the", "Él", "a1"]) for _ in range(600)]
    many = [f"w{pick.randrange(300)}" for _ in range(900)]
    bench = [(1, " ".join(few[:40])), (2, " ".join(few[10:60])), (30, " ".join(many[:70])), (30, " ".join(many[500:530]))]
    bench += [(4, "Short item"), (5, "one"), (6, ""), (7, None), (8, "...!"), (9, " ".join(few[:40])), (None, "w1 w2"), (10, "the " * 30)]
    docs = [(i, " ".join(few[a : a + n] + many[b : b + m])) for i, (a, n, b, m) in enumerate(
        (pick.randrange(80), pick.randrange(60), pick.randrange(600), pick.randrange(90)) for _ in range(60))]
    docs += [(100, "The the THE " * 200), (101, None), (102, ""), (103, "short  ITEM"), (103, "short  ITEM"), (103, "other"), (None, "one"), (105, "...")]
    docs += [(106, " ".join(few[3:15])), (107, " ".join(few[3:16])), (108, "él of " + " ".join(many) * 20 + " " + " ".join(few))]
    return docs, bench


def test_matches_a_plain_search(spark, docs_of):
    docs, bench = cases()
    got = decontam.op10(docs_of(docs).withColumnRenamed("source", "n_hit"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, bench)


def test_empty_tables(spark, docs_of):
    docs, bench = cases()
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontam.op10(docs_of(docs), none).collect())
    assert decontam.op10(docs_of(docs).limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark, docs_of):
    docs, bench = cases()
    kept = decontam.decontaminated(docs_of(docs), spark.createDataFrame(bench, "item_id long, text string"))
    want = [r[0] for r in plain(docs, bench) if not r[5]]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_changed_words_leave_items_near(spark, docs_of):
    words = [f"w{i}" for i in range(12)]
    changed = [*words[:6], "other", *words[7:]]
    moved = [*words[:3], "x", "y", *words[3:]]
    docs = [(1, " ".join(changed)), (2, " ".join(moved)), (3, "w1 " + "z " * 30 + "w2"), (4, " ".join(words)), (5, "w1 x"), (6, "same"), (7, "same a same")]
    # w6b stands in no document: that item is found by its other words alone
    bench = [(1, " ".join(words)), (2, " ".join([*words[:6], "w6b", *words[7:]])), (3, "same same")]
    got = decontam.op10(docs_of(docs), spark.createDataFrame(bench, "item_id long, text string"))
    rows = {r.doc_id: (r.n_items, r.n_near) for r in got.collect()}
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, bench)
    assert rows[4] == (1, 2) and rows[1][1] == 1 and rows[2][1] == 2 and rows[3] == rows[5] == rows[6] == (0, 0) and rows[7] == (0, 1)


def test_proximity(spark):
    pick = random.Random(4)
    index = [(t, d, p) for d in range(3) for p in range(80) for t in ["x", "y"] if pick.random() < 0.1]
    ends = [("x", 9, 2, 1, 3), ("y", 9, 5, 2, 3)]
    got = decontam.proximity(
        spark.createDataFrame(index, "term string, key long, pos int"),
        spark.createDataFrame(ends, "term string, segment long, at int, bit int, need int"), 4,
    )
    want = {}
    for t, d, p in index:
        gaps = [abs((p - 2) - (q - 5)) for u, e, q in index if t == "x" and u == "y" and e == d]
        if gaps and min(gaps) <= 4:
            want[(d, p - 2)] = min(gaps)
    assert {(r.key, r.start): r.gap for r in got.collect()} == want


def test_many_terms_and_documents_take_the_filters(spark, docs_of, monkeypatch):
    docs, bench = cases()
    items = spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(pruning, "BROADCAST_KEYS", 3)
    assert sorted(map(tuple, decontam.op10(docs_of(docs), items).collect()), key=repr) == plain(docs, bench)
    kept = decontam.decontaminated(docs_of(docs), items)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in plain(docs, bench) if not r[5])
