"""Base spans against Python's own matcher, boosted trees, and redaction."""

import hashlib
import random
import re

import numpy as np

from runlore.llm import boost, pii

SF_DIR = "/root/testdata/sf0.001"
EXACT = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(EXACT.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def texts():
    pick = random.Random(8)
    parts = ["a@b.c", "x.y+z@m-1.co.uk", "a@b", "@", "1.2.3.4", "999.1.1.1", "0001.2.3.0255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (743) 555-3824", "+12", "+1234567890123456", "a@b.c_d@e.f", "é", "🎈", " ", ",", "--", "..", "5", "+", "a@1.2.3.4", "00000000000000"]
    rows = ["".join(pick.choice(parts) for _ in range(pick.randrange(14))) for _ in range(400)]
    return [*rows, None, "", "1" * 60_000, "a." * 40_000, "a" * 50_000 + "@", "1.2.3.4 " * 400, "1 " * 30_000, "a@b" + ".c" * 30_000]


def test_base_spans_match_the_plain_search(docs_of):
    rows = texts()
    got = {r.doc_id: r for r in pii.op5(docs_of(list(enumerate(rows))).withColumnRenamed("source", "spans")).collect()}
    for i, text in enumerate(rows):
        want = plain(text)
        digest = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), (i, text and text[:80])
        assert [got[i][f"n_{k}"] for k in EXACT] == [sum(s[3] == k for s in want) for k in EXACT]
        assert set(filter(None, digest.split(","))) <= set(got[i].spans.split(","))


def test_trees_learn_and_thresholds_keep_precision():
    pick = np.random.default_rng(0)
    patterns = np.arange(64)
    truth = ((patterns & 1) ^ (patterns >> 1 & 1)).astype(bool)
    n = pick.integers(50, 100, 64)
    positive = np.where(truth, n, 0)
    model = boost.calibrated(patterns, positive, n, patterns % 3, 6, 0.97, 5)
    margin = model.base + boost._margins((patterns[:, None] >> np.arange(6)) & 1, list(model.trees))
    assert ((margin >= model.threshold) == truth).mean() > 0.9
    none = boost.calibrated(patterns, n // 2, n, patterns % 3, 6, 0.97, 5)
    assert none.threshold is None


def test_phones_without_a_country_code_are_added(docs_of):
    pick = random.Random(1)
    number = lambda: f"({pick.randrange(200, 999)}) 555-{pick.randrange(1000, 9999)}"
    rows = [(i, f"call me at +1 {number()} today") for i in range(600)] + [(i, f"order {pick.randrange(10**7, 10**8)}/{i}") for i in range(600, 900)]
    rows += [(1000, "call me at (743) 555-3824 now"), (1001, "order 12345678/90")]
    got = {r.doc_id: r.spans for r in pii.op5(docs_of(rows)).collect()}
    assert got[1000] == "phone:11:25" and got[1001] == ""


def test_frequent_forms_without_a_base_match_are_added(docs_of):
    pick = random.Random(4)
    number = lambda: f"({pick.randrange(200, 999)}) 555-{pick.randrange(1000, 9999)}"
    name = lambda: "".join(pick.choice("abcdefgh") for _ in range(8))
    rows = [(i, f"call me at +1 {number()} or {name()}@{name()}.org today") for i in range(400)]
    rows += [(i, f"call me at {number()} today") for i in range(400, 1000)]
    rows += [(i, f"write to {name()} (at) {name()} (dot) org today") for i in range(1000, 1500)]
    rows += [(i, "call me at (743) 555-3824 today") for i in range(1500, 2500)]
    rows += [(i, f"order {pick.randrange(10**7, 10**8)}/{i}, meet me @ {name()}. Then go") for i in range(2500, 2800)]
    got = {r.doc_id: r.spans for r in pii.op5(docs_of(rows)).collect()}
    assert {got[i] for i in range(400, 1000)} | {got[i] for i in range(1500, 2500)} == {"phone:11:25"}
    assert {got[i] for i in range(1000, 1500)} == {"email:9:41"}
    assert {got[i] for i in range(2500, 2800)} == {""}


def test_neighbours_do_not_swallow_each_other(docs_of):
    pick = random.Random(4)
    number = lambda: f"({pick.randrange(200, 999)}) 555-{pick.randrange(1000, 9999)}"
    name = lambda: "".join(pick.choice("abcdefgh") for _ in range(8))
    rows = [(i, f"call me at +1 {number()} or {name()}@{name()}.org today") for i in range(400)]
    rows += [(i, f"call {number()} {number()} today") for i in range(400, 500)]
    rows += [(i, f"call 10.0.0.5 {number()} today") for i in range(500, 600)]
    rows += [(i, f"write to a@b.org. {name()} (at) {name()} (dot) org") for i in range(600, 700)]
    docs = docs_of(rows)
    got = {r.doc_id: r.spans for r in pii.op5(docs).collect()}
    assert {got[i] for i in range(400, 500)} == {"phone:5:19,phone:20:34"}
    assert {got[i] for i in range(500, 600)} == {"ip:5:13,phone:14:28"}
    assert {got[i] for i in range(600, 700)} == {"email:9:16,email:18:50"}


def test_numbers_written_like_phones_stay_where_phones_are_strange(docs_of):
    """Precision and recall of added spans, by surroundings and form, in forms of which no base match is."""
    pick = random.Random(5)
    forms = ["({}) 555-{}", "{}-555-{}", "{}.555.{}"]
    number = lambda f: f.format(pick.randrange(200, 999), pick.randrange(1000, 9999))
    said = ["call me at {} today", "my phone is {} now", "write or call: {}.", "fax {}"]
    things = ["order {} was sent", "part {} in stock", "we measured {} in total", "see row {} below"]
    rows = [(i, pick.choice(said).format("+1 " + number(pick.choice(forms)))) for i in range(900)]
    people = [(i, pick.choice(said), pick.choice(forms)) for i in range(1000, 1600)]
    others = [(i, pick.choice(things), pick.choice(forms)) for i in range(2000, 3200)]
    rows += [(i, text.format(number(form))) for i, text, form in people + others]
    added = {r.doc_id for r in pii.op5(docs_of(rows)).collect() if r.doc_id >= 1000 and r.spans}
    for form in forms:
        good = {i for i, _, f in people if f == form}
        bad = {i for i, _, f in others if f == form}
        assert len(added & good) >= 0.8 * len(good), (form, "recall")
        assert len(added & bad) <= 0.1 * len(added & (good | bad)), (form, "precision")


def test_the_threshold_stops_where_precision_first_fails():
    patterns, folds = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    total = np.repeat([1000, 1000, 40, 1000], 3)
    positive = np.repeat([0, 0, 20, 1000], 3)
    model = boost.calibrated(patterns, positive, total, folds, 2, 0.97, 20)
    margin = model.base + boost._margins((np.arange(4)[:, None] >> np.arange(2)) & 1, list(model.trees))
    assert (margin >= model.threshold).tolist() == [False, False, False, True]


def test_redaction_removes_spans_and_keeps_the_rest(docs_of):
    rows = [*texts(), "+1 555 123 4567.x@mail.com end"]
    docs = docs_of(list(enumerate(rows)))
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(rows):
        spans = plain(text)
        if not spans:
            continue
        for a, _, b, kind in spans:
            assert got[i].n_chars == len(got[i].text)
        assert not [s for s in plain(got[i].text) if s[3] == "email"]
    assert got[len(rows) - 1].text == "[PHONE] end"
    assert got[400].text is None and got[401].text == ""


def test_empty_and_repeated(docs_of):
    docs = docs_of([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")])
    assert [r.spans for r in pii.op5(docs).collect()] == ["email:0:5"] * 3
    assert pii.op5(docs.limit(0)).count() == 0
