"""SimHash components against an all-pairs comparison."""

import random

import xxhash

from runlore.llm import mixing, simhash
from runlore.llm.common import row_id
from runlore.llm.components import components


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(values))]


def test_components_match_all_pairs(docs_of):
    pick = random.Random(3)
    base = [" ".join(pick.choice(["a", "be", "sea", "dé", "E"]) + str(pick.randrange(60)) for _ in range(400)) for _ in range(8)]
    texts = [None, "", " \t\n", "One", "one two", "ONE TWO", "one two three four", "x\x1cy", *base]
    for b in base:
        for _ in range(12):
            words = b.split()
            words[pick.randrange(400)] = "new"
            texts.append(" ".join(words))
    texts.append("z " * 30_000)
    docs = docs_of([(i, t) for i, t in enumerate(texts)]).withColumnRenamed("n_chars", "fp")
    got = {r.doc_id: r for r in simhash.op4(docs).collect()}
    prints = [slow_print(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == slow_components(prints)


def test_tiles_lose_no_link(spark):
    pick = random.Random(5)
    centre = pick.getrandbits(64)
    values = {centre}
    while len(values) < 150:
        v = pick.choice(sorted(values))
        for _ in range(pick.randrange(1, 5)):
            v ^= 1 << pick.randrange(64)
        values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = slow_components(values)
    for tile in (7, 2048):
        label = {r.node: r.label for r in components(simhash.links(nodes, tile)).collect()}
        got = [label.get(v, v) for v in signed]
        assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_long_path_and_no_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5)], "a long, b long")
    assert components(edges).select("label").distinct().count() == 1
    assert components(edges.limit(0)).count() == 0


def test_empty_table_and_repeated_rows(docs_of):
    assert simhash.op4(docs_of([(1, "a")]).limit(0)).count() == 0
    rows = [(2, "same words here"), (2, "same words here"), (None, "same words here"), (1, "other text"), (None, None), (7, "")]
    assert sorted(map(str, (r.component_id for r in simhash.op4(docs_of(rows)).collect()))) == ["1", "2", "2", "2", "7", "7"]
    kept = simhash.dedup(docs_of(rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "other text"), (2, "same words here"), (7, "")]


def test_rows_that_differ_in_where_a_null_stands(docs_of):
    rows = docs_of([(1, "one text", "a", None), (1, "one text", None, "a"), (1, "one text", None, "a")])
    assert rows.select(row_id(rows)).distinct().count() == 2
    assert simhash.dedup(rows).count() == 1
    assert mixing.mixed(rows).count() == 2
