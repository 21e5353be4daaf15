"""Naive Bayes scores against a plain computation, and accuracy on documents kept from training."""

import numpy as np

from runlore.llm import langid

SF_DIR = "/root/testdata/sf0.001"


def model(languages=("de", "en")):
    pick = np.random.default_rng(1)
    matrix = -pick.integers(1, 1 << 20, (len(languages), 1 << 8)).astype(np.int32)
    return langid.Model(tuple(languages), np.array([-5] * len(languages)), matrix, 8)


def plain(text, m):
    total = m.prior.copy()
    points = np.array([ord(c) for c in text.lower()], np.uint32)
    for order in langid.ORDERS:
        for at in range(len(points) - order + 1):
            bucket, inside = langid._buckets(points[at : at + order], order, m.bits)
            total = total + (m.matrix[:, bucket[0]] if inside[0] else 0)
    return total


def test_scores_do_not_depend_on_batches_or_pieces(monkeypatch):
    m = model()
    texts = ["", None, "a", "Ab cé " * 40, "x\0y", "İstanbul 🎈 ok", "1 2 !"]
    want = [plain(t or "", m) for t in texts]
    for piece in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(langid, "_PIECE", piece)
        total = np.tile(m.prior, (len(texts), 1))
        for pieces, owner in langid._grouped(texts, piece):
            np.add.at(total, owner, langid._scores(pieces, m))
        assert (total == np.array(want)).all()
    names, scores = langid.predict(texts, m)
    assert [n == "und" for n in names] == [True, True, False, False, False, False, True]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == 0


def test_accuracy_on_held_out_documents(spark):
    from runlore.llm.common import table

    docs = table(spark, SF_DIR, "documents").drop("n_chars")
    rows = langid.op8(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_labels_of_held_out_documents_are_not_used(spark):
    from pyspark.sql import functions as F

    from runlore.llm.common import table

    docs = table(spark, SF_DIR, "documents")
    other = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert sorted(langid.op8(docs).collect()) == sorted(langid.op8(other).collect())


def test_edge_cases(docs_of):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34", "en"), (4, "the cat", "en"), (4, "the cat", "en"), (None, "le chat", None)]
    rows += [(i, "der hund und die katze", "de") for i in range(10, 30)] + [(i, "the dog and the cat", "en") for i in range(30, 50)]
    docs = docs_of(rows)
    got = langid.op8(docs).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 4} == {"en"}
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert langid.op8(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.op8(docs_of([(1, "some text")])).collect()} == {"und"}
