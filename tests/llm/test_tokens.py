"""Token counts against the library that the vocabulary belongs to."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runlore.llm import tokens

PATH = public_tokenizers.path(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_code_point_cuts_like_the_library(library):
    count = tokens._counter(tokens.load(PATH))
    points = [chr(c) for c in range(0x34000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}{c}'s{c}  {c}\n" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert count(texts) == want(library, texts)


def test_whole_texts(spark, docs_of, library):
    from runlore.llm.common import table

    pick = random.Random(4)
    odd = [None, "", " ", "   ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "a" * 30_000, "ab" * 20_000, " " * 9_000,
           "".join(pick.choice("abcdefgh") for _ in range(20_000)), "\x1c\x85\xa0 x", "don't 'S ''ll", "\r\n\r\n x", "🎈" * 300, "x\0y"]
    docs = docs_of(list(enumerate(odd)) + [(3, "   "), (None, "again")]).withColumnRenamed("source", "n_tokens")
    rows = tokens.op2(docs, PATH).collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    assert len(rows) == len(odd) + 2
    assert [got[i] for i in range(len(odd))] == [(len((t or "").encode()), n, n > 512) for t, n in zip(odd, want(library, odd))]
    real = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in real.collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.op2(real, PATH).collect()}
    assert list(got.values()) == want(library, [texts[i] for i in got])
    assert tokens.op2(real.limit(0), PATH).count() == 0


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBER", 5)
    monkeypatch.setattr(tokens, "_BYTES", 7)
    count = tokens._counter(tokens.load(PATH))
    texts = ["one two three", "two three four five six seven", "one", "eight nine ten eleven twelve one two"]
    for _ in range(2):
        assert [count([t])[0] for t in texts] == want(library, texts)
        assert count(texts) == want(library, texts)
