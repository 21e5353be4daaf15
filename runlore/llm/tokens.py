"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens. The distinct ones of a batch lie one after another in one numpy array
of symbols. In each step every sequence merges its own pair of lowest rank, at all places, and
all sequences do so at once; sequences without a pair left leave the arrays. The number of symbols
that survive is the number of tokens.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
# How the byte-level pre-tokenizer cuts texts (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts are taken in groups of about so many code points, and so many counts are remembered.
_GROUP = 1 << 20
_REMEMBER = 400_000
_BYTES = 1 << 21
_NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    """Byte symbols, merges by sorted pair key (left * size + right), special strings, newer symbols."""

    size: int
    byte_symbols: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: tuple[str, ...]
    newer: str


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if visible, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, hidden = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + hidden)
            hidden += 1
    return [letters[b] for b in range(256)]


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library. It is read by the driver and broadcast."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("only byte-level vocabularies without a normalizer are supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special strings must be matched as they are")
    ids = spec["model"]["vocab"]
    size = max(ids.values()) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    merged = np.array([ids[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys)
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    symbols = np.array([ids[c] for c in _byte_letters()], np.int32)
    return Vocabulary(size, symbols, keys[order], order.astype(np.int32), merged, tuple(special), _newer_symbols())


def _ranks(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    key = left.astype(np.int64) * v.size + right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.ranks[at], _NONE)


def merged_lengths(words: list[bytes], v: Vocabulary) -> np.ndarray:
    """Number of symbols that survive in each byte string."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = sizes.copy()
    symbols = v.byte_symbols[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    while len(symbols) > 1 and len(v.keys):
        last = np.append(owner[1:] != owner[:-1], True)
        rank = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = _ranks(symbols[inner], symbols[inner + 1], v)
        ends = np.flatnonzero(last)
        starts = np.append(0, ends[:-1] + 1)
        lengths = ends - starts + 1
        lowest = np.minimum.reduceat(rank, starts)
        counts[owner[starts]] = lengths
        going = lowest < _NONE
        hit = (rank == np.repeat(lowest, lengths)) & (rank < _NONE)
        # places in a row overlap ("aaa"): every second one of them, from the left
        place = np.arange(len(hit))
        fresh = hit & ~np.append(False, hit[:-1])
        hit &= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        symbols[hit] = v.merged[rank[hit]]
        keep = np.repeat(going, lengths) & ~np.append(False, hit[:-1])
        symbols, owner = symbols[keep], owner[keep]
    if len(symbols):
        left, n = np.unique(owner, return_counts=True)
        counts[left] = n
    return counts


def _newer_symbols() -> str:
    """Code points that are letters or numbers to the regex module but not yet to the library.

    Only those can be that Python's own, older tables leave unassigned; the library is asked.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    asked = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return "".join(c for c in asked if len(cut("a" + c)) > 1 and len(cut("1" + c)) > 1)


def _cutter(newer: str):
    """Cut a text into pre-tokens. Newer code points are ordinary symbols, as in the library."""
    pattern, known = regex.compile(PATTERN), frozenset(newer)
    as_symbol = dict.fromkeys(map(ord, newer), "\u2603")

    def cut(text: str) -> list[str]:
        if text.isascii() or known.isdisjoint(text):
            return pattern.findall(text)
        return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(as_symbol))]

    return cut


def _counter(v: Vocabulary):
    cut = _cutter(v.newer)
    special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None
    known: dict[str, int] = {}

    def learn(words: list[str]) -> None:
        if len(known) + len(words) > _REMEMBER:
            known.clear()
        at = 0
        while at < len(words):
            group, size = [], 0
            while at < len(words) and (not group or size < _BYTES):
                group.append(words[at].encode())
                size += len(group[-1])
                at += 1
            known.update(zip(words[at - len(group) : at], merged_lengths(group, v).tolist()))

    def count(texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside a text are one token each."""
        cuts, found = [], []
        for text in texts:
            parts = special.split(text) if special else [text]
            found.append(len(parts) - 1)
            cuts.append([w for part in parts for w in cut(part)])
        new = set().union(*cuts).difference(known)
        if new:
            if len(known) + len(new) > _REMEMBER:
                new = set().union(*cuts)
            learn(list(new))
        return [sum(map(known.__getitem__, words)) + n for words, n in zip(cuts, found)]

    return count


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= _GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; null texts count as empty, with no tokens."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counter(vocabulary.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            tokens = [n for group in _groups(texts) for n in counted(group)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op2(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
