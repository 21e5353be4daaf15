"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
MAX_BITS = 15
# The matrix has at most this many cells (4 bytes each), whatever the number of languages.
MAX_CELLS = 1 << 24
# About so many training documents per language, chosen by a hash.
SAMPLE = 2000
UNKNOWN = "und"
FOLDS = 5
# Log-probabilities are kept as whole multiples of 1 / SCALE, so that sums do not depend on order.
SCALE = 1 << 16
# Code points that are scored at once; longer texts are taken in such pieces, whole all the same.
_PIECE = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@dataclass(frozen=True)
class Model:
    """Learned languages in order and the matrix of scaled log-probabilities, [language, bucket]."""

    languages: tuple[str, ...]
    prior: np.ndarray
    matrix: np.ndarray
    bits: int


def _points(pieces: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all pieces, where each starts, and whether an n-gram may start at a place.

    A gap of two zeros after each piece keeps n-grams inside their texts.
    """
    sizes = np.fromiter((len(t) for t, _ in pieces), np.int64, len(pieces))
    joined = "\0\0".join([*(t for t, _ in pieces), ""])
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    begins = np.ones(len(joined), bool)
    for (text, own), start in zip(pieces, starts):
        if own < len(text):
            begins[start + own : start + len(text)] = False
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts, begins


def _buckets(points: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each place, and whether it lies inside one text."""
    size = max(0, len(points) - order + 1)
    mixed = np.full(size, order, np.uint32)
    inside = np.ones(size, bool)
    for k in range(order):
        part = points[k : k + size]
        mixed = (mixed ^ (part * _MULTIPLIERS[k])) * np.uint32(2654435769)
        mixed ^= mixed >> np.uint32(15)
        inside &= part != 0
    return (mixed >> np.uint32(32 - bits)).astype(np.int64), inside


def _pieces(text: str | None) -> Iterator[tuple[str, int]]:
    """A lower-cased text in pieces, each with the number of n-grams' starts that belong to it.

    A piece holds the next code points as well, as many as an n-gram that starts in it may need.
    """
    folded = (text or "").lower()
    for at in range(0, max(1, len(folded)), _PIECE):
        yield folded[at : at + _PIECE + max(ORDERS) - 1], min(_PIECE, len(folded) - at)


def _scores(pieces: list[tuple[str, int]], model: Model) -> np.ndarray:
    """Summed scaled log-probabilities, [piece, language]."""
    points, starts, begins = _points(pieces)
    total = np.zeros((len(pieces), len(model.languages)), np.int64)
    for order in ORDERS:
        bucket, inside = _buckets(points, order, model.bits)
        inside &= begins[: len(inside)]
        at = np.minimum(starts[:-1], max(0, len(bucket) - 1))
        if not len(bucket):
            continue
        for k in range(len(model.languages)):
            values = np.where(inside, model.matrix[k].take(bucket), 0).astype(np.int64)
            total[:, k] += np.add.reduceat(values, at)
    return total


def _grouped(texts: list[str | None], limit: int = _PIECE) -> Iterator[tuple[list[tuple[str, int]], list[int]]]:
    """Pieces of consecutive texts, about ``limit`` code points at a time, with their text's place."""
    pieces, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            pieces.append(piece)
            owner.append(i)
            size += len(piece[0])
            if size >= limit:
                yield pieces, owner
                pieces, owner, size = [], [], 0
    if pieces:
        yield pieces, owner


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    total = np.tile(model.prior, (len(texts), 1))
    for pieces, owner in _grouped(texts):
        np.add.at(total, owner, _scores(pieces, model))
    known = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
    if not len(model.languages):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    share = np.exp((total - total.max(1, keepdims=True)) / SCALE).sum(1)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return names, np.where(known, 1.0 / share, 0.0)


def _counted(bits: int, languages: tuple[str, ...]):
    place = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                own = [t for n, t in zip(names, texts) if n == name]
                counts = seen.setdefault(name, np.zeros(1 << bits, np.int64))
                for pieces, _ in _grouped(own):
                    points, _, begins = _points(pieces)
                    for order in ORDERS:
                        bucket, inside = _buckets(points, order, bits)
                        inside &= begins[: len(inside)]
                        counts += np.bincount(bucket[inside], minlength=1 << bits)
        for name, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), place[name], np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used])],
                names=["language", "bucket", "n"],
            )

    return count


def train(labelled: DataFrame, sample: int = SAMPLE, max_bits: int = MAX_BITS) -> Model:
    """Fit on (doc_id, text, lang) rows with a language.

    A bounded sample is read: of each language every row whose hash falls below sample / its number
    of rows, so about ``sample`` documents, whole texts. What reaches the driver is the number of
    rows per language and at most languages x buckets counts (MAX_CELLS).
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    bits = max_bits
    while bits > 8 and (len(languages) << bits) > MAX_CELLS:
        bits -= 1
    counts = np.zeros((len(languages), 1 << bits))
    if languages:
        shares = rows.sparkSession.createDataFrame(
            [(name, min(1.0, sample / n)) for name, n in sizes.items()], "name string, share double"
        )
        draw = F.shiftrightunsigned(F.xxhash64("text", "doc_id"), 11) / F.lit(float(1 << 53))
        # one row per language
        chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("name")).filter(draw < F.col("share"))
        found = (
            chosen.select("lang", "text")
            .mapInArrow(_counted(bits, languages), "language int, bucket int, n long")
            .groupBy("language", "bucket")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )
        at = np.asarray(found.column("language")), np.asarray(found.column("bucket"))
        counts[at] = np.asarray(found.column("n"))
    smoothed = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)) if languages else counts
    total = sum(sizes.values())
    prior = np.array([np.log(sizes[name] / total) for name in languages])
    return Model(
        languages,
        np.round(prior * SCALE).astype(np.int64),
        np.round(smoothed * SCALE).astype(np.int32),
        bits,
    )


def identify(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of each row with ``lang_pred`` and ``score``, from the text alone.

    ``und`` with score 0 for a null text, a text without a letter, or when nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns, F.col("text").alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(score, schema)


def held_out() -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of FOLDS."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those not held out."""
    model = train(docs.filter(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is identified with a score of at least ``least``; columns of ``docs``."""
    model = train(docs.filter(~held_out()))
    names = docs.columns
    plain = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)]
    rows = docs.select(*plain, "text")
    found = identify(rows, model, [f"__{i}" for i in range(len(names))])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(names)]
    )
