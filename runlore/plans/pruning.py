"""Restrict tables to what a selection needs, before anything expensive reads them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many keys, a few short values each, are broadcast.
BROADCAST_KEYS = 500_000
# Up to this many repositories become a filter that reaches the scan.
LISTED = 1_000
# Bits of the filter for each key, and bits that a key sets, all in one 64-bit word.
BITS_PER_KEY = 16
BITS_SET = 5
# The filter has at most this many words (32 MB). With more than 16 million keys it lets more rows pass.
MAX_WORDS = 1 << 22
# Words are kept in chunks of this length.
_CHUNK = 1 << 12


def _word_and_bits(key: Sequence[Column], words: int) -> tuple[Column, Column]:
    """The word of a key in a filter of ``words`` words, and the bits it sets there."""
    h = F.xxhash64(*key)
    word = h.bitwiseAND(F.lit(words - 1))
    spread = F.xxhash64(F.lit("bits"), *key)
    one = F.lit(1).cast("long")
    places = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_SET)]
    return word, reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, place) for place in places])


def membership(keys: DataFrame, columns: Sequence[str], number: int) -> tuple[DataFrame, int]:
    """A Bloom filter over ``keys`` (about ``number``): one row with its words in chunks, and how many words it has.

    Built by an aggregate; each key sets its bits in a single word, so testing takes one look. Its size is
    BITS_PER_KEY bits a key, at most MAX_WORDS words, whatever the keys.
    """
    wanted = max(_CHUNK, -(-number * BITS_PER_KEY // 64))
    words = min(MAX_WORDS, 1 << (wanted - 1).bit_length())
    word, mask = _word_and_bits([F.col(c) for c in columns], words)
    some = keys.dropna(subset=list(columns)).select(word.alias("word"), mask.alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = some.groupBy("word").agg(F.bit_or("bits").alias("bits")).unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = lambda value: F.array_sort(F.collect_list(F.struct("at", value)))
    chunks = (
        filled.withColumns({"chunk": F.floor(F.col("word") / _CHUNK), "at": F.col("word") % _CHUNK})
        .groupBy("chunk")
        .agg(F.transform(ordered("bits"), lambda x: x["bits"]).alias("words"))
    )
    whole = F.array_sort(F.collect_list(F.struct("chunk", "words")))
    return chunks.agg(F.transform(whole, lambda x: x["words"]).alias("words")), words


def _distinct(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    return keys.select(*[F.col(n).cast(df.schema[n].dataType).alias(n) for n in names]).distinct()


def _few(keys: DataFrame, limit: int | None) -> bool:
    most = BROADCAST_KEYS if limit is None else limit
    return keys.limit(most + 1).count() <= most


def _test(df: DataFrame, wanted: DataFrame, names: list[str]) -> Column:
    """Whether a row's key may be among ``wanted``; false for keys with a null."""
    table, words = membership(wanted, names, wanted.count())
    key = [F.col(n) for n in names]
    word, mask = _word_and_bits(key, words)
    chunk = F.shiftright(word, _CHUNK.bit_length() - 1).cast("int")
    held = table.scalar()[chunk][word.bitwiseAND(F.lit(_CHUNK - 1)).cast("int")]
    known = reduce(Column.__and__, [k.isNotNull() for k in key])
    return known & (held.bitwiseAND(mask) == mask)


def without(df: DataFrame, keys: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``columns`` do not occur in ``keys``; rows with a null there stay.

    Few keys are broadcast. Otherwise the rows that a Bloom filter in the scan's own tasks does not hold are
    kept there, and only those it holds are exchanged to look closer.
    """
    names = list(columns)
    wanted = _distinct(df, keys, names)
    if _few(wanted, limit):
        return df.join(F.broadcast(wanted), names, "left_anti").select(*df.columns)
    maybe = F.coalesce(_test(df, wanted, names), F.lit(False))
    return df.filter(~maybe).unionByName(df.filter(maybe).join(wanted, names, "left_anti").select(*df.columns))


def likely(df: DataFrame, keys: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``columns`` occur in ``keys``, and possibly a few others; no row is exchanged.

    For tables with large texts. Few keys are broadcast and give exactly their rows. Many are put into a
    Bloom filter that the scan's own tasks test, so the texts stay where they are read; joins of the
    short values derived from them remove what passed by chance. ``limit`` replaces BROADCAST_KEYS.
    """
    names = list(columns)
    wanted = _distinct(df, keys, names)
    if _few(wanted, limit):
        return df.join(F.broadcast(wanted), names, "left_semi")
    return df.filter(_test(df, wanted, names))


def only(df: DataFrame, keys: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``columns`` occur in ``keys``. Many keys shuffle ``df``: for narrow tables."""
    names = list(columns)
    wanted = _distinct(df, keys, names)
    if _few(wanted, limit):
        wanted = F.broadcast(wanted)
    return df.join(wanted, names, "left_semi")


def within(tables: Mapping[str, DataFrame], selected: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """The tables with the rows of the selected repositories; ``repositories`` stays whole.

    The names of a few repositories are filtered in the scan, many are tested there.
    """
    names = selected.select("repository").distinct()
    listed = [r["repository"] for r in names.limit(LISTED + 1).collect()]
    few = len(listed) <= LISTED

    def cut(name: str, df: DataFrame) -> DataFrame:
        if "repository" not in df.columns or name == "repositories":
            return df
        return df.filter(F.col("repository").isin(listed)) if few else likely(df, names, ["repository"], limit)

    return {name: cut(name, df) for name, df in tables.items()}
