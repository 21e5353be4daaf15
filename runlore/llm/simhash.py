"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import row_id, stored
from runlore.llm.components import components
from runlore.plans.pruning import likely, without

# 64 bits in five blocks. Two fingerprints that differ in at most 3 bits agree in at least two of
# them, so every such pair meets under one of the ten pairs of blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_BITS = 3
SEED = 42
SHINGLE = 3
# Members of a bucket that are compared in one task; larger buckets are cut into tiles of this size.
TILE = 2048
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of one UTF-8 text: bit set where it is set in over half of the shingle hashes."""
    # bytes.lower and bytes.split know exactly A-Z and the six ASCII spaces
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends)), ">u8", len(starts)
    )
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8)).reshape(-1, 64)
        set_in += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, of whatever type, and ``fp``, the fingerprint as a signed long, of each row of (doc_id, text).

    A null or empty text, or one of spaces only, has the fingerprint zero. Whole texts are read;
    the text reaches the workers as bytes.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, rows.drop("text").schema.add("fp", "long"))


def _block_keys(fp: Column) -> Column:
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in BLOCKS]
    keys = []
    for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        both = F.shiftleft(part[i], BLOCKS[j][1]).bitwiseOR(part[j])
        keys.append(F.shiftleft(both, 4).bitwiseOR(F.lit(k)))
    return F.array(*keys)


def _forest(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs at most MAX_BITS apart, within one tile or across two."""
    found: list[tuple[int, int]] = []
    sides = [left] if right is None else [left, right]
    open_ = [np.ones(len(s), bool) for s in sides]
    for first in range(len(left)):
        if not open_[0][first]:
            continue
        open_[0][first] = False
        queue = [(0, first)]
        while queue:
            side, at = queue.pop()
            other = 0 if right is None else 1 - side
            rest = np.flatnonzero(open_[other])
            if not len(rest):
                continue
            near = rest[np.bitwise_count(sides[other][rest] ^ sides[side][at]) <= MAX_BITS]
            open_[other][near] = False
            for x in near.tolist():
                found.append((int(sides[side][at]), int(sides[other][x])))
                queue.append((other, x))
    return found


def _tile_edges(key: tuple, rows: pa.Table) -> pa.Table:
    values = np.asarray(rows.column("fp")).view(np.uint64)
    side = np.asarray(rows.column("side"))
    edges = _forest(values, None) if key[1] == key[2] else _forest(values[side == 0], values[side == 1])
    pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column ``fp``, distinct) at most 3 bits apart.

    Buckets of two give their pair directly. Larger buckets are compared in numpy, in tiles of about
    ``tile`` members and pairs of tiles, and give a spanning forest instead of all pairs: at most
    one edge per member and tile. Nothing is left out: every pair of members meets in one tile.
    """
    keyed = nodes.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    buckets = stored(
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1")
    )
    pairs = buckets.filter(
        (F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    ).select("a", "b")

    tiles = F.ceil(F.col("n") / tile).cast("int")
    members = keyed.join(buckets.filter("n > 2").select("key", "n"), "key").select(
        "key", "fp", tiles.alias("g"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("own")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    placed = members.select("key", "fp", "own", other).select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "fp",
    )
    compared = placed.groupBy("key", "i", "j").applyInArrow(_tile_edges, "a long, b long")
    return pairs.unionByName(compared)


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, ``fp`` and component_id, the smallest doc_id reachable over links of at most 3 bits.

    One row per row of ``docs``. Equal fingerprints are linked, so all copies count as one node
    before any comparison. Rows without a doc_id take part; they never name a component unless it
    has no other rows (then it is null).
    """
    prints = stored(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(nodes, tile))
    named = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    named = stored(named)
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    owner = named.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return prints.join(owner, "fp").select("doc_id", "fp", "component_id")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (rows without one come last).

    Several rows with that doc_id: the one whose row_id is smallest; equal rows stay
    once. Columns are those of ``docs``.
    """
    marked = docs.withColumn("__row", row_id(docs))
    # the hash stands in for doc_id, so that repeated ids are told apart
    found = near_duplicates(marked.select(F.col("__row").alias("doc_id"), "text"))
    ids = marked.select(F.col("__row").alias("row"), "doc_id").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    rows = stored(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct().join(ids, "row"))
    kept = rows.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))["row"].alias("row")
    )
    fate = stored(rows.join(kept.select("row", F.lit(True).alias("kept")), "row", "left").select(F.col("row").alias("__row"), "n", F.coalesce("kept", F.lit(False)).alias("kept")))
    # most rows stay where they are read; only rows that occur more than once meet
    single = without(marked, fate.filter("not kept or n > 1"), ["__row"])
    several = fate.filter("kept and n > 1").select("__row")
    repeated = likely(marked, several, ["__row"]).join(several, "__row", "left_semi").dropDuplicates(["__row"])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
