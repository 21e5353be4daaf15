"""Embedding near-duplicates by spherical-cap filters.

A filter is a cap around a direction; a vector lies in all filters whose direction it exceeds the
threshold with, and vectors with a large cosine share some of them. The directions are a random
product code: after a structured rotation (signs and Hadamard steps) a direction is one short code
word for each part of the vector, so the exceeding directions are decoded from a few lists of part scores
instead of being compared one by one. Vectors are joined on filters, and every pair found is
verified in double precision. Several codes with different rotations make the number of shared filters even.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import small, stored
from runlore.llm.components import components
from runlore.llm.streams import groups
from runlore.operators.ordered import join_facts

COSINE = 0.95
# Vectors without structure that share a filter, and filters of a vector, on average. The threshold follows
# from the number of vectors, so both stay the same at every size.
BUCKET = 32
LOAD = 26
CODES = 32
# The widest and the narrowest cap: shares of the sphere, and the cosine at its rim.
WIDEST = 0.02
NARROWEST = 0.9
# Members of a filter that are compared in one step; larger filters are cut into tiles of this size.
TILE = 2048
SEED = 12
_BORDER = 1e-9
_STEP = 1 << 22


def usable(vector: Column) -> Column:
    """Whether a vector can be linked: not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, times a power of two, so that squares neither overflow nor vanish."""
    rows = vectors.astype(np.float64)
    _, power = np.frexp(np.abs(rows).max(1))
    return np.ldexp(rows, -power[:, None])


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows."""
    a, b = scaled(left), scaled(right)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


# --- the code -----------------------------------------------------------------------------------


def _width(dim: int) -> int:
    return 1 << max(0, (dim - 1).bit_length())


def cap_share(width: int, rim: np.ndarray) -> np.ndarray:
    """Share of the sphere in ``width`` dimensions whose cosine with a direction is at least ``rim``."""
    if width == 1:
        return np.full(len(rim), 0.5)
    angles = np.linspace(0, np.pi, 20001)
    density = np.sin(angles) ** (width - 2)
    upto = np.cumsum(density) / density.sum()
    return np.interp(np.arccos(rim), angles, upto)


@cache
def _plan(dim: int, number: int) -> tuple[float, int, int]:
    """Rim, parts and words per part of the code for ``number`` vectors."""
    width = _width(dim)
    rims = np.linspace(0.05, NARROWEST, 4000)
    shares = cap_share(width, rims)
    rim = float(rims[np.argmax(shares <= max(BUCKET / max(number, 1), 0.0))]) if shares[-1] <= BUCKET / max(number, 1) else NARROWEST
    if BUCKET / max(number, 1) > WIDEST:
        rim = float(rims[np.argmax(shares <= WIDEST)]) if shares[-1] <= WIDEST else NARROWEST
    filters = LOAD / float(cap_share(width, np.array([rim]))[0])
    parts = 1 if width < 16 else 2
    words = math.ceil((filters / CODES) ** (1 / parts))
    if words > 4096 and width >= 48:
        parts, words = 3, math.ceil((filters / CODES) ** (1 / 3))
    return rim, parts, max(2, words)


@cache
def _code(dim: int, parts: int, words: int, number: int) -> tuple[np.ndarray, list[tuple[slice, np.ndarray]]]:
    """Signs of three Hadamard steps and, for each part, its place and its code words."""
    pick = np.random.default_rng([SEED, dim, number])
    width = _width(dim)
    signs = pick.choice([-1.0, 1.0], (3, width))
    cuts = np.linspace(0, width, parts + 1).astype(int)
    lists = []
    for low, high in zip(cuts, cuts[1:]):
        table = pick.normal(size=(words, high - low))
        table /= np.linalg.norm(table, axis=1)[:, None] * math.sqrt(parts)
        lists.append((slice(low, high), table))
    return signs, lists


def rotated(rows: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows padded to a power of two, turned by sign flips and Walsh-Hadamard steps."""
    width = signs.shape[1]
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    for flip in signs:
        out *= flip
        half = 1
        while half < width:
            pair = out.reshape(len(rows), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(rows), width)
            half *= 2
        out /= math.sqrt(width)
    return out


def decoded(rows: np.ndarray, dim: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that unit ``rows`` exceed, rows in order, filters ascending.

    A partial word is kept while the best words of the remaining parts could still lift it over the
    rim, so nothing that exceeds is missed and little else is looked at.
    """
    rim, parts, words = _plan(dim, number)
    found_rows, found_ids = [], []
    for code in range(CODES):
        signs, lists = _code(dim, parts, words, code)
        turned = rotated(rows, signs)
        scores = [turned[:, place] @ table.T for place, table in lists]
        best = np.stack([s.max(1) for s in scores])
        at = np.arange(len(rows))
        total, ids = np.zeros(len(rows)), np.full(len(rows), code, np.int64)
        for part, score in enumerate(scores):
            rest = best[part + 1 :].sum(0)
            kept = []
            step = max(1, _STEP // words)
            for low in range(0, len(at), step):
                own = slice(low, low + step)
                sums = total[own, None] + score[at[own]]
                i, word = np.nonzero(sums >= (rim - rest[at[own]])[:, None])
                kept.append((at[own][i], sums[i, word], ids[own][i] * words + word))
            at, total, ids = (np.concatenate([k[n] for k in kept]) for n in range(3)) if kept else (at, total, ids)
        found_rows.append(at)
        found_ids.append(ids * CODES + code)
    at, ids = np.concatenate(found_rows), np.concatenate(found_ids)
    order = np.lexsort((ids, at))
    return at[order], ids[order]


# --- Spark --------------------------------------------------------------------------------------


def _placed(number: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("vector").value_lengths())
            lists: list = [[]] * len(batch)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                rows = scaled(np.asarray(batch.column("vector").take(pa.array(own)).flatten()).reshape(len(own), dim))
                at, ids = decoded(rows / np.linalg.norm(rows, axis=1)[:, None], dim, number)
                ends = np.searchsorted(at, np.arange(len(own) + 1))
                for k, place in enumerate(own.tolist()):
                    lists[place] = ids[ends[k] : ends[k + 1]]
            columns = [batch.column("node"), batch.column("weight"), pa.array(lengths, pa.int32()), batch.column("vector")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lists, pa.list_(pa.int64()))], names=["node", "weight", "dim", "vector", "filters"]
            )

    return run


def _incidence(members: list[tuple[np.ndarray, np.ndarray]], below: int) -> list[np.ndarray]:
    """For each side, members x filters below this one that at least two members lie in."""
    flat = np.concatenate([f for f, _ in members])
    names, seen = np.unique(flat[flat < below], return_counts=True)
    names = names[seen > 1]
    out = []
    for values, lengths in members:
        table = np.zeros((len(lengths), len(names)), np.float32)
        if len(names):
            place = np.minimum(np.searchsorted(names, values), len(names) - 1)
            hit = names[place] == values
            table[np.repeat(np.arange(len(lengths)), lengths)[hit], place[hit]] = 1
        out.append(table)
    return out


def _side(group: dict, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    dim = int(group["dim"][0])
    flat, lengths = group["filters"]
    member = np.repeat(own, lengths)
    return group["node"][own], group["weight"][own], group["vector"][0].reshape(-1, dim)[own], (flat[member], lengths[own])


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the symmetric relation ``linked``."""
    found, open_ = [], np.ones(len(linked), bool)
    for first in np.flatnonzero(linked.any(1)).tolist():
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(linked[at] & open_)
            open_[near] = False
            found += [(at, x) for x in near.tolist()]
            queue += near.tolist()
    return found


def _compare(group: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Edges of a spanning forest and links counted here, for one tile or a pair of tiles of a filter.

    A pair that shares several filters counts in the smallest of them only.
    """
    side = group["side"]
    alike = int(group["i"][0]) == int(group["j"][0])
    if len(side) < 2:
        return None
    parts = [_side(group, np.ones(len(side), bool))] if alike else [_side(group, side == 0), _side(group, side == 1)]
    left, right = parts[0], parts[-1]
    if not len(left[0]) or not len(right[0]):
        return None
    units = [(lambda s: s / np.linalg.norm(s, axis=1)[:, None])(scaled(p[2])) for p in parts]
    close = units[0] @ units[-1].T
    linked = close >= cosine
    p, q = np.nonzero(np.abs(close - cosine) < _BORDER)
    if len(p):
        linked[p, q] = cosines(left[2][p], right[2][q]) >= cosine
    if alike:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    tables = _incidence([p[3] for p in parts], int(group["filter"][0]))
    here = linked & (tables[0] @ tables[-1].T == 0)
    counts = [(left[0], here @ right[1].astype(np.float64))]
    if alike:
        edges = [(left[0][a], left[0][b]) for a, b in _forest(linked)]
    else:
        counts.append((right[0], here.T @ left[1].astype(np.float64)))
        rows = len(left[0])
        both = np.zeros((rows + len(right[0]),) * 2, bool)
        both[:rows, rows:], both[rows:, :rows] = linked, linked.T
        names = np.concatenate([left[0], right[0]])
        edges = [(names[a], names[b]) for a, b in _forest(both)]
    node, n = np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts]).astype(np.int64)
    return np.array(edges, np.int64).reshape(-1, 2), node[n > 0], n[n > 0]


_KEYS = ("dim", "filter", "i", "j")


def _verified(cosine: float) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, _KEYS):
            found = _compare(group, cosine)
            if found is not None:
                edges, node, n = found
                none = [None] * len(edges)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([edges[:, 0], node])),
                        pa.array([*edges[:, 1].tolist(), *[None] * len(node)], pa.int64()),
                        pa.array([*none, *n.tolist()], pa.int64()),
                    ],
                    schema=schema,
                )

    return run


def links(nodes: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Rows (a, b, null): edges that connect what is linked; rows (a, null, n): links of node a.

    ``nodes`` are distinct directions (node, weight, vector); a link to a node counts its weight. A filter
    with more than ``tile`` members is compared in tiles and pairs of tiles, so every pair of
    members meets, and each tile gives a spanning forest, not all its pairs.
    """
    number = nodes.count()
    schema = f"node long, weight long, dim int, vector {nodes.schema['vector'].dataType.simpleString()}, filters array<bigint>"
    placed = stored(nodes.select("node", "weight", "vector").mapInArrow(_placed(number), schema))
    exploded = placed.select("*", F.explode("filters").alias("filter"))
    hot = stored(exploded.groupBy("dim", "filter").count().filter(F.col("count") > tile))
    tiles = F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int")
    members = exploded.join(small(hot), ["dim", "filter"], "left").withColumn("g", tiles)
    other = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    )
    met = other.select(
        "dim", "filter",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node", "weight", "vector", "filters",
    )
    return met.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_verified(cosine), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding).

    Equal vectors are one node with their number as weight, so copies are never expanded; rows with the
    same id are separate vectors. Vectors of different lengths aren't linked. Rows that are not ``usable`` link
    with nothing and are kept. Rows without an id take part but never name a component that has an id.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    own = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", own.alias("vector"))
    good = rows.filter(usable(F.col("vector")))
    name = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2")]
    named = good.select("vec_id", *name, "vector")
    nodes = stored(
        named.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    found = stored(links(nodes, cosine, tile))
    labels = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labelled = stored(
        nodes.select("h1", "h2", "node", "weight", "first_id")
        .join(counts, "node", "left")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    per_node = labelled.join(smallest, "label").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    linked = join_facts(named.drop("vector"), per_node, ["h1", "h2"], "vec_id", spread=True).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    return near_duplicates(vectors.select("vec_id", "embedding"))


OP12_SQL = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT * FROM good
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM usable AS a JOIN usable AS b
  ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT r AS a, r AS b FROM good UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT good.vec_id, (SELECT count(*) FROM links WHERE links.a = good.r) AS n_links, min(other.vec_id) AS component_id,
  good.vec_id IS NOT DISTINCT FROM min(other.vec_id) AS kept
FROM good JOIN reach ON reach.a = good.r JOIN good AS other ON other.r = reach.b
GROUP BY good.r, good.vec_id
"""
