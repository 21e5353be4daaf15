"""A hierarchical navigable small-world graph over the vectors of one shard, as flat numpy arrays."""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np

LINKS = 16
# Nearest earlier vectors among which links are chosen, and beam width of a search.
BUILD = 64
BEAM = 128
_BATCH = 256
_STEP = 4


@dataclass(frozen=True)
class Graph:
    """``vectors`` in order of insertion; per layer the members and their padded neighbour rows (-1).

    Layer 0 holds all vectors. ``place`` maps a vector to its row in the layer, -1 if it is absent.
    """

    vectors: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{k}{i}": a for i, layer in enumerate(self.layers) for k, a in zip("mnp", layer)}
        np.savez(out, vectors=self.vectors, **arrays)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Graph:
        found = np.load(io.BytesIO(data))
        depth = sum(name.startswith("m") for name in found.files)
        return Graph(found["vectors"], [tuple(found[f"{k}{i}"] for k in "mnp") for i in range(depth)])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _diverse(points: np.ndarray, around: np.ndarray, ids: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Choose up to ``keep`` neighbours per row among ``ids`` (-1 padded, nearest first).

    A candidate is taken if it is nearer to the row's point than to every neighbour taken before,
    so links lead in different directions.
    """
    rows, width = ids.shape
    own = points[np.maximum(ids, 0)]
    norms = (own * own).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    nearest = np.full((rows, width), np.inf, np.float32)
    number = np.zeros(rows, int)
    for c in range(width):
        good = (ids[:, c] >= 0) & (number < keep) & (dist[:, c] < nearest[:, c])
        taken[:, c] = good
        number += good
        nearest[good] = np.minimum(nearest[good], between[good, c])
    # fill up with the nearest that were passed over
    rank = np.where(taken, 0, 1) * width + np.arange(width)
    rank[ids < 0] = 3 * width
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1)


def _link(points: np.ndarray, links: int) -> np.ndarray:
    """Neighbour rows of one layer: vectors are inserted in order and linked to earlier ones."""
    n = len(points)
    table = np.full((n, links), -1, np.int32)
    for begin in range(0, n, _BATCH):
        end = min(n, begin + _BATCH)
        dist = _squared(points[begin:end], points[:end])
        dist[np.arange(end)[None] >= np.arange(begin, end)[:, None]] = np.inf
        width = min(BUILD, end)
        near = np.argpartition(dist, width - 1, axis=1)[:, :width] if width < end else np.tile(np.arange(end), (end - begin, 1))
        order = np.argsort(np.take_along_axis(dist, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        gaps = np.take_along_axis(dist, near, 1)
        ids = np.where(np.isfinite(gaps), near, -1)
        chosen = _diverse(points, points[begin:end], ids, gaps, max(1, links // 2))
        table[begin:end, : chosen.shape[1]] = chosen
        _link_back(points, table, np.arange(begin, end), chosen)
    return table


def _link_back(points: np.ndarray, table: np.ndarray, sources: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse links; rows that overflow keep a diverse choice of old and new neighbours."""
    source = np.repeat(sources, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rows, starts, counts = np.unique(target, return_index=True, return_counts=True)
    if not len(rows):
        return
    wide = np.full((len(rows), table.shape[1] + counts.max()), -1, np.int64)
    wide[:, : table.shape[1]] = table[rows]
    at = np.repeat(np.arange(len(rows)), counts)
    wide[at, table.shape[1] + np.arange(len(target)) - np.repeat(starts, counts)] = source
    for a in range(0, len(rows), _BATCH):
        part, own = wide[a : a + _BATCH], rows[a : a + _BATCH]
        gaps = ((points[np.maximum(part, 0)] - points[own][:, None]) ** 2).sum(2)
        gaps[part < 0] = np.inf
        order = np.argsort(gaps, axis=1, kind="stable")[:, : 2 * table.shape[1]]
        ids = np.take_along_axis(part, order, 1)
        best = _diverse(points, points[own], ids, np.take_along_axis(gaps, order, 1), table.shape[1])
        table[own, : best.shape[1]] = best


def build(vectors: np.ndarray, links: int = LINKS) -> Graph:
    """Build the layers; a vector's highest layer is geometric with ratio 1 / links."""
    vectors = np.ascontiguousarray(vectors, np.float32)
    draw = np.random.default_rng(7).random(len(vectors))
    level = np.floor(-np.log1p(-draw) / math.log(links)).astype(int)
    if len(level):
        level[0] = level.max()
    layers = []
    for k in range(level.max() + 1 if len(level) else 0):
        members = np.flatnonzero(level >= k).astype(np.int32)
        place = np.full(len(vectors), -1, np.int32)
        place[members] = np.arange(len(members))
        rows = _link(vectors[members], links * 2 if k == 0 else links)
        layers.append((members, np.where(rows >= 0, members[np.maximum(rows, 0)], -1).astype(np.int32), place))
    return Graph(vectors, layers)


def _beam(g: Graph, queries: np.ndarray, layer: int, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` vectors of a layer per query, nearest first, for all queries in step."""
    _, neighbours, place = g.layers[layer]
    n, many = len(g.vectors), len(queries)
    ids = np.full((many, beam), n, np.int64)
    dist = np.full((many, beam), np.inf, np.float32)
    ids[:, 0] = start
    dist[:, 0] = ((g.vectors[start] - queries) ** 2).sum(1)
    done = np.ones((many, beam), bool)
    done[:, 0] = False
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True
    seen[np.arange(many), start] = True
    active = np.arange(many)
    while len(active):
        # kept sorted by distance: the first open entries are the best ones
        rank = np.cumsum(~done[active], axis=1)
        pick = ~done[active] & (rank <= _STEP)
        done[active] |= pick
        spread = np.argsort(~pick, axis=1, kind="stable")[:, : min(_STEP, beam)]
        chosen = np.where(np.take_along_axis(pick, spread, 1), np.take_along_axis(ids[active], spread, 1), n)
        rows = np.where((chosen < n)[:, :, None], neighbours[place[np.minimum(chosen, n - 1)]], -1).reshape(len(active), -1)
        rows = np.sort(np.where(rows < 0, n, rows), axis=1)
        fresh = ~np.take_along_axis(seen[active], rows, 1)
        fresh[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        rows = np.where(fresh, rows, n)
        seen[active[:, None], rows] = True
        gaps = np.full(rows.shape, np.inf, np.float32)
        q, c = np.nonzero(fresh)
        gaps[q, c] = ((g.vectors[rows[q, c]] - queries[active[q]]) ** 2).sum(1)
        every = np.concatenate([dist[active], gaps], 1)
        order = np.argsort(every, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(every, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], rows], 1), order, 1)
        fresh_done = np.concatenate([done[active], ~fresh], 1)
        done[active] = np.take_along_axis(fresh_done, order, 1)
        active = active[(~done[active]).any(1)]
    return ids, dist


def search(g: Graph, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """Places of about the ``k`` nearest vectors of each query, nearest first; -1 where there are fewer."""
    if not len(g.vectors) or not len(queries):
        return np.full((len(queries), k), -1, np.int64)
    start = np.zeros(len(queries), np.int64)
    queries = queries.astype(np.float32)
    for layer in range(len(g.layers) - 1, 0, -1):
        start = _beam(g, queries, layer, start, 4)[0][:, 0]
    ids = _beam(g, queries, 0, start, max(k, beam))[0][:, :k]
    return np.where(ids < len(g.vectors), ids, -1)
