"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. The angle between two rows is at least the
largest difference and at most the smallest sum of their angles to one reference, which gives an
interval of cosines and, times the norms, of scores. Rows are packed into blocks of neighbours, and
blocks know the ranges of their rows' angles and norms, so most pairs of blocks are ruled out before
anything is moved; in the rest the intervals of the rows decide, and only rows whose interval meets an
anchor's window get their integer scores. Bounds are widened by more than the rounding error, so no result depends on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import stored
from runlore.llm.streams import groups

GRID = 256
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
# Share of the positive's score, in hundredths, at which a negative is hard but still no positive.
LOW, HIGH = 50, 95
REFERENCES = 8
# Rows of a block, of candidates and of anchors.
BLOCK = 4096
# Larger grid values could give scores beyond 64 bits.
LIMIT = 1 << 27
# Angles are stored as floats; a widening above their rounding and that of the arc cosine.
_ANGLE = 1e-5
_EXACT = 1 << 53


def grid(vector: Column) -> Column:
    """Components on the integer grid: floor(256 x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * GRID))


def candidates_of(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (integers) of the rows of (vec_id, label, embedding) that take part, each once.

    Not the rows without an id, label or vector, with a null or non-finite component, or with a grid
    value of LIMIT or more, whose scores need not be 64-bit numbers. Zero vectors take part.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / GRID))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), grid(F.col("embedding")).cast("array<int>").alias("vector")
    ).distinct()


def reference_directions(rows: DataFrame, count: int = REFERENCES) -> dict[int, np.ndarray]:
    """By dimension, the unit vectors of the ``8 * count`` rows of smallest hash, at most ``count`` for each.

    They come from the data, because angles to random directions hardly differ. Any choice gives right bounds.
    """
    some = rows.filter(F.exists("vector", lambda x: x != 0)).withColumn("h", F.xxhash64("vec_id", "vector"))
    taken: dict[int, list] = {}
    for row in some.orderBy("h", "vec_id").limit(8 * count).select("vector").collect():
        taken.setdefault(len(row.vector), []).append(row.vector)
    units = {}
    for dim, found in taken.items():
        table = np.array(found[:count], np.float64)
        units[dim] = table / np.linalg.norm(table, axis=1)[:, None]
    return units


def _angles(rows: np.ndarray, units: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to the references; a zero row has angle 0, its norm makes every bound 0."""
    values = rows.astype(np.float64)
    norms = np.sqrt((values * values).sum(1))
    if units is None:
        return norms, np.zeros((len(rows), 0), np.float32)
    cosines = (values @ units.T) / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


_MEASURED = "vec_id long, label long, vector array<int>, dim int, norm double, angles array<float>, cell int, near float"


def _measured(units: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("vector").value_lengths())
            norm, cell, near = np.zeros(len(lengths)), np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.float32)
            angles: list = [[]] * len(lengths)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                flat = np.asarray(batch.column("vector").take(pa.array(own)).flatten())
                norms, table = _angles(flat.reshape(len(own), dim), units.get(dim))
                norm[own] = norms
                if table.shape[1]:
                    cell[own], near[own] = table.argmin(1), table.min(1)
                for place, values in zip(own.tolist(), table):
                    angles[place] = values
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("vec_id", "label", "vector")],
                    pa.array(lengths, pa.int32()), pa.array(norm), pa.array(angles, pa.list_(pa.float32())), pa.array(cell), pa.array(near),
                ],
                names=["vec_id", "label", "vector", "dim", "norm", "angles", "cell", "near"],
            )

    return run


_PACKED = pa.schema(
    [
        ("dim", pa.int32()),
        ("labels", pa.list_(pa.int64())),
        ("norms", pa.list_(pa.float64())),
        ("low", pa.list_(pa.float32())),
        ("high", pa.list_(pa.float32())),
        ("rows", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_BLOCKS = "dim int, labels array<bigint>, norms array<double>, low array<float>, high array<float>, rows bigint, payload binary"


def _load(payload: bytes, dim: int, rows: int) -> tuple[np.ndarray, ...]:
    """vec_id, label, norm, angles and vectors of a block."""
    at, out = 0, []
    for kind in (np.int64, np.int64, np.float64):
        out.append(np.frombuffer(payload, kind, rows, at))
        at += 8 * rows
    vectors = np.frombuffer(payload, np.int32, rows * dim, at).reshape(rows, dim)
    at += 4 * rows * dim
    angles = np.frombuffer(payload, np.float32, -1, at)
    return (*out, angles.reshape(rows, -1), vectors)


def _packed(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["dim"]):
            dim, total = int(group["dim"][0]), len(group["vec_id"])
            vectors = group["vector"][0].reshape(total, dim)
            angles = np.asarray(group["angles"][0], np.float32).reshape(total, -1)
            norm = np.asarray(group["norm"], np.float64)
            for low in range(0, total, size):
                own = slice(low, min(low + size, total))
                ids, labels = group["vec_id"][own], group["label"][own]
                payload = b"".join(
                    np.ascontiguousarray(a).tobytes()
                    for a in (ids.astype(np.int64), labels.astype(np.int64), norm[own], vectors[own].astype(np.int32), angles[own])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dim], pa.int32()),
                        pa.array([[int(labels.min()), int(labels.max())]], pa.list_(pa.int64())),
                        pa.array([[float(norm[own].min()), float(norm[own].max())]], pa.list_(pa.float64())),
                        pa.array([angles[own].min(0)], pa.list_(pa.float32())),
                        pa.array([angles[own].max(0)], pa.list_(pa.float32())),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([payload], pa.binary()),
                    ],
                    schema=_PACKED,
                )

    return run


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows packed ``size`` at a time, neighbours by label, nearest reference and angle to it, with their ranges.

    Order and ranges only decide what can be skipped. ``block`` numbers the blocks.
    """
    order = ["dim", "label", "cell", "near", "vec_id"]
    number = rows.count()
    parts = max(1, math.ceil(number / (8 * size)))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(_packed(size), _BLOCKS).withColumn("block", F.monotonically_increasing_id()))


# --- bounds ---------------------------------------------------------------------------------------


def interval(left_angles, right_angles, left_norms, right_norms) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all pairs of rows, wide enough for rounding.

    Two directions are at least as far apart as their angles to a reference differ, at most as far as
    these add up to, and with the reference they go no more than once around.
    """
    gap = np.zeros((len(left_norms), len(right_norms)), np.float32)
    reach = np.full(gap.shape, np.pi, np.float32)
    for k in range(left_angles.shape[1]):
        a, b = left_angles[:, k, None], right_angles[None, :, k]
        np.maximum(gap, np.abs(a - b), out=gap)
        both = a + b
        np.minimum(reach, np.minimum(both, np.float32(2 * np.pi) - both), out=reach)
    size = left_norms[:, None] * right_norms[None, :]
    slack = size * 1e-9 + 1e-6
    high = np.cos(np.maximum(gap - _ANGLE, 0), dtype=np.float64) * size + slack
    low = np.cos(np.minimum(np.maximum(reach, gap) + _ANGLE, np.pi), dtype=np.float64) * size - slack
    return low, high


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs of rows. Floating point is used where every sum is exact in it."""
    bound = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < _EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


_NONE = np.iinfo(np.int64).min


class Best:
    """The ``k`` highest (score, then smaller id) of each of a number of places."""

    def __init__(self, places: int, k: int):
        self.k = k
        self.score = np.full((places, k), _NONE)
        self.id = np.zeros((places, k), np.int64)

    def floor(self, places: np.ndarray) -> np.ndarray:
        """The score a newcomer must reach; the smallest number while there is room."""
        return self.score[places, -1]

    def add(self, places: np.ndarray, kept: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``found`` (places x ids) where ``kept``."""
        if kept.shape[1] > self.k:
            least = np.partition(np.where(kept, found, _NONE), -self.k, axis=1)[:, -self.k]
            kept = kept & (found >= least[:, None])
        at, column = np.nonzero(kept)
        if not len(at):
            return
        touched = np.unique(at)
        own = self.score[places[touched]] > _NONE
        row, slot = np.nonzero(own)
        at = np.concatenate([at, touched[row]])
        score = np.concatenate([found[kept], self.score[places[touched]][row, slot]])
        name = np.concatenate([ids[column], self.id[places[touched]][row, slot]])
        order = np.lexsort((name, -score, at))
        at, score, name = at[order], score[order], name[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        first = rank < self.k
        self.score[places[at[first]], rank[first]] = score[first]
        self.id[places[at[first]], rank[first]] = name[first]

    def of(self, place: int) -> list[dict]:
        held = self.score[place] > _NONE
        return [{"score": int(s), "id": int(i)} for s, i in zip(self.score[place][held], self.id[place][held])]


_SLICE = 256


class _Positives:
    """Nearest rows of the same label for the anchors of one block."""

    def __init__(self, anchors: tuple, known: list | None):
        self.anchors = anchors
        self.best = Best(len(anchors[0]), POSITIVES)

    def meet(self, rows: tuple) -> None:
        ids, labels, norms, angles, vectors = self.anchors
        for low in range(0, len(ids), _SLICE):
            own = np.arange(low, min(low + _SLICE, len(ids)))
            _, high = interval(angles[own], rows[3], norms[own], rows[2])
            maybe = (labels[own, None] == rows[1]) & (ids[own, None] != rows[0]) & (high >= self.best.floor(own)[:, None])
            i, j = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
            if len(i):
                found = scores(vectors[own[i]], rows[4][j])
                self.best.add(own[i], maybe[np.ix_(i, j)] & (found >= self.best.floor(own[i])[:, None]), found, rows[0][j])

    def rows(self, block: int) -> Iterator[dict]:
        for place in range(len(self.anchors[0])):
            yield {"anchors": block, "at": place, "found": self.best.of(place)}


class _Negatives:
    """Best rows of other labels within the window of each positive of the anchors of one block."""

    def __init__(self, anchors: tuple, known: list | None):
        self.anchors = anchors
        self.known = [k["found"] for k in sorted(known or [], key=lambda k: k["at"])]
        count = len(anchors[0])
        self.low, self.high = np.ones((POSITIVES, count), np.int64), np.zeros((POSITIVES, count), np.int64)
        for at, found in enumerate(self.known):
            for p, one in enumerate(found):
                self.low[p, at], self.high[p, at] = window(one["score"])
        self.best = [Best(count, NEGATIVES) for _ in range(POSITIVES)]

    def meet(self, rows: tuple) -> None:
        ids, labels, norms, angles, vectors = self.anchors
        for start in range(0, len(ids), _SLICE):
            own = np.arange(start, min(start + _SLICE, len(ids)))
            low, high = interval(angles[own], rows[3], norms[own], rows[2])
            other = labels[own, None] != rows[1]
            maybe = []
            for p, best in enumerate(self.best):
                least, most = np.maximum(self.low[p, own], best.floor(own)), self.high[p, own]
                maybe.append(other & (high >= least[:, None]) & (low <= most[:, None]) & (least <= most)[:, None])
            either = np.logical_or.reduce(maybe)
            i, j = np.flatnonzero(either.any(1)), np.flatnonzero(either.any(0))
            if not len(i):
                continue
            found = scores(vectors[own[i]], rows[4][j])
            for p, best in enumerate(self.best):
                least, most = np.maximum(self.low[p, own[i]], best.floor(own[i])), self.high[p, own[i]]
                best.add(own[i], maybe[p][np.ix_(i, j)] & (found >= least[:, None]) & (found <= most[:, None]), found, rows[0][j])

    def rows(self, block: int) -> Iterator[dict]:
        for at, found in enumerate(self.known):
            for p, one in enumerate(found):
                negatives = self.best[p].of(at)
                if negatives:
                    head = {"anchors": block, "at": at, "p": p, "anchor_id": int(self.anchors[0][at])}
                    yield head | {"positive_id": one["id"], "positive_score": one["score"], "found": negatives}


def window(score: int) -> tuple[int, int]:
    """Least and greatest score of a hard negative; empty for negative scores."""
    return -(-LOW * score // 100), HIGH * score // 100


_FOUND = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
_FOUND_SQL = "array<struct<score:bigint,id:bigint>>"


def _streamed(kind, schema: pa.Schema) -> Callable:
    """Read, for each (anchors, part), the anchors' record and then one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def flush():
            rows = [] if state is None else list(state.rows(key[0]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["anchors"], row["part"]) != key:
                    yield from flush()
                    key, state = (row["anchors"], row["part"]), None
                loaded = _load(row["payload"], row["dim"], row["rows"])
                if row["first"] == 0:
                    state = kind(loaded, row["known"])
                else:
                    state.meet(loaded)
        yield from flush()

    return run


def _pairs(anchors: DataFrame, rows: DataFrame, chunks: int) -> DataFrame:
    """(anchors, block, low, high): pairs of blocks with bounds of the scores of their rows.

    Only the blocks' ranges meet, a few numbers for thousands of rows.
    """
    eps, pi = F.lit(_ANGLE), F.lit(math.pi)
    left = anchors.select(
        "dim", F.col("block").alias("anchors"), F.col("labels").alias("l1"), F.col("norms").alias("n1"), F.col("low").alias("a1"), F.col("high").alias("b1"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )
    right = rows.select(
        "dim", "block", F.col("labels").alias("l2"), F.col("norms").alias("n2"), F.col("low").alias("a2"), F.col("high").alias("b2"),
        F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    met = left.join(right, ["dim", "chunk"])
    after, before = F.zip_with("a1", "b2", lambda x, y: x - y), F.zip_with("a2", "b1", lambda x, y: x - y)
    gap = F.greatest(F.lit(0.0), F.coalesce(F.array_max(after), F.lit(0.0)), F.coalesce(F.array_max(before), F.lit(0.0)))
    far = F.coalesce(F.array_min(F.zip_with("b1", "b2", lambda x, y: x + y)), pi)
    around = F.coalesce(2 * pi - F.array_max(F.zip_with("a1", "a2", lambda x, y: x + y)), pi)
    least, most = F.col("n1")[0] * F.col("n2")[0], F.col("n1")[1] * F.col("n2")[1]
    top, bottom = F.cos(F.greatest(gap - eps, F.lit(0.0))), F.cos(F.least(F.greatest(F.least(far, around), gap) + eps, pi))
    slack = most * 1e-9 + 1e-6
    return met.select(
        "dim", "anchors", "block", "l1", "l2",
        (F.when(bottom >= 0, bottom * least).otherwise(bottom * most) - slack).alias("low"),
        (F.when(top >= 0, top * most).otherwise(top * least) + slack).alias("high"),
    )


def _records(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, known: DataFrame | None, parts: int, tasks: int) -> DataFrame:
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    placed = stored(pairs.select("anchors", "block", part, F.col("high")))
    kind = f"array<struct<at:int,found:{_FOUND_SQL}>>"
    heads = placed.select("anchors", "part").distinct().join(anchors.withColumnRenamed("block", "anchors"), "anchors")
    heads = heads.withColumn("known", F.lit(None).cast(kind)) if known is None else heads.join(known, "anchors")
    head = heads.select("anchors", "part", F.lit(0).alias("first"), F.lit(0.0).alias("order"), "dim", "rows", "payload", F.col("known").cast(kind).alias("known"))
    body = placed.join(rows.select("block", "dim", "rows", "payload"), "block").select(
        "anchors", "part", F.lit(1).alias("first"), (-F.col("high")).alias("order"), "dim", "rows", "payload", F.lit(None).cast(kind).alias("known")
    )
    return head.unionByName(body).repartition(tasks, "anchors", "part").sortWithinPartitions("anchors", "part", "first", "order")


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    ordered = F.array_sort(F.transform(F.flatten(F.collect_list("found")), lambda f: F.struct((-f["score"]).alias("back"), f["id"].alias("id"))))
    best = F.transform(F.slice(ordered, 1, k), lambda f: F.struct((-f["back"]).alias("score"), f["id"].alias("id")))
    return found.groupBy(*keys).agg(best.alias("found"))


def hard_negatives(vectors: DataFrame, every: int = EVERY, size: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows of (vec_id, label, embedding) whose vec_id is divisible by ``every``; all rows
    are candidates, except those of the anchor's own id. A positive is one of the anchor's POSITIVES
    best rows of its label, a negative one of the NEGATIVES best rows of another label with LOW to HIGH
    hundredths of the positive's score; ties go to the smaller vec_id. Equal rows count once; of an id with
    several vectors each is a row of its own. Vectors of different lengths do not meet. A positive with
    a negative score has no negatives. See ``candidates_of`` for rows that take no part.

    A task holds one block of anchors and their best rows so far, and reads the other blocks one at a time.
    """
    spark = vectors.sparkSession
    plain = stored(candidates_of(vectors))
    units = reference_directions(plain)
    rows = stored(plain.mapInArrow(_measured(units), _MEASURED))
    packed, anchors = blocks(rows, size), blocks(rows.filter(F.col("vec_id") % every == 0), size)
    several, many = max(1, anchors.count()), max(1, packed.count())
    cores = spark.sparkContext.defaultParallelism
    parts = min(many, max(1, math.ceil(2 * cores / several)))
    tasks = min(several * parts, 64 * cores)
    pairs = stored(_pairs(anchors, packed, max(1, math.ceil(many / 1000))))

    same = pairs.filter((F.col("l1")[0] <= F.col("l2")[1]) & (F.col("l2")[0] <= F.col("l1")[1]))
    schema = pa.schema([("anchors", pa.int64()), ("at", pa.int32()), ("found", _FOUND)])
    near = _records(anchors, packed, same, None, parts, tasks).mapInArrow(
        _streamed(_Positives, schema), f"anchors long, at int, found {_FOUND_SQL}"
    )
    positives = _merged(near, ["anchors", "at"], POSITIVES)
    known = stored(positives.groupBy("anchors").agg(F.collect_list(F.struct("at", "found")).alias("known")))

    found = F.flatten(F.transform("known", lambda k: F.transform(k["found"], lambda f: f["score"])))
    above = F.filter(found, lambda s: s >= 0)
    windows = known.select("anchors", (F.array_min(above) * LOW / 100).alias("from"), (F.array_max(above) * HIGH / 100).alias("to"))
    single = (F.col("l1")[0] == F.col("l1")[1]) & (F.col("l2")[0] == F.col("l2")[1]) & (F.col("l1")[0] == F.col("l2")[0])
    open_ = pairs.filter(~single).join(windows, "anchors").filter((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")))
    schema = pa.schema(
        [("anchors", pa.int64()), ("at", pa.int32()), ("p", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()),
         ("positive_score", pa.int64()), ("found", _FOUND)]
    )
    mined = _records(anchors, packed, open_, known, parts, tasks).mapInArrow(
        _streamed(_Negatives, schema),
        f"anchors long, at int, p int, anchor_id long, positive_id long, positive_score long, found {_FOUND_SQL}",
    )
    best = _merged(mined, ["anchors", "at", "p", "anchor_id", "positive_id", "positive_score"], NEGATIVES)
    return best.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("pos", "f")).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("f")["id"].alias("negative_id"),
        "positive_score", F.col("f")["score"].alias("negative_score"),
    )


def op13(vectors: DataFrame) -> DataFrame:
    """The hard negatives of the table with the labels of every seventh id moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"))


OP13_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
