"""Approximate nearest neighbours: one small-world graph per shard, results of all shards merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm import hnsw
from runlore.llm.common import stored

# Distinct vectors of a shard and queries of a block, on average.
SHARD = 4096
BLOCK = 1024
NEAREST = 10
EVERY = 100
_SALTS = 1024
# Scaled components beyond this are not walked with.
_FAR = 1e15


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """vector and its ``ids`` smallest vec_ids, sorted; equal rows count once, rows without an id never.

    More ids of one vector can never be among a query's nearest, because ties go to smaller ids. A
    vector that very many rows share is gathered by salts first.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.col("embedding").alias("vector"), F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt")
    )
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, ids)
    salted = rows.groupBy("vector", "salt").agg(least(F.collect_list("vec_id")).alias("ids"))
    return salted.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows, in the precision they come in."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares overflow or vanish."""
    with np.errstate(over="ignore", under="ignore"):
        gaps = rows.astype(np.float64) - query.astype(np.float64)
        plain = np.sqrt((gaps * gaps).sum(1))
    odd = ~np.isfinite(plain) | (plain < 1e-150)
    if odd.any():
        most = np.abs(gaps[odd]).max(1)
        safe = np.where((most > 0) & np.isfinite(most), most, 1.0)
        plain[odd] = np.where(np.isfinite(most), safe * np.sqrt(((gaps[odd] / safe[:, None]) ** 2).sum(1)), most)
        plain[odd] = np.where(most == 0, 0.0, plain[odd])
    return plain


def _floats(rows: np.ndarray, power: int) -> np.ndarray:
    """Rows times a power of two as floats, for walking the graph only."""
    with np.errstate(over="ignore"):
        return np.clip(np.ldexp(rows.astype(np.float64), -power), -_FAR, _FAR).astype(np.float32)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("first")
    exact = _matrix(rows.column("vector"))
    power = int(np.frexp(np.abs(exact.astype(np.float64)).max())[1])
    walked = _floats(exact, power)
    # distinct vectors that are one in floats cannot be told apart on a walk: such a shard is scanned
    faithful = len(np.unique(walked, axis=0)) == len(walked)
    graph = hnsw.build(walked) if faithful else hnsw.Graph(walked, [])
    schema = pa.schema(
        [("dim", pa.int32()), ("shard", pa.int32()), ("power", pa.int32()), ("graph", pa.binary()), ("exact", pa.binary()), ("wide", pa.bool_()),
         ("ids", pa.list_(pa.list_(pa.int64())))]
    )
    ids = rows.column("ids").to_pylist()
    row = [[key[0].as_py()], [key[1].as_py()], [power], [graph.dump()], [exact.tobytes()], [exact.dtype == np.float64], [ids]]
    return pa.table(row, schema=schema)


_INDEX = "dim int, shard int, power int, graph binary, exact binary, wide boolean, ids array<array<bigint>>"


def build_index(nodes: DataFrame, shards: int) -> DataFrame:
    """One row per shard of (vector, ids), chosen by a hash of the vector: its graph and the vectors as they were."""
    placed = nodes.select(
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"),
        "vector",
        "ids",
        F.col("ids")[0].alias("first"),
    )
    return placed.groupBy("dim", "shard").applyInArrow(_build, _INDEX)


class _Shard:
    """A shard as it is searched: the graph proposes, the vectors themselves decide."""

    def __init__(self, row: dict):
        kind = np.float64 if row["wide"] else np.float32
        self.exact = np.frombuffer(row["exact"], kind).reshape(-1, row["dim"])
        self.graph = hnsw.Graph.load(row["graph"])
        self.power, self.ids = row["power"], row["ids"]

    def near(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and distances of about the ``k`` nearest vectors of each query."""
        walked = _floats(queries, self.power)
        if self.graph.layers:
            proposed = hnsw.search(self.graph, walked, max(k, hnsw.BEAM))
        for at, query in enumerate(queries):
            if self.graph.layers and np.abs(walked[at]).max() < _FAR / 2:
                places = proposed[at][proposed[at] >= 0]
            else:
                places = np.arange(len(self.exact))
            gaps = distances(self.exact[places], query)
            best = np.lexsort((places, gaps))[:k]
            yield places[best], gaps[best]


def _searched(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key = None, None
        for batch in batches:
            meta = batch.select(["dim", "shard", "block"]).to_pylist()
            whole = np.asarray(batch.column("graph").is_valid())
            at = 0
            while at < len(meta):
                if whole[at]:
                    row = batch.slice(at, 1).to_pylist()[0]
                    shard, key = _Shard(row), meta[at]
                    at += 1
                    continue
                end = at
                while end < len(meta) and not whole[end] and meta[end] == meta[at]:
                    end += 1
                if meta[at] == key:
                    names = batch.column("query_id").slice(at, end - at).to_pylist()
                    out: dict[str, list] = {n: [] for n in schema.names}
                    for name, (places, gaps) in zip(names, shard.near(_matrix(batch.column("vector").slice(at, end - at)), k)):
                        for place, gap in zip(places.tolist(), gaps.tolist()):
                            own = [i for i in shard.ids[place] if i != name]
                            out["query_id"] += [name] * len(own)
                            out["vec_id"] += own
                            out["score"] += [gap] * len(own)
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                at = end

    return run


def search(index: DataFrame, queries: DataFrame, nearest: int, shards: int) -> DataFrame:
    """query_id, rank, vec_id and score of (query_id, vector) rows against all shards.

    A task reads a shard and then its queries, one batch after the other. A shard is repeated only where there
    are more cores than shards. Every shard offers its ``nearest`` + 1 nearest distinct vectors, one
    more because the query's own row is left out.
    """
    cores = index.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(math.ceil(queries.count() / BLOCK), math.ceil(2 * cores / shards)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    kind = queries.schema["vector"].dataType.simpleString()
    empty = {c: F.lit(None).cast(t) for c, t in (("power", "int"), ("graph", "binary"), ("exact", "binary"), ("wide", "boolean"), ("ids", "array<array<bigint>>"))}
    dealt = queries.select(
        "query_id", "vector", F.size("vector").alias("dim"), block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("order")
    ).withColumns(empty)
    copies = index.withColumns(
        {"query_id": F.lit(None).cast("long"), "vector": F.lit(None).cast(kind), "order": F.lit(0), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}
    )
    keys = ["dim", "shard", "block"]
    met = dealt.unionByName(copies).repartition(shards * blocks, *keys).sortWithinPartitions(*keys, "order")
    found = met.mapInArrow(_searched(nearest + 1), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY, shard: int = SHARD) -> DataFrame:
    """The ``nearest`` nearest rows of each row whose vec_id is divisible by ``every``.

    Distances are taken from the vectors as they are, floats or doubles; only the walk uses floats. Vectors
    of another length than the query's are no candidates. A vec_id with several different
    vectors is searched for each of them and gets the nearest of all.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    own = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>").alias("embedding")
    vectors = vectors.select("vec_id", own)
    nodes = stored(distinct_vectors(vectors, nearest + 1))
    shards = max(1, math.ceil(nodes.count() / shard))
    index = stored(build_index(nodes, shards))
    wanted = vectors.filter((F.col("vec_id") % every == 0) & usable(F.col("embedding"))).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return search(index, wanted.distinct(), nearest, shards)
