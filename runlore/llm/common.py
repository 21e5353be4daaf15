"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.session import configure, cut_lineage

# A side below this many rows is broadcast; its rows are a few numbers and short texts each.
BROADCAST_ROWS = 50_000

# Rows of large texts reach Python workers in batches of at most this size.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    configure(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    return cut_lineage(df)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if it has at most ``rows`` rows, else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts without other letters take the byte-wise path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _hashable(value: Column, kind: T.DataType) -> Column:
    """The value with maps as sorted lists of entries, which can be hashed and do not depend on order."""
    if not _has_map(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = [_hashable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    entry = lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("k"), _hashable(e["value"], kind.valueType).alias("v"))
    return F.array_sort(F.transform(F.map_entries(value), entry))


def row_id(df: DataFrame) -> Column:
    """128 bits over all columns as text, the same for equal rows only.

    A hash passes over nulls, so which columns are null is hashed as well; 64 bits would make some
    different rows of a very large table equal. Maps count by their entries, in any order.
    """
    names = [_hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    parts = [*names, *[F.col(f"`{c}`").isNull() for c in df.columns]]
    return F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit("second"), *parts)))
