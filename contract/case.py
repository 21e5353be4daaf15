"""A registered query: a Spark callable over the views and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract.views import oracle, spark_view
from runlore.session import configure


@dataclass
class Tables:
    """The views of one data folder, each built once."""

    spark: SparkSession
    sf_dir: str
    built: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = spark_view(self.spark, self.sf_dir, name)
        return self.built[name]


@dataclass(frozen=True)
class Case:
    build: Callable[[Tables], DataFrame]
    body: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return comparable(self.build(Tables(spark, sf_dir)))

    @property
    def sql(self) -> str | None:
        return None if self.body is None else oracle(self.body)


CASES: dict[str, Case] = {}


def case(name: str, body: str | None = None):
    """Register a query under ``name`` with the text of its oracle."""

    def add(build: Callable[[Tables], DataFrame]):
        CASES[name] = Case(build, body)
        return build

    return add


def comparable(df: DataFrame) -> DataFrame:
    """Values that hash alike in both engines: rounded floats, microseconds, texts for arrays."""
    out = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            # adding 0.0 turns a negative zero into zero
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            column = F.unix_micros(column)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            column = F.to_json(column, {"ignoreNullFields": "false"})
        elif isinstance(f.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        out.append(column.alias(f.name))
    return df.select(*out)
