"""Task table: which runs or jobs to extract, and where their features are merged back."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.functions.values import is_blank

POSITION = "__position"


def parse_collected(value: Column) -> Column:
    """Blank is 0, a whole number is itself, anything else fails the query."""
    text = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    wrong = F.raise_error(F.concat(F.lit("Invalid collected value: "), value.cast("string")))
    return F.when(is_blank(value.cast("string")), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(number, wrong.cast("bigint"))
    )


def normalise_tasks(raw: DataFrame, id_column: str = "run_id") -> DataFrame:
    """Trim keys and turn ``collected`` into a number. Rows without a key or number fail the query."""
    missing = sorted({"repository", "collected", id_column} - set(raw.columns))
    if missing:
        raise ValueError(f"task table must have repository, {id_column}, collected; missing: {', '.join(missing)}")
    blank = is_blank(F.col("repository")) | is_blank(F.col(id_column).cast("string"))
    no_key = F.raise_error(F.lit(f"repository and {id_column} are required")).cast("string")

    def trimmed(name: str) -> Column:
        text = F.regexp_replace(F.col(name).cast("string"), r"(?U)^\s+|\s+$", "")
        return F.when(blank, no_key).otherwise(text)

    return raw.withColumns(
        {
            "repository": trimmed("repository"),
            id_column: trimmed(id_column),
            "collected": parse_collected(F.col("collected")),
        }
    )


def load_tasks(
    spark: SparkSession, path: str, id_column: str = "run_id", multi_line: bool = False
) -> DataFrame:
    """Read a task CSV, every column as text, with the position of each row in ``__position``.

    A path that does not exist is an empty table. ``multi_line`` reads quoted line breaks, at the
    price of one task per file.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
    )
    try:
        raw = reader.csv(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        columns = ["repository", id_column, "collected", POSITION]
        fields = [T.StructField(c, T.StringType()) for c in columns[:2]]
        fields += [T.StructField(c, T.LongType()) for c in columns[2:]]
        return spark.createDataFrame([], T.StructType(fields))
    if not raw.columns:
        raise ValueError(f"task table is empty: {path}")
    names = [c for c in raw.columns]
    placed = raw.select(
        *[F.col(f"`{c}`") for c in names],
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")
        ).alias(POSITION),
    )
    return normalise_tasks(placed, id_column)


def resolve_tasks(tasks: DataFrame, id_column: str = "run_id", overwrite: bool = False) -> DataFrame:
    """One row per (repository, id): its first row, the resolved ``collected`` and the row count.

    Rows that agree on 0 or 1 keep it; otherwise overwrite decides between pending and collected.
    """
    position = POSITION if POSITION in tasks.columns else None
    others = [c for c in tasks.columns if c not in ("repository", id_column, "collected", POSITION)]
    first = F.struct(*others) if others else F.struct(F.lit(1).alias("none"))
    order = F.col(position) if position else F.struct("collected", *others)
    resolved = (
        F.when((F.col("__low") == 0) & (F.col("__high") == 0), 0)
        .when((F.col("__low") == 1) & (F.col("__high") == 1), 1)
        .otherwise(0 if overwrite else 1)
    )
    return (
        tasks.groupBy("repository", id_column)
        .agg(
            F.min("collected").alias("__low"),
            F.max("collected").alias("__high"),
            F.count(F.lit(1)).alias("row_count"),
            F.min_by(first, order).alias("__first"),
        )
        .select(
            "repository",
            id_column,
            resolved.cast("bigint").alias("collected"),
            *[F.col(f"__first.`{c}`").alias(c) for c in others],
            "row_count",
        )
    )


def duplicate_tasks(tasks: DataFrame, id_column: str = "run_id") -> DataFrame:
    """Keys listed more than once, with their number of rows."""
    return (
        tasks.groupBy("repository", id_column)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") > 1)
    )


def resolve_rows(
    tasks: DataFrame, repositories: Sequence[str] | None = None, id_column: str = "run_id", overwrite: bool = False
) -> DataFrame:
    """The task table with the resolved ``collected`` in all rows of its duplicate groups.

    Only groups of the given repositories are touched (all without a list), other rows stay.
    """
    chosen = tasks.filter(F.col("repository").isin(list(repositories))) if repositories else tasks
    state = (
        resolve_tasks(chosen.select("repository", id_column, "collected"), id_column, overwrite)
        .filter(F.col("row_count") > 1)
        .select("repository", id_column, F.col("collected").alias("__state"))
    )
    joined = tasks.join(state, ["repository", id_column], "left").withColumn("collected", F.coalesce("__state", "collected"))
    return joined.select(*tasks.columns)


def pending_tasks(
    tasks: DataFrame,
    repositories: Sequence[str] | None = None,
    id_column: str = "run_id",
    overwrite: bool = False,
) -> DataFrame:
    """Tasks of the repositories that are not collected yet; all of them with ``overwrite``."""
    if repositories:
        tasks = tasks.filter(F.col("repository").isin(list(repositories)))
    resolved = resolve_tasks(tasks, id_column, overwrite)
    return resolved if overwrite else resolved.filter(F.col("collected") == 0)


def check_mode(mode: str, run_ids: Iterable | None = None, job_ids: Iterable | None = None) -> str:
    """The id column of a mode; ids of the other mode are refused."""
    if mode not in ("run", "job"):
        raise ValueError("mode must be 'run' or 'job'")
    if mode == "run" and job_ids:
        raise ValueError("job ids are only valid in job mode")
    if mode == "job" and run_ids:
        raise ValueError("run ids are only valid in run mode")
    return f"{mode}_id"


def explicit_tasks(
    tasks: DataFrame,
    repositories: Sequence[str],
    ids: DataFrame | Sequence,
    id_column: str = "run_id",
    overwrite: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The task table with unknown ids appended, and the selected tasks among the given ids."""
    if len(repositories) != 1:
        raise ValueError(f"explicit {id_column} values require exactly one repository")
    repository = repositories[0]
    if not isinstance(ids, DataFrame):
        ids = tasks.sparkSession.createDataFrame([(str(i),) for i in ids], f"{id_column} string")
    wanted = ids.select(
        F.lit(repository).alias("repository"),
        F.regexp_replace(F.col(id_column).cast("string"), r"(?U)^\s+|\s+$", "").alias(id_column),
    ).distinct()
    key = ["repository", id_column]
    unknown = wanted.join(tasks, key, "left_anti").withColumn("collected", F.lit(0).cast("bigint"))
    widened = tasks.unionByName(unknown, allowMissingColumns=True)
    resolved = resolve_tasks(widened.join(wanted, key, "left_semi"), id_column, overwrite)
    return widened, resolved if overwrite else resolved.filter(F.col("collected") == 0)


def pending_entities(
    entities: DataFrame, tasks: DataFrame, id_column: str = "run_id", overwrite: bool = False
) -> DataFrame:
    """Entities without those whose task is collected; entities without a task stay."""
    if overwrite:
        return entities
    done = resolve_tasks(tasks, id_column, overwrite).filter(F.col("collected") != 0)
    done = done.select("repository", F.col(id_column).alias("__id"))
    return (
        entities.withColumn("__id", F.col(id_column).cast("string"))
        .join(done, ["repository", "__id"], "left_anti")
        .drop("__id")
    )


def merge_features(tasks: DataFrame, features: DataFrame, id_column: str = "run_id") -> DataFrame:
    """Put feature rows into the task table.

    Every task row with the key of a feature row gets its values and becomes collected; feature rows
    without a task are appended; columns the table lacks are added at its end. Merging the same
    features again changes nothing. Columns that both sides have must have one type.
    """
    key = ["repository", id_column]
    columns = [c for c in features.columns if c not in (*key, "collected")]
    new = features.select(
        F.col("repository"),
        F.col(id_column).cast("string").alias(id_column),
        F.lit(True).alias("__matched"),
        *[F.col(c).alias(f"__new_{c}") for c in columns],
    )
    joined = tasks.join(new, key, "full_outer")
    matched = F.coalesce("__matched", F.lit(False))
    kept = []
    for name in tasks.columns:
        if name in key:
            kept.append(F.col(name))
        elif name == "collected":
            kept.append(F.when(matched, F.lit(1)).otherwise(F.col(name)).cast("bigint").alias(name))
        elif name in columns:
            kept.append(F.when(matched, F.col(f"__new_{name}")).otherwise(F.col(name)).alias(name))
        else:
            kept.append(F.col(name))
    added = [F.col(f"__new_{c}").alias(c) for c in columns if c not in tasks.columns]
    return joined.select(*kept, *added)


def _number_text(value: Column) -> Column:
    """Shortest text of a floating-point number, with a plain point form between 1e-4 and 1e16."""
    short = value.cast("string")
    plain = F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0$", "")
    power = F.substring_index(short, "E", -1).try_cast("int")
    exponent = F.concat(
        F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    size = F.abs(value)
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~short.contains("E"), short)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, exponent))
    )


def _time_text(value: Column) -> Column:
    """UTC text of a time, built from its microseconds, so the session's time zone does not matter."""
    micro = F.unix_micros(value)
    second = F.floor(micro / F.lit(1_000_000))
    rest = F.pmod(second, F.lit(86_400))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86_400).cast("int")).cast("string")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))
    part = F.pmod(micro, F.lit(1_000_000))
    fraction = F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise("")
    return F.when(value.isNotNull(), F.concat(day, F.lit(" "), clock, fraction, F.lit("+00:00")))


def serialised(df: DataFrame) -> DataFrame:
    """Every column as the text a CSV cell holds: null is '', nested values are JSON."""
    cells = []
    for field in df.schema.fields:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            text = F.to_json(value, {"ignoreNullFields": "false"})
        elif isinstance(kind, T.BooleanType):
            text = F.initcap(value.cast("string"))
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            text = _number_text(value)
        elif isinstance(kind, T.TimestampType):
            text = _time_text(value)
        else:
            text = value.cast("string")
        cells.append(F.coalesce(text, F.lit("")).alias(field.name))
    return df.select(*cells)


def write_tasks(df: DataFrame, path: str) -> None:
    """Replace the task CSV folder at ``path``: written beside it first, then renamed into place.

    Rows keep the order in which they were read; appended rows come last, by key. Between the two
    renames the folder does not exist; if the job ends there, the old table is beside it under a
    name that ends in ``.old``.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    if POSITION in df.columns:
        others = sorted(c for c in df.columns if c in ("repository", "run_id", "job_id"))
        df = df.orderBy(F.col(POSITION).isNull(), POSITION, *others)
    serialised(df.drop(POSITION)).write.option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(staged)
    jvm = spark.sparkContext._jvm
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    replaced = files.exists(target)
    if replaced and not files.rename(target, old):
        raise OSError(f"could not move the old task table at {path}")
    if not files.rename(new, target):
        raise OSError(f"could not move the new task table to {path}")
    if replaced:
        files.delete(old, True)
