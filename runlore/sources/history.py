"""Run history: merging sources, finding gaps, storing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlore.functions.values import DAY, WEEK, micros
from runlore.operators.ordered import previous_row, running_extreme, running_sums
from runlore.operators.runs import RUN_KEY

BUCKETS = 256
ROWS_PER_FILE = 500_000


def merge_history(*sources: DataFrame) -> DataFrame:
    """One row per run. A later source replaces an earlier one: stored < fetched < selected."""
    ranked = [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    # rows that agree on both are told apart by their content, so reruns keep the same one
    content = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(stacked.columns)])
    newest = Window.partitionBy(*RUN_KEY).orderBy(F.desc("__rank"), F.desc("updated_at"), content)
    return (
        stacked.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") == 1).drop("__n", "__rank")
    )


def newest_first(history: DataFrame) -> DataFrame:
    """History in its reading order."""
    return history.orderBy("repository", F.desc_nulls_last("created_at"), F.desc("run_id"))


def _gaps(needed: DataFrame, stored: DataFrame) -> DataFrame:
    have = stored.groupBy("repository").agg(
        F.min(micros("created_at")).alias("__min"), F.max(micros("created_at")).alias("__max")
    )

    def gap(condition, kind: str, start, end):
        row = F.struct(F.lit(kind).alias("gap"), start.alias("gap_start"), end.alias("gap_end"))
        return F.when(condition, row)

    known = F.col("__min").isNotNull()
    start, end = F.col("__from"), F.col("__to")
    found = F.array(
        gap(~known, "all", start, end),
        gap(known & (F.col("__min") > start), "earlier", start, F.col("__min")),
        gap(known & (F.col("__max") < end), "later", F.col("__max"), end),
    )
    return (
        needed.filter(start.isNotNull() & end.isNotNull())
        .join(have, "repository", "left")
        .select(*[c for c in needed.columns if not c.startswith("__")], F.explode(F.filter(found, lambda g: g.isNotNull())).alias("g"))
        .select(
            *[c for c in needed.columns if not c.startswith("__")],
            "g.gap",
            F.timestamp_micros("g.gap_start").alias("gap_start"),
            F.timestamp_micros("g.gap_end").alias("gap_end"),
        )
    )


def run_gaps(selected: DataFrame, stored: DataFrame, history_weeks: int = 4) -> DataFrame:
    """Stretches of time per repository that the features of the selected runs need and history lacks."""
    needed = selected.groupBy("repository").agg(
        (F.min(micros("created_at")) - history_weeks * WEEK).alias("__from"),
        F.max(micros("created_at")).alias("__to"),
    )
    return _gaps(needed, stored)


def job_gaps(jobs: DataFrame, stored: DataFrame, days: int = 30) -> DataFrame:
    """Stretches of time per job that comparing it with its previous job needs and history lacks.

    ``jobs`` has repository, job_id and run_created_at (else created_at).
    """
    at = micros(F.coalesce("run_created_at", "created_at") if "run_created_at" in jobs.columns else F.col("created_at"))
    needed = jobs.select("repository", "job_id", (at - days * DAY).alias("__from"), at.alias("__to"))
    return _gaps(needed, stored)


def covered_spans(spans: DataFrame) -> DataFrame:
    """The union of intervals (repository, span_start, span_end): one row for each stretch without a hole.

    A sweep along each repository's starts: a stretch begins where a start lies after all earlier ends.
    Intervals that touch are one stretch; empty ones and those without an end are left out.
    """
    known = spans.select("repository", "span_start", "span_end").filter(F.col("span_start") <= F.col("span_end")).distinct()
    order = ["span_start", "span_end"]
    begun = running_extreme(known, ["repository"], order, F.col("span_end"), "__before")
    opens = (F.col("__before").isNull() | (F.col("span_start") > F.col("__before"))).cast("int")
    numbered = running_sums(begun.withColumn("__opens", opens), ["repository"], order, {"__stretch": F.col("__opens")})
    return (
        numbered.groupBy("repository", "__stretch")
        .agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
        .drop("__stretch")
    )


def inner_gaps(needed: DataFrame, spans: DataFrame) -> DataFrame:
    """Parts of ``needed`` (repository, need_start, need_end) that no interval of ``spans`` covers, holes inside included.

    ``spans`` (repository, span_start, span_end) are the stretches that were fetched. What is needed at one
    instant only is a gap of no length where that instant isn't covered.
    """
    asked = needed.select("repository", "need_start", "need_end").filter(F.col("need_start") <= F.col("need_end")).distinct()
    stretches = covered_spans(spans)
    # what lies between the stretches, before the first and after the last
    before = previous_row(stretches, ["repository"], ["span_start"], ["span_end"], "__p")
    holes = before.select("repository", F.col("__p.span_end").alias("from"), F.col("span_start").alias("to"))
    last = stretches.groupBy("repository").agg(F.max("span_end").alias("from")).withColumn("to", F.lit(None).cast("timestamp"))
    none = asked.select("repository").distinct().join(stretches, "repository", "left_anti")
    none = none.select("repository", F.lit(None).cast("timestamp").alias("from"), F.lit(None).cast("timestamp").alias("to"))
    met = asked.join(holes.unionByName(last).unionByName(none), "repository").filter(
        (F.col("from").isNull() | (F.col("from") < F.col("need_end"))) & (F.col("to").isNull() | (F.col("to") > F.col("need_start")))
    )
    start = F.greatest("need_start", F.coalesce("from", "need_start"))
    end = F.least("need_end", F.coalesce("to", "need_end"))
    return met.select("repository", "need_start", "need_end", start.alias("gap_start"), end.alias("gap_end"))


def save_history(history: DataFrame, path: str, buckets: int = BUCKETS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store runs by repository bucket; only the buckets present in ``history`` are replaced.

    ``history`` must hold all runs of the buckets it touches: see ``update_history``. A bucket is
    spread over as many files as its rows need, so a busy repository does not end up in one task.
    """
    placed = history.withColumn("bucket", F.pmod(F.xxhash64("repository"), F.lit(buckets)).cast("int"))
    # one row per bucket
    files = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("__files"))
    (
        placed.join(F.broadcast(files), "bucket")
        .withColumn("__file", F.pmod(F.xxhash64("run_id"), F.col("__files")))
        .repartition("bucket", "__file")
        .drop("__file", "__files")
        .sortWithinPartitions("bucket", "repository", "created_at")
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs."""
    return spark.read.parquet(path).drop("bucket")


def update_history(spark: SparkSession, path: str, *newer: DataFrame, buckets: int = BUCKETS) -> None:
    """Merge newer runs into the store, reading and replacing only the buckets they fall in."""
    from runlore.session import cut_lineage

    bucket = F.pmod(F.xxhash64("repository"), F.lit(buckets)).cast("int")
    touched = reduce(
        lambda a, b: a.union(b), [n.select(bucket.alias("bucket")).distinct() for n in newer]
    ).distinct()
    numbers = [r["bucket"] for r in touched.collect()]  # at most ``buckets`` numbers
    stored = spark.read.parquet(path).filter(F.col("bucket").isin(numbers)).drop("bucket")
    # the merged rows are read from the files they replace, so they are written elsewhere first
    merged = cut_lineage(merge_history(stored, *newer))
    save_history(merged, path, buckets)
