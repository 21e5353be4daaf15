"""Totals by time slice, stored, so that the windows of new runs are taken without reading the history.

``Slices`` keeps events that can be added up: as they are, and summed by (repository, who, slice of time).
New events are added to their slices, and only those slices are summed again. A window is then the sums of
the slices inside it and the events of the slices in which it begins or ends. On this rest three parts
of a run's history: failure rates and trust, the committer's commits, and the numbers of committers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions.values import DAY, SECOND, WEEK, micros
from runlore.operators import people
from runlore.operators.ordered import asof_sums
from runlore.operators.runs import RUN_KEY, failure_rates, with_actor
from runlore.operators.slices import FINISHED
from runlore.session import cut_lineage, temporary_tables
from runlore.sources import keyed

_EVENT_KEYS = ["repository", "slice", "id"]
_SUM_KEYS = ["repository", "slice", "who"]


def who(*columns: Column) -> Column:
    """A text for the values, nulls included, that is never null."""
    return F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))


@dataclass(frozen=True)
class Slices:
    """Stored events (repository, id, who, at, measures) and their sums; ``width`` is a slice's length in microseconds."""

    path: str
    measures: tuple[str, ...]
    width: int = DAY

    def slice_of(self, at: Column) -> Column:
        return F.floor(at / self.width).cast("long")

    def add(self, events: DataFrame, source: str = "", number: int | None = None) -> None:
        """Add events, each replacing that of its repository, slice and id, and sum up the slices they are in.

        Events without a time are in no window and are left out. An event whose time or who changes has to
        be added once more with its old time and zeros. Batches that are replayed change nothing.
        """
        spark = events.sparkSession
        columns = ["repository", "id", "who", "at", *self.measures]
        placed = events.filter(F.col("at").isNotNull()).select(*columns[:4], *[F.col(m).cast("long").alias(m) for m in self.measures])
        placed = cut_lineage(placed.withColumn("slice", self.slice_of(F.col("at"))).select("repository", "slice", "id", "who", "at", *self.measures))
        keyed.append(spark, f"{self.path}/events", placed, _EVENT_KEYS, source, number)
        touched = cut_lineage(placed.select("repository", "slice").distinct())
        whole = keyed.read(spark, f"{self.path}/events", touched)
        sums = whole.groupBy(*_SUM_KEYS).agg(*[F.sum(m).alias(m) for m in self.measures])
        if keyed.manifest(spark, f"{self.path}/sums").schema:
            # a who that has left a slice keeps a row of zeros there
            gone = keyed.read(spark, f"{self.path}/sums", touched).select(*_SUM_KEYS).join(sums.select(*_SUM_KEYS), _SUM_KEYS, "left_anti")
            sums = sums.unionByName(gone.select(*_SUM_KEYS, *[F.lit(0).cast("long").alias(m) for m in self.measures]))
        keyed.append(spark, f"{self.path}/sums", sums, _SUM_KEYS, source, number)
        for part in ("events", "sums"):
            keyed.compact(spark, f"{self.path}/{part}", force=False)

    def around(self, spark: SparkSession, points: DataFrame, reach: DataFrame) -> DataFrame:
        """Rows (repository, who, at, measures) that have the same sums up to each of the ``points`` as all events.

        ``points`` (repository, at) are the times at which sums are read: their slices come as events. ``reach``
        (repository, low, high) are the slices that matter at all: the others among them come as one row for each who.
        """
        edges = cut_lineage(points.select("repository", self.slice_of(F.col("at")).alias("slice")).distinct())
        events = keyed.read(spark, f"{self.path}/events", edges)
        inner = reach.select("repository", F.explode(F.sequence("low", "high")).alias("slice")).distinct()
        inner = inner.join(edges, ["repository", "slice"], "left_anti")
        sums = keyed.read(spark, f"{self.path}/sums", inner)
        start = (F.col("slice") * self.width).cast("long").alias("at")
        return events.select("repository", "who", "at", *self.measures).unionByName(sums.select("repository", "who", start, *self.measures))

    def window_reach(self, probes: DataFrame, span: int) -> DataFrame:
        """The slices of windows of length ``span`` that end at the probes (repository, at)."""
        low, high = self.slice_of(F.col("at") - span), self.slice_of(F.col("at"))
        return probes.select("repository", low.alias("low"), high.alias("high")).distinct()


def _sums(rows: DataFrame, probes: DataFrame, points: Mapping, levels: Mapping, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return asof_sums(rows, {m: F.col(m) for m in measures}, probes, points, levels=levels, ids=list(ids), at="at")


# --- failure rates and trust ----------------------------------------------------------------------


def run_slices(path: str) -> Slices:
    return Slices(path, ("runs", "failures"))


def _run_events(runs: DataFrame) -> DataFrame:
    bad = F.col("conclusion").eqNullSafe("failure").cast("int")
    return with_actor(runs).select(
        "repository", F.col("run_id").alias("id"), who(F.col("actor_id")).alias("who"), micros("created_at").alias("at"),
        F.lit(1).alias("runs"), bad.alias("failures"), F.col("conclusion").isin(*FINISHED).alias("__finished"),
    )


def add_runs(runs: DataFrame, store: Slices, source: str = "", number: int | None = None) -> None:
    """Add finished runs; a run that arrives again with another conclusion or actor replaces itself."""
    with temporary_tables(runs.sparkSession):
        events = _run_events(runs)
        zero = F.when(F.col("__finished"), 1).otherwise(0)
        store.add(events.withColumns({"runs": zero, "failures": F.col("failures") * zero}).drop("__finished"), source, number)


def failure_history_of(batch: DataFrame, store: Slices, history_weeks: int = 4, recent_weeks: int = 1) -> DataFrame:
    """Failure rates and trust of the runs of ``batch``, as ``failure_history`` gives them with the batch selected.

    The batch must have been added. Read are the totals of its windows and the runs of the slices at their ends.
    """
    spark = batch.sparkSession
    spans = {"history": history_weeks * WEEK, "recent": recent_weeks * WEEK}
    longest = max(spans.values())
    own = cut_lineage(_run_events(batch).dropDuplicates(["repository", "id"]))
    dated = own.filter(F.col("at").isNotNull())
    extent = cut_lineage(dated.groupBy("repository").agg((F.min("at") - history_weeks * WEEK).alias("from"), F.max("at").alias("to")))
    begin, end = extent.select("repository", F.col("from").alias("at")), extent.select("repository", F.col("to").alias("at"))
    points = dated.select("repository", F.explode(F.array("at", *[F.col("at") - s for s in spans.values()])).alias("at"))
    reach = store.window_reach(dated, longest).unionByName(
        extent.select("repository", store.slice_of(F.col("from")).alias("low"), store.slice_of(F.col("to")).alias("high"))
    )
    known = store.around(spark, points.unionByName(begin).unionByName(end), reach)
    # runs of the batch that did not finish count in its own windows only
    open_ = own.filter(~F.coalesce("__finished", F.lit(False)))
    rows = cut_lineage(known.unionByName(open_.filter(F.col("at").isNotNull()).select("repository", "who", "at", "runs", "failures")))
    probes = dated.select("repository", "id", "who", "at", F.col("failures").alias("__bad"))
    moments = {"hi": (F.col("at"), True)} | {t: (F.col("at") - s, False) for t, s in spans.items()}
    levels = {"repo": ["repository"], "actor": ["repository", "who"]}
    read = _sums(rows, probes, moments, levels, ["repository", "id", "__bad"], store.measures)
    names = [f"{level}_{m}" for level in levels for m in store.measures]
    frames = [(F.col(f"hi_{n}") - F.col(f"{t}_{n}")).alias(f"{t}_{n}") for t in spans for n in names]
    whole = _sums(
        known, extent, {"hi": (F.col("to"), True), "lo": (F.col("from"), False)}, {"repo": ["repository"]}, ["repository"], store.measures
    ).select("repository", (F.col("hi_repo_runs") - F.col("lo_repo_runs")).alias("n"))
    more = open_.groupBy("repository").agg(F.count(F.lit(1)).alias("m"))
    undated = own.filter(F.col("at").isNull() & F.col("__finished")).groupBy("repository").agg(F.count(F.lit(1)).alias("u"))
    none = F.lit(0)
    every = whole.join(more, "repository", "left").join(undated, "repository", "left").select(
        "repository", (F.col("n") + F.coalesce("m", none) + F.coalesce("u", none)).alias("all_repo_runs")
    )
    sums = read.select("repository", F.col("id").alias("run_id"), "__bad", *frames).join(every, "repository")
    return failure_rates(sums, list(spans))


# --- commits of the run's committer -----------------------------------------------------------------


def commit_slices(path: str) -> Slices:
    return Slices(path, ("commits",))


def add_commits(commits: DataFrame, store: Slices, source: str = "", number: int | None = None) -> None:
    """Add commits with a login, for ``experience_of``."""
    with temporary_tables(commits.sparkSession):
        known = commits.filter(F.col("author_login").isNotNull())
        rows = known.select("repository", F.col("sha").alias("id"), who(F.col("author_login")).alias("who"), micros("committed_at").alias("at"), F.lit(1).alias("commits"))
        store.add(rows, source, number)


def experience_of(batch: DataFrame, store: Slices, weeks: int = 4) -> DataFrame:
    """Commits of each run's actor in the ``weeks`` before it, as ``repository_experience`` gives them."""
    spark, span = batch.sparkSession, weeks * WEEK
    asked = with_actor(batch).filter(F.col("actor_login").isNotNull() & F.col("created_at").isNotNull())
    probes = cut_lineage(asked.select(*RUN_KEY, who(F.col("actor_login")).alias("who"), micros("created_at").alias("at")).distinct())
    points = probes.select("repository", F.explode(F.array(F.col("at"), F.col("at") - span)).alias("at"))
    rows = cut_lineage(store.around(spark, points, store.window_reach(probes, span)))
    read = _sums(
        rows, probes, {"hi": (F.col("at"), True), "lo": (F.col("at") - span, False)}, {"all": ["repository", "who"]}, RUN_KEY, store.measures
    )
    count = F.coalesce(F.col("hi_all_commits") - F.col("lo_all_commits"), F.lit(0)).cast("long")
    return batch.select(*RUN_KEY).join(read, RUN_KEY, "left").select(*RUN_KEY, count.alias("git_committer_repo_exp"))


# --- numbers of committers --------------------------------------------------------------------------


def committer_slices(path: str) -> Slices:
    return Slices(path, ("open", "first"))


def _changes(times: DataFrame, days: int) -> DataFrame:
    rows = people.committer_changes(times, days)
    return rows.select(
        "repository", F.concat_ws(":", "sha", F.col("__kind").cast("string")).alias("id"), F.lit("").alias("who"), F.col("__from").alias("at"),
        F.col("__open").alias("open"), F.col("__first").alias("first"),
    )


def add_committers(commits: DataFrame, store: Slices, days: int = 90, source: str = "", number: int | None = None) -> None:
    """Add commits, for ``committers_of`` with the same ``days``.

    A commit changes what its committer's next commit stands for, wherever that is in time, so the
    commits of the committers of the batch are read, from a table in their order, and nothing else.
    """
    spark, keys = commits.sparkSession, ["repository", "committer", "sha"]
    with temporary_tables(spark):
        new = cut_lineage(people.commit_times(commits).select(*keys, "at"))
        path = f"{store.path}/commits"
        touched = new.select("repository", "committer").distinct()
        known = keyed.manifest(spark, path).schema != ""
        old = cut_lineage(keyed.read(spark, path, touched)) if known else new.limit(0)
        both = new.withColumn("__n", F.lit(1)).unionByName(old.withColumn("__n", F.lit(0)))
        merged = cut_lineage(both.groupBy(*keys).agg(F.max_by("at", "__n").alias("at")))
        was, now = cut_lineage(_changes(old, days)), cut_lineage(_changes(merged, days))
        at_slice = lambda df: df.withColumn("slice", store.slice_of(F.col("at")))
        place = ["repository", "id", "slice"]
        gone = at_slice(was).join(at_slice(now).select(*place), place, "left_anti").drop("slice")
        gone = gone.withColumns({"open": F.lit(0), "first": F.lit(0)})
        changed = now.join(was, ["repository", "id", "at", "who", "open", "first"], "left_anti")
        store.add(changed.unionByName(gone), source, number)
        keyed.append(spark, path, new, keys, source, number)
        keyed.compact(spark, path, force=False)


def committers_of(batch: DataFrame, store: Slices, days: int = 90) -> DataFrame:
    """Committers up to each run, of all time and of the last ``days``, as ``committer_counts`` gives them."""
    spark, span = batch.sparkSession, days * DAY - SECOND
    asked = batch.filter(F.col("created_at").isNotNull())
    probes = cut_lineage(asked.select(*RUN_KEY, (micros("created_at") - SECOND).alias("at")).distinct())
    points = probes.select("repository", F.explode(F.array(F.col("at"), F.col("at") - span)).alias("at"))
    edges = cut_lineage(points.select("repository", store.slice_of(F.col("at")).alias("slice")).distinct())
    # all sums of the repositories: one row for each day with commits, however many commits it has
    events = keyed.read(spark, f"{store.path}/events", edges).select("repository", "who", "at", *store.measures)
    sums = keyed.read(spark, f"{store.path}/sums", probes.select("repository").distinct()).join(F.broadcast(edges), ["repository", "slice"], "left_anti")
    start = (F.col("slice") * store.width).cast("long").alias("at")
    rows = cut_lineage(events.unionByName(sums.select("repository", "who", start, *store.measures)))
    read = _sums(
        rows, probes, {"ever": (F.col("at"), True), "recent": (F.col("at") - span, True)}, {"all": ["repository"]}, RUN_KEY, store.measures
    )
    return batch.select(*RUN_KEY).join(read, RUN_KEY, "left").select(
        *RUN_KEY,
        F.coalesce("ever_all_first", F.lit(0)).cast("long").alias("git_num_committers"),
        F.coalesce("recent_all_open", F.lit(0)).cast("long").alias("gh_team_size_last_3_month"),
    )
