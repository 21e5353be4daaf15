"""Queries over the task table, the history store, payloads, git logs, and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contract.case import Tables, case
from contract.history_cases import DAY_US, WEEK_US
from contract.text_cases import FACTS_BODY
from runlore.schemas import TABLES
from runlore.session import checkpoint_root
from runlore.sources import history, keyed, payloads, tasks
from runlore.streaming import ingest


def _folder(t: Tables, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can read."""
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


# -- tasks --------------------------------------------------------------------------------------

NORMAL = """
SELECT repository, trim(run_id) AS run_id, CASE WHEN trim(collected) = '' THEN 0 ELSE CAST(trim(collected) AS BIGINT) END AS collected, note, row_number FROM {tasks}"""


def _resolved(overwrite: bool) -> str:
    return f"""
SELECT repository, run_id, CAST(CASE WHEN min(collected) = 0 AND max(collected) = 0 THEN 0 WHEN min(collected) = 1 AND max(collected) = 1 THEN 1
  ELSE {0 if overwrite else 1} END AS BIGINT) AS collected, arg_min(note, row_number) AS note, count(*) AS row_count FROM ({NORMAL}) n GROUP BY 1, 2"""


def _tasks(t: Tables):
    """Tasks with their place in the table."""
    return tasks.normalise_tasks(t["tasks"]).withColumnRenamed("row_number", tasks.POSITION)


@case("a01_task_scan", f"SELECT repository, run_id, collected, note FROM ({NORMAL}) n")
def _(t: Tables):
    path = _folder(t, "tasks")
    raw = t["tasks"].drop("row_number")
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tasks.load_tasks(t.spark, path).drop(tasks.POSITION)


@case("a02_collected", f"SELECT repository, run_id, collected, row_number FROM ({NORMAL}) n")
def _(t: Tables):
    return tasks.normalise_tasks(t["tasks"]).drop("note")


@case("a03_resolved_tasks", _resolved(False))
def _(t: Tables):
    return tasks.resolve_tasks(_tasks(t))


@case("a03_applied_to_rows", f"""
SELECT n.repository, n.run_id, CASE WHEN n.repository = 'org/r1' THEN r.collected ELSE n.collected END AS collected, n.note, n.row_number
FROM ({NORMAL}) n JOIN ({_resolved(False)}) r USING (repository, run_id)""")
def _(t: Tables):
    return tasks.resolve_rows(_tasks(t), ["org/r1"]).withColumnRenamed(tasks.POSITION, "row_number")


@case("a03_resolved_tasks_overwrite", _resolved(True))
def _(t: Tables):
    return tasks.resolve_tasks(_tasks(t), overwrite=True)


@case("a03_duplicate_tasks", f"SELECT repository, run_id, count(*) AS row_count FROM ({NORMAL}) n GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables):
    return tasks.duplicate_tasks(_tasks(t))


@case("a04_pending_tasks", f"SELECT * FROM ({_resolved(False)}) r WHERE repository IN ('org/r1', 'org/r3') AND collected = 0")
def _(t: Tables):
    return tasks.pending_tasks(_tasks(t), ["org/r1", "org/r3"])


_WANTED = "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS run_id FROM {orders}"


def _ids(t: Tables):
    return t["orders"].select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("run_id"))


@case("a05_explicit_tasks", f"""
WITH n AS ({NORMAL}), w AS ({_WANTED}),
x AS (SELECT repository, run_id, collected, note, row_number FROM n WHERE repository = 'org/r1' AND run_id IN (SELECT run_id FROM w)
  UNION ALL SELECT 'org/r1', run_id, 0, NULL, NULL FROM w WHERE run_id NOT IN (SELECT run_id FROM n WHERE repository = 'org/r1'))
SELECT repository, run_id, min(note) AS note, count(*) AS row_count, CAST(0 AS BIGINT) AS collected FROM (
  SELECT repository, run_id, collected, first_value(note) OVER (PARTITION BY run_id ORDER BY row_number) AS note FROM x) GROUP BY 1, 2 HAVING min(collected) = 0 AND max(collected) = 0""")
def _(t: Tables):
    return tasks.explicit_tasks(_tasks(t), ["org/r1"], _ids(t))[1]


@case("a05_appended_tasks", f"""
WITH n AS ({NORMAL}), w AS ({_WANTED})
SELECT repository, run_id, collected, note FROM n
UNION ALL SELECT 'org/r1', run_id, 0, NULL FROM w WHERE run_id NOT IN (SELECT run_id FROM n WHERE repository = 'org/r1')""")
def _(t: Tables):
    return tasks.explicit_tasks(_tasks(t), ["org/r1"], _ids(t))[0].drop(tasks.POSITION)


@case("a06_pending_entities", f"""
SELECT repository, run_id, conclusion FROM {{tied_runs}} r
WHERE NOT EXISTS (SELECT 1 FROM ({_resolved(False)}) d WHERE d.repository = r.repository AND d.run_id = CAST(r.run_id AS VARCHAR) AND d.collected <> 0)""")
def _(t: Tables):
    return tasks.pending_entities(t["tied_runs"], _tasks(t)).select("repository", "run_id", "conclusion")


MERGED = f"""
SELECT coalesce(n.repository, f.repository) AS repository, coalesce(n.run_id, f.run_id) AS run_id,
  CASE WHEN f.run_id IS NOT NULL THEN 1 ELSE n.collected END AS collected, CASE WHEN f.run_id IS NOT NULL THEN f.note ELSE n.note END AS note, f.conclusion
FROM ({NORMAL}) n FULL JOIN (SELECT repository, CAST(run_id AS VARCHAR) AS run_id, head_branch AS note, conclusion FROM {{tied_runs}} WHERE conclusion IS NOT NULL) f
  ON f.repository = n.repository AND f.run_id = n.run_id"""


def _features(t: Tables):
    known = t["tied_runs"].filter("conclusion is not null")
    return known.select("repository", "run_id", F.col("head_branch").alias("note"), "conclusion")


@case("a07_merged_features", MERGED)
def _(t: Tables):
    return tasks.merge_features(_tasks(t).drop(tasks.POSITION), _features(t))


@case("a07_merged_twice", MERGED)
def _(t: Tables):
    once = tasks.merge_features(_tasks(t).drop(tasks.POSITION), _features(t))
    return tasks.merge_features(once, _features(t))


SERIALISED = """
SELECT j.repository, CAST(job_id AS VARCHAR) AS job_id, coalesce(strftime(started_at, '%Y-%m-%d %H:%M:%S+00:00'), '') AS started_at,
  coalesce(CAST((epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS VARCHAR), '') AS seconds,
  CASE WHEN conclusion = 'failure' THEN 'True' ELSE 'False' END AS failed, CAST(to_json(labels) AS VARCHAR) AS labels, coalesce(CAST(to_json(list_transform(steps, lambda s: s.name)) AS VARCHAR), '') AS steps
FROM {jobs} j"""


def _cells(t: Tables):
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return t["jobs"].select(
        "repository", "job_id", "started_at", seconds.alias("seconds"), (F.col("conclusion") == "failure").alias("failed"), "labels",
        F.col("steps.name").alias("steps"),
    )


@case("a08_serialised", SERIALISED)
def _(t: Tables):
    return tasks.serialised(_cells(t))


@case("a08_written_tasks", f"SELECT repository, job_id, nullif(seconds, '') AS seconds, failed, labels FROM ({SERIALISED}) s")
def _(t: Tables):
    path = _folder(t, "written")
    tasks.write_tasks(_cells(t).select("repository", "job_id"), path)
    tasks.write_tasks(_cells(t).drop("started_at", "steps"), path)  # replaces the first
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


# -- history ------------------------------------------------------------------------------------

_UPDATED = "SELECT repository, run_id, conclusion || '!' AS conclusion, head_branch FROM {runs} WHERE event = 'push' OR event = 'schedule'"
MERGED_HISTORY = f"""
SELECT r.repository, r.run_id, coalesce(u.conclusion, r.conclusion) AS conclusion, r.created_at FROM (
  SELECT repository, run_id, conclusion, epoch_us(created_at) AS created_at FROM {{runs}}) r LEFT JOIN ({_UPDATED}) u USING (repository, run_id)"""


def _updates(t: Tables):
    return t["runs"].filter("event in ('push', 'schedule')").withColumn("conclusion", F.concat("conclusion", F.lit("!")))


@case("a09_merged_history", MERGED_HISTORY)
def _(t: Tables):
    fetched = t["runs"].filter("event = 'push'")
    merged = history.merge_history(t["runs"], fetched, _updates(t))
    return history.newest_first(merged).select("repository", "run_id", "conclusion", "created_at")


@case("a09_history_store", MERGED_HISTORY)
def _(t: Tables):
    path = _folder(t, "history")
    history.save_history(t["runs"], path, buckets=8)
    history.update_history(t.spark, path, _updates(t), buckets=8)
    return history.load_history(t.spark, path).select("repository", "run_id", "conclusion", "created_at")


_STORED = "SELECT repository, min(epoch_us(created_at)) AS lo, max(epoch_us(created_at)) AS hi FROM {runs} WHERE conclusion = 'success' AND head_branch = 'dev' AND repository <> 'org/r2' GROUP BY 1"


def _gap_rows(needed: str, key: str) -> str:
    return f"""
WITH s AS ({_STORED}), n AS ({needed})
SELECT {key}, 'all' AS gap, f AS gap_start, t AS gap_end FROM n WHERE repository NOT IN (SELECT repository FROM s)
UNION ALL SELECT {key}, 'earlier', f, lo FROM n JOIN s USING (repository) WHERE lo > f
UNION ALL SELECT {key}, 'later', hi, t FROM n JOIN s USING (repository) WHERE hi < t"""


def _stored(t: Tables):
    return t["runs"].filter("conclusion = 'success' and head_branch = 'dev' and repository <> 'org/r2'")


@case("a10_run_gaps", _gap_rows(f"SELECT repository, min(epoch_us(created_at)) - {WEEK_US} AS f, max(epoch_us(created_at)) AS t FROM {{runs}} WHERE conclusion = 'failure' GROUP BY 1", "repository"))
def _(t: Tables):
    return history.run_gaps(t["runs"].filter("conclusion = 'failure'"), _stored(t), 1)


@case("a10_job_gaps", _gap_rows(f"SELECT repository, job_id, epoch_us(created_at) + 750000000000000 - {30 * DAY_US} AS f, epoch_us(created_at) + 750000000000000 AS t FROM {{jobs}}", "repository, job_id"))
def _(t: Tables):
    moved = F.timestamp_micros(F.unix_micros("created_at") + F.lit(750000000000000))
    return history.job_gaps(t["jobs"].withColumn("run_created_at", moved), _stored(t))


_SPANS = """
SELECT repository, created_at AS span_start, make_timestamp(epoch_us(created_at) + CAST(run_id % 9 AS BIGINT) * 600000000) AS span_end
FROM {runs} WHERE repository <> 'org/r4'"""


@case("a10_inner_gaps", f"""
WITH spans AS ({_SPANS}),
need AS (SELECT repository, min(created_at) AS need_start, max(created_at) AS need_end FROM {{runs}} GROUP BY repository, run_id % 3),
edges AS (
  SELECT repository, p, sum(step) AS step FROM (
    SELECT repository, span_start AS p, 1 AS step FROM spans UNION ALL SELECT repository, span_end, -1 FROM spans
    UNION ALL SELECT repository, need_start, 0 FROM need UNION ALL SELECT repository, need_end, 0 FROM need) GROUP BY 1, 2),
pieces AS (
  SELECT repository, p AS f, lead(p) OVER w AS t, sum(step) OVER w AS open FROM edges WINDOW w AS (PARTITION BY repository ORDER BY p)),
bare AS (SELECT repository, f, t, CASE WHEN lag(t) OVER w = f AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.repository = pieces.repository AND s.span_start <= f AND s.span_end >= f)
    THEN 0 ELSE 1 END AS opens FROM pieces WHERE open = 0 AND t IS NOT NULL WINDOW w AS (PARTITION BY repository ORDER BY f)),
holes AS (SELECT repository, min(f) AS f, max(t) AS t FROM (SELECT *, sum(opens) OVER (PARTITION BY repository ORDER BY f) AS g FROM bare) GROUP BY repository, g)
SELECT n.repository, epoch_us(n.need_start) AS need_start, epoch_us(n.need_end) AS need_end, epoch_us(greatest(f, need_start)) AS gap_start, epoch_us(least(t, need_end)) AS gap_end
FROM need n JOIN holes h ON h.repository = n.repository AND h.f < n.need_end AND h.t > n.need_start""")
def _(t: Tables):
    """Each run stands for a fetch that covered some minutes after it; one repository was never fetched."""
    ends = F.timestamp_micros(F.unix_micros("created_at") + F.col("run_id") % 9 * 600_000_000)
    spans = t["runs"].filter("repository <> 'org/r4'").select("repository", F.col("created_at").alias("span_start"), ends.alias("span_end"))
    needed = t["runs"].groupBy("repository", F.col("run_id") % 3).agg(F.min("created_at").alias("need_start"), F.max("created_at").alias("need_end"))
    return history.inner_gaps(needed, spans)


# -- payloads and git logs ----------------------------------------------------------------------


@case("a11_runs_from_payload", """
SELECT repository, run_id, workflow_id, head_sha, conclusion, CAST(run_attempt AS BIGINT) AS run_attempt, CAST(epoch_us(date_trunc('second', created_at)) AS BIGINT) AS created_at, actor.login AS actor_login, actor.id AS actor_id
FROM {runs}""")
def _(t: Tables):
    seconds = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.struct(
        F.col("run_id").alias("id"), "workflow_id", "head_sha", "conclusion", F.col("run_attempt").cast("int").alias("run_attempt"),
        seconds.alias("created_at"), "actor",
    )
    raw = t["runs"].select("repository", F.to_json(payload).alias("payload"))
    return payloads.runs_from_payload(raw).select(
        "repository", "run_id", "workflow_id", "head_sha", "conclusion", "run_attempt", "created_at", "actor_login", "actor_id"
    )


@case("a11_jobs_from_payload", """
SELECT repository, job_id, run_id, name, epoch_us(started_at) AS started_at, coalesce(len(steps), -1) AS steps, steps[2].conclusion AS second FROM {jobs}""")
def _(t: Tables):
    payload = F.struct(F.col("job_id").alias("id"), "run_id", "name", "started_at", "steps", "labels")
    raw = t["jobs"].select("repository", F.to_json(payload).alias("payload"))
    return payloads.jobs_from_payload(raw).select(
        "repository", "job_id", "run_id", "name", "started_at", F.coalesce(F.size("steps"), F.lit(-1)).alias("steps"),
        F.try_element_at("steps", F.lit(2))["conclusion"].alias("second"),
    )


@case("a11_missing_ids", "SELECT repository, CAST(run_id AS VARCHAR) AS run_id FROM {tied_runs} EXCEPT SELECT repository, CAST(run_id AS VARCHAR) FROM {runs}")
def _(t: Tables):
    return payloads.missing_ids(t["tied_runs"], t["runs"])


def _blocks(t: Tables):
    sep = F.lit("\x1f")
    header = F.concat_ws(
        "\x1f", F.col("sha"), F.coalesce("author_name", F.lit("")), F.col("author_email"), F.date_format("committed_at", "yyyy-MM-dd"),
        F.coalesce("message", F.lit("")), F.lit("HEAD"),
    )
    number = F.substring("sha", 2, 20).cast("bigint")
    renamed = F.when(number % 3 == 0, F.concat(F.lit("\nR100\told/"), "sha", F.lit("\tnew"))).otherwise("")
    changed = F.when(number % 4 > 0, F.concat(F.lit("\nM\tsrc/"), "author_name", F.lit(".py"))).otherwise("")
    dropped = F.when(number % 7 == 0, F.concat(F.lit("lost"), *[sep] * 5, F.lit("\n"))).otherwise("")
    return t["commits"].select("repository", F.concat(dropped, header, renamed, changed).alias("block"))


@case("c28_logged_commits", "SELECT repository, sha, author_name, author_email, coalesce(message, '') AS message, epoch_us(date_trunc('day', committed_at)) AS committed_at FROM {commits}")
def _(t: Tables):
    return payloads.logged_commits(payloads.parse_git_log(_blocks(t)))


@case("c28_logged_files", """
SELECT repository, sha, 'R100' AS status, 'old/' || sha AS filename FROM {commits} WHERE CAST(substring(sha, 2) AS BIGINT) % 3 = 0
UNION ALL SELECT repository, sha, 'M', 'src/' || author_name || '.py' FROM {commits} WHERE CAST(substring(sha, 2) AS BIGINT) % 4 > 0""")
def _(t: Tables):
    return payloads.logged_files(payloads.parse_git_log(_blocks(t)))


# -- streams ------------------------------------------------------------------------------------


@case("f1_streamed_log_facts", f"WITH {FACTS_BODY} SELECT repository, job_id, error_reason, runner_image, operation_system, log_warn_nums, (SELECT count(*) FROM acts a WHERE a.job_id = f.job_id AND a.repository = f.repository) AS actions FROM facts f")
def _(t: Tables):
    arrived, stored = _folder(t, "logs"), _folder(t, "facts")
    ingest.write_arrivals(t["job_logs"], arrived)
    logs = ingest.stream_table(t.spark, arrived, TABLES["job_logs"], files_per_trigger=4)
    ingest.start_log_facts(logs, stored, _folder(t, "facts-progress")).awaitTermination()
    facts = ingest.load_facts(t.spark, stored)
    return facts.drop("has_text").withColumn("actions", F.size("actions"))


@case("f1_streamed_history", MERGED_HISTORY)
def _(t: Tables):
    arrived, stored, progress = _folder(t, "runs"), _folder(t, "history"), _folder(t, "history-progress")
    columns = [c.split(" ")[0] for c in TABLES["runs"].split(", ")]
    for part in (t["runs"], _updates(t)):
        ingest.write_arrivals(part.select(*columns), arrived)
        new = ingest.stream_table(t.spark, arrived, TABLES["runs"])
        ingest.start_run_history(new, stored, progress).awaitTermination()
    return keyed.read(t.spark, stored).select("repository", "run_id", "conclusion", "created_at")


_RUN_COLUMNS = [c.split(" ")[0] for c in TABLES["runs"].split(", ")]
_ARRIVED = "SELECT repository, run_id, conclusion, epoch_us(created_at) AS created_at FROM {runs}"


def _fresh(t: Tables, parts: list):
    arrived, stored, progress = _folder(t, "arrivals"), _folder(t, "fresh"), _folder(t, "fresh-progress")
    for part in parts:
        part.select(*_RUN_COLUMNS).write.mode("append").parquet(arrived)
        ingest.start_fresh_runs(ingest.stream_table(t.spark, arrived, TABLES["runs"]), stored, progress).awaitTermination()
    return t.spark.read.parquet(stored).select("repository", "run_id", "conclusion", "created_at")


@case("f1_streamed_fresh_runs", _ARRIVED)
def _(t: Tables):
    # every run arrives twice
    return _fresh(t, [t["runs"].union(t["runs"])])


@case("f1_streamed_late_runs", _ARRIVED)
def _(t: Tables):
    """The newer half of the runs arrives first, then all of them, the old ones weeks late."""
    middle = t["runs"].agg(F.percentile(F.unix_micros("created_at"), 0.5)).first()[0]
    newer = F.unix_micros("created_at") >= F.lit(int(middle))
    return _fresh(t, [t["runs"].filter(newer), t["runs"]])
