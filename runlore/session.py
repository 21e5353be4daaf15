"""Session helpers shared by the operators that have to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings a session should have. A stage with very many expressions becomes one method that the
# JVM refuses to compile above 8000 bytes of bytecode; below that limit Spark splits it instead. A plan that cuts its
# lineage runs as several executions, and the shuffle files of each go when it ends, not when the driver happens to
# collect its garbage; otherwise the disk holds those of all of them.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
# Tables that are read a few times and go again: smaller than with the default, for little more time.
COMPRESSION = "zstd"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The shared folder named by the cluster wins. Only a local session (tests) may fall
    back to a temporary folder, because executors on other machines cannot read it; it goes when the
    process ends.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that every executor can read")
        configured = tempfile.mkdtemp(prefix="runlore-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


class _Owned:
    """Paths of written tables that belong together and are removed together."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.lock = threading.Lock()

    def add(self, path: str) -> None:
        with self.lock:
            self.paths.append(path)

    def take(self) -> list[str]:
        with self.lock:
            paths, self.paths = self.paths, []
        return paths


# Tables written outside of any block, and the block that the running code is in. A thread starts outside
# of all blocks, so a block owns what its own code writes and nothing that another thread writes meanwhile.
_LOOSE = _Owned()
_BLOCK: ContextVar[_Owned | None] = ContextVar("runlore-block", default=None)


def own_path(path: str) -> str:
    """Register a path for removal with the block that the caller is in, or else with ``remove_tables``."""
    (_BLOCK.get() or _LOOSE).add(path)
    return path


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the checkpoint folder, registered for removal."""
    return own_path(f"{checkpoint_root(spark).rstrip('/')}/runlore-{kind}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it from there.

    A written table serves each later branch only the columns it needs, and its size is known to the
    optimizer. It outlives lost executors, like a checkpoint. It stays until the end of the
    ``temporary_tables`` block it was written in, or outside of blocks until ``remove_tables``, because
    frames that read it may still be used.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Like ``cut_lineage`` for what ``make`` returns; the tables it writes on the way go as soon as that is written."""
    path = new_path(spark)
    with temporary_tables(spark):
        df = make()
        df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _remove(spark: SparkSession, owned: _Owned) -> int:
    paths = owned.take()
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def remove_tables(spark: SparkSession) -> int:
    """Delete the tables written outside of blocks and say how many there were."""
    return _remove(spark, _LOOSE)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written inside the block when it ends; write or collect results within it.

    Blocks may be nested, and blocks of several threads do not touch each other's tables.
    """
    owned = _Owned()
    token = _BLOCK.set(owned)
    try:
        yield
    finally:
        _BLOCK.reset(token)
        _remove(spark, owned)
