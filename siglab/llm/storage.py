"""Shared scratch space for intermediate tables.

Intermediate tables are written as Parquet below the folder named by ``spark.checkpoint.dir`` (a folder that
the driver and every executor can reach), so a lost executor never takes the only copy with it. Where that
setting is absent, a local session, as in tests, uses a folder below the warehouse; any other master raises, as
nothing says which folder its executors share.

A :class:`Scratch` holds the tables of one run of an operator: each is deleted by name when its successor is
written, what is left at the end of the run, also of one that fails. Tables that a result still reads are written
by :func:`materialise`, and deleted by :func:`release` or when the driver process ends. Shuffle files of a write
are let go when the write is done, by Spark's own setting for that.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_NO_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siglab_checkpoints"


def spread(df: DataFrame) -> DataFrame:
    """``df`` itself, or dealt round-robin where it is read in fewer parts than there are cores, as a table of one small
    file is; a table of a part or more for each core is never shuffled by this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the actions inside; the session's own come back after."""
    was = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_let_go(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of the actions inside are deleted as each ends."""
    return _set(spark, _CLEAN)


def new_path(spark: SparkSession, name: str) -> str:
    """Where nothing is yet, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/siglab/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    try:
        with shuffles_let_go(spark):
            df.write.option("compression", "zstd").parquet(path)
    except BaseException:
        delete(spark, path)
        raise
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below the shared folder and returns it as read back: later uses don't recompute it."""
    back, path = _write(df, name)
    _WRITTEN.append((df.sparkSession, path))
    return back


class Scratch:
    """The intermediate tables of one run of an operator; a context manager that deletes what is left of them."""

    def __init__(self, spark: SparkSession, broadcasts: bool = True):
        """Without ``broadcasts``, its tables are made with the same joins at every size."""
        self.spark, self.settings = spark, {} if broadcasts else _NO_BROADCASTS
        self.held: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as written and read back."""
        with _set(self.spark, self.settings):
            back, path = _write(df, name)
        self.held.append((back, path))
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that :meth:`keep` gave, as their successors are written."""
        gone = [path for df, path in self.held if any(df is x for x in tables)]
        self.held = [x for x in self.held if x[1] not in gone]
        for path in gone:
            delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(df for df, _ in self.held))


def mark() -> int:
    """A point in time for :func:`release`."""
    return len(_WRITTEN)


def release(since: int = 0) -> None:
    """Deletes every table that :func:`materialise` wrote (since :func:`mark`); results that still depend on them can't be read then."""
    while len(_WRITTEN) > since:
        spark, path = _WRITTEN.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may already have ended
            continue


atexit.register(release)
