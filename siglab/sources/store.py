"""A panel kept for repeated runs: a bucketed, sorted table whose layout is the one that windows over series ask for.

Every sweep over a plain panel begins with an exchange by series. A stored one was exchanged once, when it was written:
its rows lie in buckets by series, sorted by time, a file a bucket and load, so windows and scorecards over series,
and over (series, configuration), read it in place.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglab.functions import frames

#: Series and rows that a bucket is meant to hold; more buckets are more tasks.
ROWS_A_BUCKET = 4_000_000
_WRITTEN: list[tuple[SparkSession, str]] = []


def buckets_for(panel: DataFrame, rows: int = ROWS_A_BUCKET) -> int:
    """As many as the panel's size asks for, but no more than there are series, and at least one."""
    n, series = panel.agg(F.count("*"), F.approx_count_distinct("series_id")).first()
    return max(1, min(series, max(panel.sparkSession.sparkContext.defaultParallelism, -(-n // rows))))


def write(panel: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Stores a panel as a new table of the catalog (below ``path``, if given) and returns it as read back."""
    many = buckets or buckets_for(panel)
    dealt = panel.repartition(many, *frames.KEYS).sortWithinPartitions(*frames.KEYS, "ts")
    writer = dealt.write.format("parquet").bucketBy(many, *frames.KEYS).sortBy(*frames.KEYS, "ts")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return read(panel.sparkSession, table)


def append(panel: DataFrame, table: str) -> DataFrame:
    """Adds rows to a stored panel, in its buckets. Rows that it has already would be there twice: those of a series
    and time that are known are left out."""
    spark = panel.sparkSession
    held = read(spark, table)
    many = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Num Buckets"))
    fresh = panel.select(*held.columns).join(held.select(*frames.KEYS, "ts"), [*frames.KEYS, "ts"], "left_anti").select(*held.columns)
    fresh.repartition(many, *frames.KEYS).sortWithinPartitions(*frames.KEYS, "ts").write.format("parquet").mode("append").bucketBy(many, *frames.KEYS).sortBy(*frames.KEYS, "ts").saveAsTable(table)
    return read(spark, table)


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def once(panel: DataFrame) -> DataFrame:
    """``panel`` as written below the shared folder (``spark.checkpoint.dir``) and read back: every use reads the same
    numbers, where sums over a shuffle would differ in their last bits each time. Deleted when the driver process ends."""
    spark = panel.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siglab_checkpoints"
    path = f"{shared.rstrip('/')}/siglab/{spark.sparkContext.applicationId}/panel-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    panel.write.parquet(path)
    return spark.read.schema(panel.schema).parquet(path)


def _release() -> None:
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may already have ended
            continue


atexit.register(_release)
