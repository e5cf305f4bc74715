"""Sessions of events: as one aggregate, and as a stream that keeps late events apart.

An event belongs to its user's session if it comes no later than ``gap`` after the one before. In batch that is Spark's
session window. In a stream, Spark drops events behind the watermark without a trace; :class:`Sessions` merges
each micro-batch into the open sessions, closes those that the watermark has passed, and writes late events to a
table of their own. What a micro-batch writes lies in folders of its number, so a repeated one replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP = 30 * 60
_SESSION = "user_id long, began timestamp, ended timestamp, n long, total double"


def sessions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """user_id, began, ended (``gap`` seconds after the last event), n, total (of value)."""
    found = events.filter("ts is not null").groupBy("user_id", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "total")


def merged(parts: DataFrame) -> DataFrame:
    """Sessions that overlap or touch, put together."""
    own = Window.partitionBy("user_id").orderBy("began", "ended")
    reach = F.max("ended").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("began") <= F.col("reach"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    marked = parts.withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy("user_id", "island").agg(F.min("began").alias("began"), F.max("ended").alias("ended"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("island")


class Sessions:
    """Folders below ``path``: ``done`` (closed sessions), ``late`` (events behind the watermark), ``open`` and ``mark`` (the state)."""

    def __init__(self, spark: SparkSession, path: str, gap: int = GAP, delay: int = 3600):
        """``delay``: seconds that the watermark stays behind the latest event."""
        self.spark, self.path, self.gap, self.delay = spark, path.rstrip("/"), gap, delay

    def _at(self, what: str, batch: int) -> str:
        return f"{self.path}/{what}/batch={batch}"

    def take(self, events: DataFrame, batch: int) -> None:
        """One micro-batch. The state is that of the batch before, however often this one is run."""
        spark = events.sparkSession
        if batch:
            was = spark.read.parquet(self._at("open", batch - 1))
            latest = spark.read.parquet(self._at("mark", batch - 1)).first()[0]
        else:
            was, latest = spark.createDataFrame([], _SESSION), None
        held = events.persist()
        try:
            behind = F.lit(latest) - F.expr(f"interval {self.delay} seconds") if latest else F.lit(None).cast("timestamp")
            late = F.coalesce(F.col("ts") < behind, F.lit(False))
            held.filter(late).write.mode("overwrite").parquet(self._at("late", batch))
            seen = [x for x in (latest, held.agg(F.max("ts")).first()[0]) if x is not None]
            latest = max(seen) if seen else None
            now = merged(was.unionByName(sessions(held.filter(~late), self.gap))).persist()
            closed = F.col("ended") < (F.lit(latest) - F.expr(f"interval {self.delay} seconds")) if latest else F.lit(False)
            now.filter(closed).write.mode("overwrite").parquet(self._at("done", batch))
            now.filter(~closed).write.mode("overwrite").parquet(self._at("open", batch))
            now.unpersist()
            spark.createDataFrame([(latest,)], "latest timestamp").write.mode("overwrite").parquet(self._at("mark", batch))
        finally:
            held.unpersist()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def table(self, what: str) -> DataFrame:
        """All batches' ``done`` or ``late``."""
        return self.spark.read.parquet(f"{self.path}/{what}").drop("batch")
