"""CSV text as it comes, a line a row: good lines become a panel, bad ones are kept with the reason.

Where :func:`files.from_csv` raises at the first gate that isn't clean, this lets a load of many files go on: every line
ends up on one of the two sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Reasons, in the order in which they are looked for: a line is rejected for the first that applies.
REASONS = ("fields", "series", "date", "close missing", "close not positive", "repeated")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def sorted_out(lines: DataFrame, fields: Sequence[str] = ("series_id", "ts", "close"), header: bool = False) -> DataFrame:
    """line, series_id, ts, close, reason of each line: ``reason`` is null for good ones, else one of :data:`REASONS`.

    ``fields``: names of the columns, in the lines' order; series_id, ts and close must be among them. A line has to
    have as many fields. With ``header``, lines that repeat these names are passed over. Of several good lines of one
    series and time, the least line stays and the others are ``repeated``; that needs the lines of a series and time together, nothing
    larger.
    """
    schema = ", ".join(f"`{c}` string" for c in fields) + ", bad_ string"
    split = F.from_csv("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_"})
    told = lines.filter(F.col("line") != ",".join(fields)) if header else lines
    x = told.select("line", split.alias("x")).select("line", "x.*")
    number = F.expr("try_cast(close AS double)")
    read = x.select(
        "line", F.when(F.trim("series_id") != "", F.trim("series_id")).alias("series_id"), F.expr("coalesce(try_cast(trim(ts) AS timestamp), try_cast(trim(ts) AS date))").alias("ts"),
        F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number).alias("close"), (F.col("bad_").isNotNull() | F.coalesce(F.trim("line") == "", F.lit(True))).alias("odd"),
    )
    first = F.when(F.col("odd"), "fields").when(F.col("series_id").isNull(), "series").when(F.col("ts").isNull(), "date").when(F.col("close").isNull(), "close missing").when(F.col("close") <= 0, "close not positive")
    judged = read.withColumn("reason", first).drop("odd")
    good = judged.filter("reason is null")
    place = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy("line"))
    once = good.withColumn("reason", F.when(place > 1, "repeated"))
    bad = judged.filter("reason is not null").withColumns({"series_id": F.lit(None).cast("string"), "ts": F.lit(None).cast("timestamp"), "close": F.lit(None).cast("double")})
    return once.unionByName(bad)


def panel(found: DataFrame) -> DataFrame:
    """The good lines of :func:`sorted_out`: series_id, ts, close."""
    return found.filter("reason is null").select("series_id", "ts", "close")


def rejected(found: DataFrame) -> DataFrame:
    """The others: line and reason."""
    return found.filter("reason is not null").select("line", "reason")
