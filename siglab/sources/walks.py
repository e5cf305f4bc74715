"""Geometric walks: seeded, scaled out, or driven by the values of a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siglab.functions import frames

DRIFT, VOLATILITY, START = 0.0002, 0.012, 100.0


def business_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """ts: the days from Monday to Friday between two dates."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 day)) AS ts")
    return days.filter(F.weekday("ts") < 5)


def calendar(rows: DataFrame, date: str) -> DataFrame:
    """ts and n_rows: every day from Monday to Friday between the first and the last day of ``rows``, with the rows that
    fall on it, 0 where none does."""
    days = rows.select(F.col(date).cast("date").alias("ts")).filter("ts is not null").groupBy("ts").agg(F.count("*").alias("n_rows"))
    span = days.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).filter("a is not null")
    every = span.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("ts")).filter(F.weekday("ts") < 5)
    return every.join(days, "ts", "left").select("ts", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


def event_panel(events: DataFrame, hours: int = 1) -> DataFrame:
    """A series of hours for each type of event, from average values."""
    x = events.groupBy(F.col("event_type").alias("series_id"), F.window("ts", f"{hours} hours")["start"].alias("ts")).agg(F.avg("value").alias("x"))
    return from_values(x)


def seeded(spark: SparkSession, n_days: int = 750, seed: int = 42, start_value: float = START, drift: float = DRIFT, volatility: float = VOLATILITY, start_date: str = "2021-01-01", series_id: str = "synthetic") -> DataFrame:
    """A reproducible series of ``n_days`` business days; the same seed gives the same numbers everywhere."""
    if n_days <= 0:
        raise ValueError("n_days must be a positive integer.")
    shocks = np.random.default_rng(seed).standard_normal(n_days)
    close = start_value * np.exp(np.cumsum(drift + volatility * shocks))
    days = pd.bdate_range(start_date, periods=n_days).date
    return spark.createDataFrame(pd.DataFrame({"series_id": series_id, "ts": days, "close": close}), "series_id string, ts date, close double")


def scaled(spark: SparkSession, series: int, n_days: int, seed: int = 42, drift: float = DRIFT, volatility: float = VOLATILITY, start_date: str = "2021-01-01") -> DataFrame:
    """Many series made on the executors; other numbers than :func:`seeded` gives."""
    rows = spark.range(series * n_days).select((F.col("id") / n_days).cast("long").alias("s"), (F.col("id") % n_days).cast("int").alias("i"), F.randn(seed).alias("z"))
    week, day = F.floor(F.col("i") / 5) * 7, F.col("i") % 5
    dated = rows.select(F.concat(F.lit("s"), F.col("s")).alias("series_id"), F.date_add(F.next_day(F.lit(start_date).cast("date"), "Mon"), (week + day).cast("int")).alias("ts"), "z")
    return dated.select("series_id", "ts", walk(F.col("z"), drift, volatility).alias("close"))


def walk(z: Column, drift: float = DRIFT, volatility: float = VOLATILITY, start: float = START) -> Column:
    return start * F.exp(F.sum(drift + volatility * z).over(frames.upto()))


def from_values(values: DataFrame) -> DataFrame:
    """A panel (series_id, ts, close) whose shocks are the z-scores of ``values`` (series_id, ts, x) in each series."""
    whole = Window.partitionBy("series_id")
    z = values.withColumn("z", frames.ratio(F.col("x") - F.avg("x").over(whole), F.stddev_pop("x").over(whole)))
    return z.select("series_id", "ts", walk(F.col("z")).alias("close"))


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six series of days, by return flag and line status, from average prices."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    daily = rows.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.col("l_shipdate").cast("date").alias("ts")).agg(F.avg("l_extendedprice").alias("x"))
    return from_values(daily)


def with_benchmark(panel: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``panel`` with the walk of all series' daily average as ``benchmark_close``."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    daily = rows.groupBy(F.lit("all").alias("series_id"), F.col("l_shipdate").cast("date").alias("ts")).agg(F.avg("l_extendedprice").alias("x"))
    other = from_values(daily).select("ts", F.col("close").alias("benchmark_close"))
    return panel.join(other, "ts", "left").select("series_id", "ts", "close", "benchmark_close")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five series of days, by order priority, from average order values."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_values(rows.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts")).agg(F.avg("o_totalprice").alias("x")))
