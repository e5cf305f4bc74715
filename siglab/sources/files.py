"""Panels from CSV and Parquet files and from frames in memory, with the loader's gates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONAL = ("open", "high", "low", "volume", "benchmark_close")


def from_csv(spark: SparkSession, path: str, date_column: str | None = None, close_column: str = "close", series_column: str | None = None) -> DataFrame:
    """A validated panel from a CSV file with a header; all values are read as text and cast with checks."""
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise ValueError(f"CSV file not found: {path}")
    return load(spark.read.csv(str(path), header=True, inferSchema=False), date_column, close_column, series_column)


def from_pandas(spark: SparkSession, frame: pd.DataFrame, date_column: str | None = None, close_column: str = "close", series_column: str | None = None) -> DataFrame:
    """The same for a pandas frame."""
    if not isinstance(frame, pd.DataFrame):
        raise ValueError(f"from_pandas takes a pandas frame, not a {type(frame).__name__}.")
    if frame.empty:
        raise ValueError("There are no rows.")
    text = frame.astype(object).where(frame.notna(), None).map(lambda x: None if x is None else str(x))
    return load(spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in text.columns)), date_column, close_column, series_column)


def from_upload(spark: SparkSession, file_like) -> DataFrame:
    """The same for anything that pandas reads as CSV."""
    try:
        frame = pd.read_csv(file_like)
    except Exception as e:
        raise ValueError(f"Could not read the uploaded file as CSV: {e}") from e
    return from_pandas(spark, frame)


def from_parquet(spark: SparkSession, path: str, date_column: str | None = None, close_column: str = "close", series_column: str | None = None) -> DataFrame:
    return load(spark.read.parquet(path), date_column, close_column, series_column)


def sample(spark: SparkSession, rows: int = 420) -> DataFrame:
    """A generated series with a benchmark, for trying things out."""
    days = pd.bdate_range("2021-01-01", periods=rows)
    walk = lambda seed: np.round(100 * np.exp(np.cumsum(0.0002 + 0.012 * np.random.default_rng(seed).standard_normal(rows))), 4)
    return from_pandas(spark, pd.DataFrame({"date": days.strftime("%Y-%m-%d"), "close": walk(7), "benchmark_close": walk(8)}))


@contextmanager
def cached(panel: DataFrame) -> Iterator[DataFrame]:
    """``panel`` held by the executors while the block runs, and let go at its end."""
    held = panel.persist()
    try:
        yield held
    finally:
        held.unpersist()


def _column(raw: DataFrame, what: str, *wanted: str, exact: bool) -> str:
    """The first of the wanted columns that there is."""
    there = {c if exact else c.lower(): c for c in reversed(raw.columns)}
    for name in wanted:
        if name in there:
            return there[name]
    have = ", ".join(raw.columns) or "none"
    raise ValueError(f"No {what} column: looked for {' or '.join(wanted)}, have {have}." if not exact else f"'{wanted[0]}' column not found (as {what}); have {have}.")


#: What is said of so many rows that a gate counts, in the order of the gates; the first that isn't clean is raised.
GATES = {
    "bad": "{n} unparseable values in '{date}'.",
    "twice": "{n} rows are duplicate in '{date}'.",
    "missing": "{n} values of '{close}' are missing.",
    "low": "{n} values of '{close}' are non-positive.",
}


def parsed(raw: DataFrame, date_column: str | None = None, close_column: str = "close", series_column: str | None = None) -> DataFrame:
    """series_id, ts, close and the optional columns, null where a value can't be read; names match in any case, but for the close's."""
    date, close = _date(raw, date_column), _column(raw, "close", close_column, exact=True)
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None).cast("double"))
    optional = {c.lower(): c for c in raw.columns if c.lower() in OPTIONAL}
    return raw.select(
        (F.col(f"`{series_column}`").cast("string") if series_column else F.lit("series")).alias("series_id"), F.expr(f"coalesce(try_cast(`{date}` AS timestamp), try_cast(`{date}` AS date))").alias("ts"),
        number(close).alias("close"), *(number(optional[c]).alias(c) for c in OPTIONAL if c in optional),
    )


def gate_counts(frame: DataFrame) -> DataFrame:
    """One row: n_rows, and of how many rows each of :data:`GATES` complains."""
    same = frame.groupBy("series_id", "ts").agg(F.count("*").alias("rows"), F.count_if(F.col("close").isNull()).alias("missing"), F.count_if(F.col("close") <= 0).alias("low"))
    dated = F.col("ts").isNotNull()
    sums = {"n_rows": F.col("rows"), "bad": F.when(~dated, F.col("rows")), "twice": F.when(dated, F.col("rows") - 1), "missing": F.col("missing"), "low": F.col("low")}
    return same.agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()))


def _date(raw: DataFrame, date_column: str | None) -> str:
    return _column(raw, "timestamp", "date", "timestamp", exact=False) if date_column is None else _column(raw, "timestamp", date_column, exact=True)


def load(raw: DataFrame, date_column: str | None = None, close_column: str = "close", series_column: str | None = None) -> DataFrame:
    """What :func:`parsed` gives, after the gates; the first that isn't clean raises."""
    frame = parsed(raw, date_column, close_column, series_column)
    found = gate_counts(frame).first()
    if not found.n_rows:
        raise ValueError("There are no rows.")
    for gate, said in GATES.items():
        if found[gate]:
            raise ValueError(said.format(n=found[gate], date=_date(raw, date_column), close=close_column))
    return frame
