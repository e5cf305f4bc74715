"""Turnover and what it costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.functions import frames

PARTS = ("fee", "spread", "slippage")


def decomposed(df: DataFrame) -> DataFrame:
    """``turnover_`` times each rate: fee_cost, spread_cost, slippage_cost and their sum, cost."""
    turn = F.col("turnover_")
    parts = df.withColumns({f"{p}_cost": turn * F.col(f"{p}_rate") for p in PARTS})
    return parts.withColumn("cost", turn * (F.col("fee_rate") + F.col("spread_rate") + F.col("slippage_rate")))


def turned(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``turnover_``: the size of the change of position, 0 on the first bar."""
    return df.withColumn("turnover_", F.coalesce(F.abs(F.col("position") - frames.back(F.col("position"), 1, keys)), F.lit(0.0)))
