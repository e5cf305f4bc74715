"""Causal rolling features and volatility regimes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.functions import frames

# Windows of the standard feature set, names and bounds of regimes.
TREND = (10, 20, 60)
MOMENTUM = (10, 20, 60)
VOLATILITY = (20, 60)
REGIME_WINDOW = 60
REGIMES = ("low", "normal", "high", "stress")
REGIME_BOUNDS = (0.33, 0.66, 0.90)


def return_features(keys: Sequence[str] = frames.KEYS) -> dict[str, Column]:
    close = F.col("close")
    return {"return_1d": frames.change(close, 1, keys), "log_return": F.ln(close) - F.ln(frames.back(close, 1, keys))}


def trend_features(windows: Sequence[int] = TREND, keys: Sequence[str] = frames.KEYS) -> dict[str, Column]:
    close, out = F.col("close"), {}
    for w in windows:
        mean, std = frames.full(F.avg, close, w, keys), frames.full(F.stddev_pop, close, w, keys)
        out |= {f"ma_{w}": mean, f"price_to_ma_{w}": frames.ratio(close, mean) - 1, f"zscore_{w}": frames.ratio(close - mean, std)}
    return out


def momentum_features(windows: Sequence[int] = MOMENTUM, keys: Sequence[str] = frames.KEYS) -> dict[str, Column]:
    return {f"momentum_{w}": frames.change(F.col("close"), w, keys) for w in windows}


def volatility_features(windows: Sequence[int] = VOLATILITY, keys: Sequence[str] = frames.KEYS) -> dict[str, Column]:
    """Needs ``return_1d``."""
    close, out = F.col("close"), {}
    for w in windows:
        out |= {f"vol_{w}": frames.full(F.stddev_pop, F.col("return_1d"), w, keys), f"drawdown_from_high_{w}": close / F.max(close).over(frames.last_rows(w, keys)) - 1}
    return out


def with_regimes(panel: DataFrame, window: int = REGIME_WINDOW, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """``panel`` with regime_vol, vol_regime and regime_order, by quantiles of each whole series (attribution only:
    they look ahead). Rows without an id have no series and are left out."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    vol = panel.filter(known).withColumn("_ret", frames.change(F.col("close"), 1, keys)).withColumn("regime_vol", frames.full(F.stddev_pop, F.col("_ret"), window, keys)).drop("_ret")
    # By how many values are lower, not against a quantile that another reading of the panel gave: a value that is the
    # quantile must not differ from it in its last bits.
    lower = F.rank().over(frames.Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_known"))) - 1
    ranked = vol.withColumn("_known", F.nanvl("regime_vol", F.lit(None))).withColumns({"_lower": lower, "_n": F.count("_known").over(frames.Window.partitionBy(*keys))})
    low = lambda p: F.col("_lower") <= F.floor((F.col("_n") - 1) * p)
    told = F.col("regime_vol").isNotNull() & (F.col("_n") > 0)
    order = F.when(told & low(REGIME_BOUNDS[0]), 0).when(told & low(REGIME_BOUNDS[1]), 1).when(told & low(REGIME_BOUNDS[2]), 2).when(told, 3)
    named = F.get(F.array(*map(F.lit, REGIMES)), F.col("regime_order"))
    return ranked.withColumn("regime_order", order).withColumn("vol_regime", named).drop("_known", "_lower", "_n")


def feature_frame(panel: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """series_id, ts, close and the 20 standard feature columns."""
    first = panel.select(*keys, "ts", "close").withColumns(return_features(keys))
    wide = first.withColumns({**trend_features(keys=keys), **momentum_features(keys=keys), **volatility_features(keys=keys)})
    return with_regimes(wide, keys=keys).drop("regime_order")
