"""Sizing, limits, the lag of one bar, and the drawdown guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.config import SIZING_METHODS, StrategyConfig
from siglab.errors import ValidationError
from siglab.functions import chunks, frames
from siglab.operators.families import Shared

#: Rows of the volatility that the cap looks at.
CAP_ROWS = 20


def limits(c: StrategyConfig) -> tuple[float, float]:
    return (-c.max_exposure if c.allow_short else 0.0), c.max_exposure


def sized(target: Column, c: StrategyConfig, s: Shared) -> Column:
    """The target scaled by the sizing method and clipped to the limits."""
    if c.sizing_method not in SIZING_METHODS:
        raise ValidationError(f"Unknown sizing_method '{c.sizing_method}'.")
    x = target
    if c.sizing_method in ("fixed_fraction", "capped_exposure"):
        x = target * c.fixed_fraction
    elif c.sizing_method == "volatility_target":
        x = target * frames.ratio(F.lit(float(c.target_volatility)), frames.annual(s.volatility(c.vol_lookback, "market_return")))
    return frames.clip(x, *limits(c))


def capped(x: Column, c: StrategyConfig, s: Shared) -> Column:
    """The volatility cap and the limits again, where risk controls are on."""
    if not c.use_risk_controls:
        return x
    vol = frames.annual(s.volatility(CAP_ROWS, "market_return"))
    scale = F.coalesce(F.when(vol > 0, F.least(F.lit(1.0), frames.ratio(F.lit(float(c.vol_cap)), vol))), F.lit(1.0))
    return frames.clip(x * scale, *limits(c))


def lagged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``position``: the exposure of the bar before, 0 at first and while unknown."""
    return df.withColumn("position", F.coalesce(frames.back(F.col("exposure"), 1, keys), F.lit(0.0)))


def guarded(df: DataFrame, keys: Sequence[str], level: str = "guard_level") -> DataFrame:
    """``position`` set to 0 on every bar after the first where gross equity stands ``level`` or more below its peak.

    Flat equity can never make a new high, so the guard stays once it has struck: the closed form is a latch, not
    a loop. Equity here is before costs and its peak is at least 1; a null level means no guard.
    """
    e = df.withColumn("_e", frames.compounded(F.col("position") * F.col("market_return"), keys))
    p = e.withColumn("_p", F.greatest(F.lit(1.0), F.max("_e").over(frames.upto(keys))))
    b = p.withColumn("_b", F.coalesce(F.col("_e") / F.col("_p") - 1 <= -F.abs(F.col(level)), F.lit(False)))
    before = frames.ordered(keys).rowsBetween(frames.Window.unboundedPreceding, -1)
    struck = F.coalesce(F.bool_or("_b").over(before), F.lit(False))
    return b.withColumn("position", F.when(struck, 0.0).otherwise(F.col("position"))).drop("_e", "_p", "_b")


def compute_exposure(df: DataFrame, c: StrategyConfig, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """``df`` (with target and market_return) with ``exposure`` after sizing and risk controls."""
    shared = Shared(keys)
    x = capped(sized(F.col("target"), c, shared), c, shared)
    return shared.add(df).withColumn("exposure", x).drop(*shared.first)


def guarded_by_chunks(df: DataFrame, keys: Sequence[str], level: str = "guard_level", before: str = "before_") -> DataFrame:
    """:func:`guarded` over series in chunks; ``before``, the position one bar earlier, is guarded too.

    What a chunk does to the guard is a function of the equity E and peak P that enter it. With g its own growth and m
    the maximum of that so far, a bar breaches if g / m or E * g / P is low enough; so a chunk's summary is its growth,
    its highest m, its lowest g / m and its lowest g, the last two also without its last bar, as what was breached
    there strikes two bars on. Summaries are scanned in the order of chunks, then each row looks at what
    enters its chunk. Levels are at most 1.
    """
    own = [*keys, chunks.CHUNK]
    far = -F.abs(F.col(level))
    low = lambda x: F.coalesce(x - 1 <= far, F.lit(False))
    grown = 1 + F.col("position") * F.col("market_return")
    upto = frames.upto(own, chunks.AT)
    g = df.withColumn("g_", F.product(grown).over(upto)).withColumn("m_", F.greatest(F.lit(0.0), F.max("g_").over(upto)))
    g = g.withColumn("own_", frames.ratio(F.col("g_"), F.col("m_"))).withColumn("more_", F.lead(chunks.AT).over(frames.ordered(own, chunks.AT)).isNotNull())
    inner = lambda c: F.min(F.when(F.col("more_"), F.col(c)))
    summary = g.groupBy(*own, level).agg(F.max_by("g_", chunks.AT).alias("growth_"), F.max("m_").alias("top_"), F.min("own_").alias("l_"), F.min("g_").alias("n_"), inner("own_").alias("li_"), inner("g_").alias("ni_"))
    past = frames.ordered(keys, chunks.CHUNK).rowsBetween(frames.Window.unboundedPreceding, -1)
    entered = summary.withColumn("e_", F.coalesce(F.product("growth_").over(past), F.lit(1.0)))
    entered = entered.withColumn("p_", F.greatest(F.lit(1.0), F.max(F.col("e_") * F.col("top_")).over(past)))
    at = lambda c: F.col("e_") * F.col(c) / F.col("p_")
    entered = entered.withColumn("hit_", low(F.col("l_")) | low(at("n_"))).withColumn("early_", low(F.col("li_")) | low(at("ni_")))
    entered = entered.withColumn("struck_", F.coalesce(F.bool_or("hit_").over(past), F.lit(False)))
    # Whether the last bar before the chunk was struck already.
    entered = entered.withColumn("was_", F.coalesce(F.lag(F.col("struck_") | F.col("early_")).over(frames.ordered(keys, chunks.CHUNK)), F.lit(False)))
    met = g.join(entered.select(*own, "e_", "p_", "struck_", "was_"), own, "left")
    met = met.withColumn("hit_", low(F.col("own_")) | low(at("g_")))
    here = F.coalesce(F.bool_or("hit_").over(frames.ordered(own, chunks.AT).rowsBetween(frames.Window.unboundedPreceding, -1)), F.lit(False))
    met = met.withColumn("now_", F.col("struck_") | here)
    met = met.withColumn("then_", F.coalesce(F.lag("now_").over(frames.ordered(own, chunks.AT)), F.col("was_")))
    flat = {"position": F.when(F.col("now_"), 0.0).otherwise(F.col("position")), before: F.when(F.col("then_") & F.col(before).isNotNull(), 0.0).otherwise(F.col(before))}
    return met.withColumns(flat).select(*(F.col(f"`{c}`") for c in df.columns))
