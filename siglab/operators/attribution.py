"""Where a result comes from and how it bears worse conditions: regimes, cost ladder, stress scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.config import COST_LADDER
from siglab.functions import frames
from siglab.operators import features, scorecard
from siglab.plans import engine

#: Bars from which a regime's Sharpe ratio is told.
LEAST_BARS = 20


def by_regime(bars: DataFrame, keys: Sequence[str] = frames.KEYS, window: int = features.REGIME_WINDOW) -> DataFrame:
    """Figures of each volatility regime that occurs, low to stress; the bars of a regime are joined end to end."""
    own = [*keys, engine.CONFIG] if engine.CONFIG in bars.columns else list(keys)
    told = features.with_regimes(bars.select(*own, "ts", "close", "position", "strategy_return", "baseline_return"), window, own).filter("regime_order is not null")
    group = [*own, "regime_order", "vol_regime"]
    rows = told.withColumn("_eq", frames.compounded(F.col("strategy_return"), group)).withColumn("_dd", frames.below_peak(F.col("_eq"), group))
    std = F.stddev_pop("strategy_return")
    out = rows.groupBy(*group).agg(
        F.count("*").alias("n_days"), F.count_if(F.col("position") > 0).alias("active_days"), F.avg((F.col("position") > 0).cast("double")).alias("active_share"),
        (F.product(1 + F.col("strategy_return")) - 1).alias("total_return"), (F.product(1 + F.col("baseline_return")) - 1).alias("baseline_return"),
        F.when((F.count("*") >= LEAST_BARS) & (std > 0), frames.sharpe(F.avg("strategy_return"), std)).alias("sharpe_ratio"), F.min("_dd").alias("max_drawdown"),
    )
    return out.withColumnRenamed("vol_regime", "regime").orderBy(*own, "regime_order")


def cost_ladder(bars: DataFrame, keys: Sequence[str] = frames.KEYS, ladder: Sequence[float] = COST_LADDER, structured: bool = False) -> DataFrame:
    """Figures at each rung: the positions are the same, so bars are multiplied only after them.

    With ``structured`` fees the rungs have no effect, as a single cost is not what such a run pays.
    """
    own = [*keys, engine.CONFIG] if engine.CONFIG in bars.columns else list(keys)
    rungs = bars.select(*own, "ts", "position", "gross_return", "baseline_return", "turnover_", F.col("cost").alias("_own"), F.explode(F.array(*(F.lit(float(x)) for x in ladder))).alias("rung"))
    net = F.col("gross_return") - (F.col("_own") if structured else F.col("turnover_") * F.col("rung"))
    scored = scorecard.kpis(rungs.withColumn("strategy_return", net), [*own, "rung"])
    return scored.select(*own, F.col("rung").alias("cost"), "total_return", "sharpe_ratio", "max_drawdown", "trade_count", "turnover").orderBy(*own, "cost")


SCENARIOS = ("baseline", "higher_costs", "volatility_shock", "adverse_drift", "amplified_downside")


def stress(bars: DataFrame, keys: Sequence[str] = frames.KEYS, vol_shock: float = 1.5, drift: float = 0.0005, downside: float = 1.5, higher_cost: float = 0.005, structured: bool = False) -> DataFrame:
    """Return, Sharpe ratio and drawdown of the run's returns under each scenario."""
    own = [*keys, engine.CONFIG] if engine.CONFIG in bars.columns else list(keys)
    r = F.col("strategy_return")
    mean = F.avg(r).over(frames.Window.partitionBy(*own))
    dear = r if structured else F.col("gross_return") - F.col("turnover_") * higher_cost
    changed = (r, dear, mean + (r - mean) * vol_shock, r - drift, F.when(r >= 0, r).otherwise(r * downside))
    cases = F.array(*(F.struct(F.lit(i).alias("scenario_order"), F.lit(name).alias("scenario"), F.col(f"_{i}").alias("x")) for i, name in enumerate(SCENARIOS)))
    rows = bars.select(*own, "ts", *(x.alias(f"_{i}") for i, x in enumerate(changed))).select(*own, "ts", F.inline(cases))
    group = [*own, "scenario_order", "scenario"]
    rows = rows.withColumn("_eq", frames.compounded(F.col("x"), group)).withColumn("_dd", frames.below_peak(F.col("_eq"), group))
    return rows.groupBy(*group).agg((F.product(1 + F.col("x")) - 1).alias("total_return"), frames.sharpe(F.avg("x"), F.stddev_pop("x")).alias("sharpe_ratio"), F.min("_dd").alias("max_drawdown")).orderBy(*own, "scenario_order")
