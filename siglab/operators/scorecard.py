"""The scorecard of a run or of a slice of one: base and extended figures, one row for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab.config import TRADING_DAYS
from siglab.functions import frames

KPIS = (
    "total_return", "baseline_return", "excess_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "calmar_ratio",
    "information_ratio", "max_drawdown", "active_days", "trade_count", "turnover", "correlation_to_baseline", "win_loss_ratio",
)
EXTENDED = ("cagr", "exposure_avg", "exposure_max", "best_day", "worst_day", "win_rate", "gross_return", "cost_drag", "rolling_sharpe_median", "benchmark_return", "benchmark_excess")
ROLLING = 63


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def kpis(bars: DataFrame, keys: Sequence[str], extended: bool = False) -> DataFrame:
    """Figures of each group of bars. Equity, peaks and turnover begin anew at a group's first bar, so a slice
    of a run is scored by making the slice part of ``keys``."""
    s, b, p = F.col("strategy_return"), F.col("baseline_return"), F.col("position")
    more = [c for c in ("benchmark_return",) if c in bars.columns]
    rows = bars.select(*keys, "ts", "strategy_return", "baseline_return", "position", *(["gross_return", *more] if extended else []))
    rows = rows.withColumn("_eq", frames.compounded(s, keys)).withColumn("_turn", _or_zero(F.abs(p - frames.back(p, 1, keys))))
    rows = rows.withColumn("_dd", frames.below_peak(F.col("_eq"), keys))
    if extended:
        rows = rows.withColumn("_rs", frames.rolling_sharpe(s, ROLLING, keys))
    growth = lambda x: F.product(1 + F.col(x)) - 1
    aggs = {
        "n_bars": F.count("*"), "total_return": growth("strategy_return"), "baseline_return": growth("baseline_return"), "_std": F.stddev_pop("strategy_return"), "_mean": F.avg("strategy_return"),
        "_down": F.stddev_pop(F.when(s < 0, s)), "max_drawdown": F.min("_dd"), "active_days": F.count_if(p > 0), "trade_count": F.count_if(F.col("_turn") > 0), "turnover": F.avg("_turn"),
        "_corr": F.when((F.stddev_pop("strategy_return") > 0) & (F.stddev_pop("baseline_return") > 0), F.corr("strategy_return", "baseline_return")),
        "_ex": F.avg(s - b), "_exstd": F.stddev_pop(s - b), "_win": F.avg(F.when(s > 0, s)), "_loss": F.avg(F.when(s < 0, s)),
    }
    if extended:
        aggs |= {
            "exposure_avg": F.avg("position"), "exposure_max": F.max("position"), "best_day": F.max("strategy_return"), "worst_day": F.min("strategy_return"), "win_rate": F.avg((s > 0).cast("double")),
            "gross_return": growth("gross_return"), "rolling_sharpe_median": F.percentile("_rs", F.lit(0.5)),
            "benchmark_return": growth("benchmark_return") if more else F.lit(None).cast("double"),
        }
    g = rows.groupBy(*keys).agg(*(v.alias(k) for k, v in aggs.items()))
    tr = F.col("total_return")
    out = g.withColumns({
        "excess_return": tr - F.col("baseline_return"),
        "annualized_return": F.when(1 + tr > 0, F.pow(1 + tr, F.lit(float(TRADING_DAYS)) / F.col("n_bars")) - 1).otherwise(0.0),
        "annualized_volatility": frames.annual(F.col("_std")),
        "sharpe_ratio": frames.sharpe(F.col("_mean"), F.col("_std")),
        "sortino_ratio": frames.sharpe(F.col("_mean"), F.col("_down")),
        "correlation_to_baseline": _or_zero(F.col("_corr")),
        "information_ratio": frames.sharpe(F.col("_ex"), F.col("_exstd")),
        "win_loss_ratio": _or_zero(frames.ratio(F.col("_win"), F.abs("_loss"))),
    })
    out = out.withColumn("calmar_ratio", F.when(F.col("max_drawdown") < 0, frames.ratio(F.col("annualized_return"), F.abs("max_drawdown"))).otherwise(0.0))
    if extended:
        out = out.withColumns({"cagr": F.col("annualized_return"), "cost_drag": F.col("gross_return") - tr, "benchmark_excess": tr - F.col("benchmark_return")})
    return out.select(*keys, *KPIS, *(EXTENDED if extended else ()))
