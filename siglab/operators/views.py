"""What charts and tables show of a run: small projections of bars and scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglab.functions import frames
from siglab.plans import engine

# The scorecard's rows in order, with titles and formats.
SCORECARD = (
    ("total_return", "Total return", "pct"), ("baseline_return", "Baseline return", "pct"), ("excess_return", "Excess vs baseline", "pct"), ("annualized_return", "Annualised return", "pct"),
    ("annualized_volatility", "Annualised volatility", "pct"), ("sharpe_ratio", "Sharpe", "x"), ("sortino_ratio", "Sortino", "x"), ("calmar_ratio", "Calmar", "x"),
    ("information_ratio", "Information ratio", "x"), ("max_drawdown", "Max drawdown", "pct"), ("turnover", "Avg turnover", "x"), ("trade_count", "Trade count", "int"),
)


def _own(bars: DataFrame, keys: Sequence[str]) -> list[str]:
    return [*keys, engine.CONFIG] if engine.CONFIG in bars.columns else list(keys)


def _percent(c: str):
    return (F.col(c) - 1) * 100


def equity(bars: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    return bars.select(*_own(bars, keys), "ts", _percent("strategy_equity").alias("strategy"), _percent("baseline_equity").alias("baseline"))


def drawdown(bars: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    own = _own(bars, keys)
    return bars.select(*own, "ts", (frames.below_peak(F.col("strategy_equity"), own) * 100).alias("drawdown"))


def trough(bars: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """The deepest drawdown of each run and its first day; drawdowns that are the same to nine digits are equally deep, as
    the last bits of a product over flat bars depend on how it is multiplied."""
    own = _own(bars, keys)
    return drawdown(bars, keys).groupBy(*own).agg(F.min("drawdown").alias("trough"), F.min_by("ts", F.struct(F.round("drawdown", 9), "ts")).alias("trough_ts"))


def gross_net(bars: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    return bars.select(*_own(bars, keys), "ts", _percent("gross_equity").alias("gross"), _percent("strategy_equity").alias("net"))


def exposure(bars: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    return bars.select(*_own(bars, keys), "ts", F.col("position").alias("exposure"))


def benchmark(bars: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame | None:
    """Against the benchmark, or None where there is none."""
    if "benchmark_equity" not in bars.columns:
        return None
    return bars.select(*_own(bars, keys), "ts", _percent("strategy_equity").alias("strategy"), _percent("benchmark_equity").alias("benchmark"))


def rolling_risk(bars: DataFrame, window: int = 63, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    own, r = _own(bars, keys), F.col("strategy_return")
    return bars.select(*own, "ts", (frames.rolling_volatility(r, 20, own) * 100).alias("rolling_vol"), frames.rolling_sharpe(r, window, own).alias("rolling_sharpe"))


def cost_breakdown(bars: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """A row for each part of the costs: its sum, in percent of the notional."""
    own = _own(bars, keys)
    parts = [(label, F.sum(f"{p}_cost") * 100) for p, label in (("fee", "Fee"), ("spread", "Spread"), ("slippage", "Slippage"))]
    wide = bars.groupBy(*own).agg(*(v.alias(k) for k, v in parts))
    return wide.unpivot(own, [k for k, _ in parts], "component", "cost_drag")


def scorecard(by_segment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each figure, early and late bars side by side, in the order of display."""
    values = [F.col(k).cast("double").alias(k) for k, _, _ in SCORECARD]
    long = by_segment.select(*keys, "segment", *values).unpivot([*keys, "segment"], [k for k, _, _ in SCORECARD], "metric", "value")
    at = lambda x: F.max(F.when(F.col("segment") == x, F.col("value")))
    return long.groupBy(*keys, "metric").agg(at("train").alias("in_sample"), at("test").alias("out_of_sample"))


def formatted(value: float, kind: str) -> str:
    if kind == "pct":
        return f"{value * 100:+.1f}%" if value else "0.0%"
    return f"{int(value)}" if kind == "int" else f"{value:.2f}"


def histogram(rows: DataFrame, column: str, bins: int = 40, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """bin (1 to ``bins``) and count of the values of ``column`` over equal widths from least to greatest; the last bin holds the greatest."""
    ends = Window.partitionBy(*keys)
    x = F.col(column)
    low, high = F.min(x).over(ends), F.max(x).over(ends)
    at = F.when(low == high, 1).otherwise(F.least(F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * bins) + 1, F.lit(bins)))
    return rows.filter(x.isNotNull()).withColumn("bin", at.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def normalised(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """Each column scaled to 0..1 over a series' rows, 0.5 where it doesn't vary."""
    w = Window.partitionBy(*keys)
    scaled = {c: F.when(F.max(c).over(w) == F.min(c).over(w), 0.5).otherwise(frames.ratio(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))) for c in columns}
    return rows.withColumns({f"{c}_scaled": v for c, v in scaled.items()})


def top(scored: DataFrame, n: int = 6, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """The n best configurations of each series with three figures."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("sharpe_ratio"), engine.CONFIG)
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(*keys, "place", "label", "total_return", "sharpe_ratio", "max_drawdown")
