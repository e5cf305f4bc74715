"""The backtest of long series: what :mod:`engine` computes, with no task that reads a whole series.

Rows are numbered in two levels and cut into chunks. Features, signals and exposures are windows over chunks that are
lent the rows before them; the guard, costs and equities are scans: totals of chunks, a running aggregate over the
totals, then the rows. The filter's threshold comes from look-ups over blocks of values. All of these read the panel, so
it is written once first: numbers that differed between two readings would not be found where they were counted.

For many series of moderate length :func:`engine.bars` does with one exchange; this is for series that one task
shouldn't read alone. Series need an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.config import StrategyConfig
from siglab.functions import chunks, frames, running
from siglab.operators import costs, exposure, families
from siglab.plans import engine
from siglab.sources import store


class _Joined(families.Shared):
    """Columns over chunks; thresholds are columns that the rows have already."""

    def with_threshold(self, df: DataFrame, value: str, q: float, least: int, name: str) -> DataFrame:
        return df


def lookback(configs: Sequence[StrategyConfig]) -> int:
    """Rows before a bar that its windows, its lag and the change of its position may read."""
    return max(max(c.warmup, c.short_window, c.vol_filter_window, c.vol_lookback, exposure.CAP_ROWS) for c in configs) + 3


def numbered(panel: DataFrame, keys: Sequence[str] = frames.KEYS, rows: int = chunks.ROWS) -> DataFrame:
    return chunks.numbered(panel, keys, [F.asc("ts")], chunks.time_bucket(panel, rows=rows))


def with_thresholds(placed: DataFrame, configs: Sequence[StrategyConfig], keys: Sequence[str], rows: int) -> DataFrame:
    """Numbered rows with a column for each threshold that the configurations ask for."""
    asked = families.Shared(keys)
    for c in configs:
        families.signal(c, asked)
    for name, (value, least, q) in asked.second.items():
        own = families.Shared([*keys, chunks.CHUNK])
        own.volatility(least)
        slim = chunks.lent(placed.select(*keys, "ts", "close", chunks.AT), keys, least + 1, rows)
        vol = chunks.returned(own.add(engine.returns(slim, own.keys))).select(*keys, chunks.AT, value)
        found = running.long_thresholds(vol, value, q, least, keys, name=name, rows=rows)
        placed = placed.join(found, [*keys, chunks.AT], "left")
    return placed


def bars(panel: DataFrame, configs: Sequence[StrategyConfig] | StrategyConfig, keys: Sequence[str] = frames.KEYS, components: bool | None = None, rows: int = chunks.ROWS) -> DataFrame:
    """The columns and rows of :func:`engine.bars`, by chunks of ``rows`` rows."""
    configs = [configs] if isinstance(configs, StrategyConfig) else list(configs)
    if not configs:
        raise ValueError("At least one configuration is needed.")
    keys = list(keys)
    run, inner = [*keys, engine.CONFIG], [*keys, chunks.CHUNK]
    placed = with_thresholds(numbered(store.once(panel), keys, rows), configs, keys, rows)
    wide = engine.exposures(chunks.lent(placed, keys, lookback(configs), rows), configs, _Joined(inner), len(configs) == 1 if components is None else components)
    held = exposure.lagged(wide, [*inner, engine.CONFIG])
    earlier = {"before_": frames.back(F.col("position"), 1, [*inner, engine.CONFIG])}
    if "benchmark_close" in panel.columns:
        earlier["benchmark_before_"] = frames.back(F.col("benchmark_close"), 1, [*inner, engine.CONFIG])
    out = chunks.returned(held.withColumns(earlier))
    if any(c.use_drawdown_guard for c in configs):
        out = exposure.guarded_by_chunks(out, run)
    out = costs.decomposed(out.drop("guard_level").withColumn("turnover_", F.coalesce(F.abs(F.col("position") - F.col("before_")), F.lit(0.0))))
    out = engine.earned(out)
    scans = {f"{name}_equity": (F.product, 1 + F.col(f"{name}_return"), chunks.times) for name in ("strategy", "gross", "baseline")}
    if "benchmark_close" in panel.columns:
        last = lambda c: (lambda x: F.last(x, ignorenulls=True), F.col(c), lambda a, b: b, F.max_by(c, F.when(F.col(c).isNotNull(), F.col(chunks.AT))))
        out = chunks.scanned(out, run, {"known_": last("benchmark_close"), "knew_": last("benchmark_before_")})
        out = out.withColumn("benchmark_return", F.coalesce(frames.ratio(F.col("known_"), F.col("knew_")) - 1, F.lit(0.0)))
        scans["benchmark_equity"] = (F.product, 1 + F.col("benchmark_return"), chunks.times)
    out = chunks.scanned(out, run, scans)
    return out.drop("before_", "benchmark_before_", "known_", "knew_", chunks.AT, chunks.CHUNK, *(c for c in placed.columns if c.startswith("_thr_")))
