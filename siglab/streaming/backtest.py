"""The backtest of a stream of bars: what :func:`engine.bars` computes, bar by bar as bars arrive, from a state by series.

The state holds as many closes as the longest window reads, the last exposure and position, equities and the guard's peak.
A micro-batch's new bars of a series are computed together from the state and give the next one. A bar at or before the
latest one of its series comes too late to change what was told: it is told as ``late``, without figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siglab.config import TRADING_DAYS, StrategyConfig
from siglab.operators import exposure

FIGURES = ("exposure", "position", "turnover", "cost", "gross_return", "strategy_return", "strategy_equity", "gross_equity", "baseline_equity")
_STATE = "latest timestamp, closes array<double>, exposure double, position double, strategy double, gross double, baseline double, grown double, peak double, struck boolean"
_FRESH = (None, [], None, None, 1.0, 1.0, 1.0, 1.0, 1.0, False)


def _rolling(x: np.ndarray, n: int, f) -> np.ndarray:
    """``f`` over the last n values, NaN where there are fewer or one is NaN."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def _flag(holds: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known, holds.astype(float), np.nan)


def targets(close: np.ndarray, c: StrategyConfig) -> np.ndarray:
    """The family's target of each bar, NaN while it warms up."""
    with np.errstate(invalid="ignore", divide="ignore"):
        def trend() -> np.ndarray:
            fast, slow = _rolling(close, c.short_window, np.mean), _rolling(close, c.long_window, np.mean)
            return _flag(fast > slow, ~np.isnan(fast) & ~np.isnan(slow))

        def momentum() -> np.ndarray:
            m = np.full(len(close), np.nan)
            m[c.momentum_window :] = close[c.momentum_window :] / close[: -c.momentum_window] - 1 if len(close) > c.momentum_window else []
            return _flag(m > 0, ~np.isnan(m))

        def reversion() -> np.ndarray:
            spread = _rolling(close, c.zscore_window, np.std)
            z = (close - _rolling(close, c.zscore_window, np.mean)) / np.where(spread == 0, np.nan, spread)
            return _flag(z < -c.zscore_entry, ~np.isnan(z))

        if c.signal_family != "composite":
            return {"trend": trend, "momentum": momentum, "mean_reversion": reversion}[c.signal_family]()
        parts = np.stack([trend(), momentum(), reversion()])
        known = (~np.isnan(parts)).sum(0)
        return _flag(np.nansum(parts, 0) / np.maximum(known, 1) >= 0.5, known > 0)


def _exposures(close: np.ndarray, moves: np.ndarray, c: StrategyConfig) -> np.ndarray:
    low, high = exposure.limits(c)
    x = targets(close, c)
    yearly = lambda n: _rolling(moves, n, np.std) * np.sqrt(TRADING_DAYS)
    with np.errstate(invalid="ignore", divide="ignore"):
        if c.sizing_method in ("fixed_fraction", "capped_exposure"):
            x = x * c.fixed_fraction
        elif c.sizing_method == "volatility_target":
            vol = yearly(c.vol_lookback)
            x = x * (c.target_volatility / np.where(vol == 0, np.nan, vol))
        x = np.clip(x, low, high)
        if c.use_risk_controls:
            vol = yearly(exposure.CAP_ROWS)
            x = np.clip(x * np.where(vol > 0, np.minimum(1.0, c.vol_cap / vol), 1.0), low, high)
    return x


def advance(state: tuple, ts: list, closes: np.ndarray, c: StrategyConfig, reads: int) -> tuple[tuple, dict[str, np.ndarray]]:
    """New bars, in order of time: the state after them, and their figures."""
    _, kept, last, held, strategy, gross, baseline, grown, peak, struck = state
    old = len(kept)
    every = np.concatenate([np.asarray(kept, float), closes])
    moves = np.zeros(len(every))
    moves[1:] = every[1:] / every[:-1] - 1
    # A series' first bar moves by 0; the first of a kept window is further back than any figure reads.
    x, move = _exposures(every, moves, c)[old:], moves[old:]
    position = np.nan_to_num(np.concatenate([[np.nan if last is None else last], x[:-1]]))
    if c.use_drawdown_guard:
        e = grown * np.cumprod(1 + position * move)
        p = np.maximum(peak, np.maximum.accumulate(e))
        hit = np.flatnonzero(e / p - 1 <= -abs(c.drawdown_guard_level))
        cut = 0 if struck else hit[0] + 1 if len(hit) else len(e)
        position = np.where(np.arange(len(e)) < cut, position, 0.0)
        grown, peak, struck = float(e[-1]), float(p[-1]), bool(struck or len(hit))
    turnover = np.abs(np.diff(np.concatenate([[position[0] if held is None else held], position])))
    cost = turnover * c.rates.total
    earned = position * move
    equities = {"strategy": strategy * np.cumprod(1 + earned - cost), "gross": gross * np.cumprod(1 + earned), "baseline": baseline * np.cumprod(1 + move)}
    figures = {"exposure": x, "position": position, "turnover": turnover, "cost": cost, "gross_return": earned, "strategy_return": earned - cost, **{f"{k}_equity": v for k, v in equities.items()}}
    after = (ts[-1], every[-reads:].tolist(), None if np.isnan(x[-1]) else float(x[-1]), float(position[-1]), *(float(v[-1]) for v in equities.values()), grown, peak, struck)
    return after, figures


def backtest(stream: DataFrame, c: StrategyConfig) -> DataFrame:
    """series_id, ts, close, late and :data:`FIGURES` of each bar of a stream (series_id, ts, close); appended as bars come.

    The volatility filter compares with all of a series' past, which no bounded state holds: it is refused.
    """
    if c.check().use_volatility_filter:
        raise ValueError("The volatility filter reads the whole past of a series; a stream's state doesn't hold it.")
    reads = max(c.warmup, c.short_window, c.vol_lookback, exposure.CAP_ROWS) + 2
    schema = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("close", T.DoubleType()), T.StructField("late", T.BooleanType()), *(T.StructField(f, T.DoubleType()) for f in FIGURES)])

    def run(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get if state.exists else _FRESH
        rows = pd.concat(list(frames)).sort_values(["ts", "close"], ignore_index=True)
        late = rows.ts.duplicated()
        if was[0] is not None:
            late |= rows.ts <= pd.Timestamp(was[0])
        out = rows[["series_id", "ts", "close"]].assign(late=late, **{f: np.nan for f in FIGURES})
        new = rows[~late]
        if len(new):
            after, figures = advance(tuple(was), [x.to_pydatetime() for x in new.ts], new.close.to_numpy(float), c, reads)
            for name, values in figures.items():
                out.loc[~late, name] = values
            state.update(after)
        yield out

    bars = stream.selectExpr("cast(series_id AS string) AS series_id", "cast(ts AS timestamp) AS ts", "cast(close AS double) AS close")
    return bars.groupBy("series_id").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
