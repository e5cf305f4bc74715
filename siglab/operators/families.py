"""Signal families: each turns a configuration into a target column, 1 (long), 0 (flat) or null (warming up).

What the families read of the series is named by :class:`Shared` and computed once, whatever the number of
configurations that use it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglab import config
from siglab.config import StrategyConfig
from siglab.functions import frames, running


class Shared:
    """Columns over the series that configurations ask for, each once."""

    def __init__(self, keys: Sequence[str] = frames.KEYS):
        self.keys, self.first, self.second = keys, {}, {}

    def mean(self, w: int) -> Column:
        return self._own(self.first, f"_ma_{w}", lambda: frames.full(F.avg, F.col("close"), w, self.keys))

    def deviation(self, w: int) -> Column:
        return self._own(self.first, f"_sd_{w}", lambda: frames.full(F.stddev_pop, F.col("close"), w, self.keys))

    def momentum(self, w: int) -> Column:
        return self._own(self.first, f"_mom_{w}", lambda: frames.change(F.col("close"), w, self.keys))

    def volatility(self, w: int, of: str = "ret") -> Column:
        return self._own(self.first, f"_vol_{of}_{w}", lambda: frames.full(F.stddev_pop, F.col(of), w, self.keys))

    def threshold(self, w: int, q: float) -> Column:
        """The q-quantile of the volatilities so far, once there are w of them."""
        self.volatility(w)
        name = f"_thr_{w}_{str(q).replace('.', '_')}"
        self.second[name] = (f"_vol_ret_{w}", w, q)
        return F.col(name)

    def _own(self, at: dict, name: str, make: Callable[[], Column]) -> Column:
        at.setdefault(name, make)
        return F.col(name)

    def add(self, df: DataFrame) -> DataFrame:
        if self.first:
            df = df.withColumns({name: make() for name, make in self.first.items()})
        for name, (value, least, q) in self.second.items():
            df = self.with_threshold(df, value, q, least, name)
        return df

    def with_threshold(self, df: DataFrame, value: str, q: float, least: int, name: str) -> DataFrame:
        return running.with_quantile(df, value, q, least, name, self.keys)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).when(~c, 0.0)


def trend(c: StrategyConfig, s: Shared) -> dict[str, Column]:
    fast, slow = s.mean(c.short_window), s.mean(c.long_window)
    return {"fast_ma": fast, "slow_ma": slow, "target": _flag(fast > slow)}


def momentum(c: StrategyConfig, s: Shared) -> dict[str, Column]:
    m = s.momentum(c.momentum_window)
    return {"momentum": m, "target": _flag(m > 0)}


def mean_reversion(c: StrategyConfig, s: Shared) -> dict[str, Column]:
    z = frames.ratio(F.col("close") - s.mean(c.zscore_window), s.deviation(c.zscore_window))
    return {"zscore": z, "target": _flag(z < -c.zscore_entry)}


def composite(c: StrategyConfig, s: Shared) -> dict[str, Column]:
    """The mean of those of the three base targets that are known; long from one half up."""
    parts = {f"{name}_signal": f(c, s)["target"] for name, f in (("trend", trend), ("momentum", momentum), ("mean_reversion", mean_reversion))}
    known = sum((x.isNotNull().cast("int") for x in parts.values()), F.lit(0))
    score = frames.ratio(sum((F.coalesce(x, F.lit(0.0)) for x in parts.values()), F.lit(0.0)), known.cast("double"))
    return {**parts, "composite_score": score, "target": _flag(score >= 0.5)}


#: Families by name; :func:`register` adds one.
FAMILIES: dict[str, Callable[[StrategyConfig, Shared], dict[str, Column]]] = {"trend": trend, "momentum": momentum, "mean_reversion": mean_reversion, "composite": composite}


def register(name: str, make: Callable[[StrategyConfig, Shared], dict[str, Column]]) -> None:
    """Makes a family known to configurations and backtests: ``make`` gives, of a configuration and the shared columns,
    columns by name with ``target`` among them."""
    FAMILIES[name] = make
    config.KNOWN_FAMILIES.add(name)


def signal(c: StrategyConfig, s: Shared) -> dict[str, Column]:
    """The family's columns, with the volatility filter (``risk_on``) applied to ``target``."""
    out = dict(FAMILIES[c.signal_family](c, s))
    if c.use_volatility_filter:
        vol, bound = s.volatility(c.vol_filter_window), s.threshold(c.vol_filter_window, c.vol_filter_quantile)
        out["risk_on"] = F.when(bound.isNull(), 1.0).when(vol <= bound, 1.0).otherwise(0.0)
        out["target"] = out["target"] * out["risk_on"]
    return out


def signal_frame(panel: DataFrame, c: StrategyConfig, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """``panel`` with the columns of one configuration's family and ``target_position``, not lagged."""
    shared = Shared(keys)
    columns = signal(c.check(), shared)
    based = shared.add(panel.withColumn("ret", frames.change(F.col("close"), 1, keys)))
    target = columns.pop("target")
    return based.select(*panel.columns, *(v.alias(k) for k, v in columns.items()), target.alias("target_position"))
