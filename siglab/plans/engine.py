"""The backtest of many configurations over many series, as one plan with one exchange.

Windows over the series are emitted once each, before the rows are multiplied by the configurations; the windows
that depend on positions come after, partitioned by series and configuration, which the first exchange serves too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.config import StrategyConfig
from siglab.functions import frames
from siglab.operators import costs, exposure, families
from siglab.sources import gates

CONFIG = "config_id"


def returns(panel: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """``panel`` with ``ret`` (null at first) and ``market_return`` (0 at first)."""
    out = panel.withColumn("ret", frames.change(F.col("close"), 1, keys))
    return out.withColumn("market_return", F.coalesce("ret", F.lit(0.0)))


def exposures(panel: DataFrame, configs: Sequence[StrategyConfig], shared: families.Shared, components: bool = False) -> DataFrame:
    """A row for each bar and configuration with exposure, rates and guard level."""
    keys, each = shared.keys, []
    for i, c in enumerate(configs):
        c.check()
        columns = families.signal(c, shared)
        target = columns.pop("target")
        x = exposure.capped(exposure.sized(target, c, shared), c, shared)
        rates = c.rates
        told = {CONFIG: F.lit(i), "target_position": target, "exposure": x, "fee_rate": F.lit(float(rates.fee)), "spread_rate": F.lit(float(rates.spread)), "slippage_rate": F.lit(float(rates.slippage)), "guard_level": F.lit(float(c.drawdown_guard_level) if c.use_drawdown_guard else None).cast("double")}
        each.append(F.struct(*(v.alias(k) for k, v in (told | (columns if components else {})).items())))
    base = shared.add(returns(panel, keys))
    keep = [*panel.columns, "ret", "market_return"]
    wide = base.select(*keep, F.inline(F.array(*each)) if len(each) > 1 else each[0].alias("_one"))
    return wide if len(each) > 1 else wide.select(*keep, "_one.*")


def positions(panel: DataFrame, configs: Sequence[StrategyConfig], keys: Sequence[str] = frames.KEYS, components: bool = False) -> DataFrame:
    """A row for each bar and configuration with exposure, position (lagged, guarded) and rates."""
    own = [*keys, CONFIG]
    out = exposure.lagged(exposures(panel, configs, families.Shared(keys), components), own)
    if any(c.use_drawdown_guard for c in configs):
        out = exposure.guarded(out, own)
    return out.drop("guard_level")


def earned(df: DataFrame) -> DataFrame:
    """Gross, strategy, net and baseline returns of bars with positions and costs."""
    out = df.withColumn("gross_return", F.col("position") * F.col("market_return"))
    return out.withColumn("strategy_return", F.col("gross_return") - F.col("cost")).withColumn("net_return", F.col("strategy_return")).withColumn("baseline_return", F.col("market_return"))


def priced(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars with costs, returns and equities; ``keys`` name the run that a bar belongs to."""
    out = earned(costs.decomposed(costs.turned(df, keys)))
    out = out.withColumns({f"{name}_equity": frames.compounded(F.col(f"{name}_return"), keys) for name in ("strategy", "gross", "baseline")})
    if "benchmark_close" in df.columns:
        known = F.last("benchmark_close", ignorenulls=True).over(frames.upto(keys))
        out = out.withColumn("_known", known).withColumn("benchmark_return", F.coalesce(frames.change(F.col("_known"), 1, keys), F.lit(0.0))).drop("_known")
        out = out.withColumn("benchmark_equity", frames.compounded(F.col("benchmark_return"), keys))
    return out


def bars(panel: DataFrame, configs: Sequence[StrategyConfig] | StrategyConfig, keys: Sequence[str] = frames.KEYS, components: bool | None = None, check: bool = False) -> DataFrame:
    """The backtest of each configuration over each series, a row for each bar. One configuration: with its family's columns."""
    configs = [configs] if isinstance(configs, StrategyConfig) else list(configs)
    if not configs:
        raise ValueError("At least one configuration is needed.")
    for c in configs:
        c.check()
    if check:
        gates.validate(panel, max(c.warmup for c in configs) + 2)
    return priced(positions(panel, configs, keys, len(configs) == 1 if components is None else components), [*keys, CONFIG])
