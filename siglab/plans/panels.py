"""Whole research runs over panels of many series: every table that a run reports, with the series as its key.

:func:`workflow.run_pipeline` tells of one series on the driver; here the same steps are plans over all series, so nothing
but their tables' sizes depends on how many there are. Each series gets the candidate that did best on its own early
part. Series too short for folds are in all tables but the folds'.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglab.config import StrategyConfig, candidates
from siglab.functions import frames
from siglab.operators import attribution, features, robustness, scorecard
from siglab.plans import engine, sweep
from siglab.sources import gates

TRAIN, TEST = 250, 125


def selection(panel: DataFrame, configs: Sequence[StrategyConfig] | None = None, train_fraction: float = 0.7, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """keys, config_id, and the Sharpe ratios, return and drawdown of the candidate of best Sharpe ratio on each series'
    early part, there (train_) and on the rest (test_)."""
    configs = candidates() if configs is None else list(configs)
    figures = ("sharpe_ratio", "total_return", "max_drawdown")
    halves = sweep.segment_kpis(engine.bars(panel, configs, keys, components=False), train_fraction, keys)
    at = lambda c, part: F.max(F.when(F.col("segment") == part, F.col(c))).alias(f"{part}_{c}" if (c, part) != ("sharpe_ratio", "train") else "sharpe_ratio")
    wide = halves.groupBy(*keys, engine.CONFIG).agg(*(at(c, part) for part in ("train", "test") for c in figures))
    return sweep.best(wide, keys).withColumnRenamed("sharpe_ratio", "train_sharpe_ratio")


def research(panel: DataFrame, configs: Sequence[StrategyConfig] | None = None, train_fraction: float = 0.7, sizes: tuple[int, int] = (TRAIN, TEST), simulations: int = 1000, seed: int = 123) -> dict[str, DataFrame]:
    """Tables by name, all keyed by series: bars, selection, sweep, kpis, segments, overfit, walk_forward, bootstrap,
    regimes, cost_sensitivity, stress, robustness, features, notes. Lazy; what several of them read, the bars of the chosen
    candidates, is computed by each unless the caller stores ``bars`` and the panel first."""
    configs = candidates() if configs is None else list(configs)
    keys = list(frames.KEYS)
    own = [*keys, engine.CONFIG]
    chosen = selection(panel, configs, train_fraction)
    run = engine.bars(panel, configs, components=False).join(chosen.select(*own), own, "left_semi")
    halves = sweep.segment_kpis(run, train_fraction)
    folds = sweep.walk_forward(panel, configs, *sizes, check=False)
    ladder = attribution.cost_ladder(run)
    held = run.select(*own).distinct().join(folds, keys)
    named = sweep.config_table(panel, configs)
    return {
        "bars": run, "selection": chosen.join(F.broadcast(named.select(engine.CONFIG, "label", "signal_family")), engine.CONFIG), "sweep": sweep.config_sweep(panel, configs), "kpis": scorecard.kpis(run, own, extended=True),
        "segments": halves, "overfit": robustness.overfit_gap(halves, own), "walk_forward": folds, "bootstrap": robustness.bootstrap_summary(robustness.bootstrap_paths(run, simulations, seed)), "regimes": attribution.by_regime(run),
        "cost_sensitivity": ladder, "stress": attribution.stress(run), "robustness": robustness.robustness_points(halves.filter("segment = 'test'"), held, ladder, own), "features": features.feature_frame(panel), "notes": gates.notes(panel),
    }


def write(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> dict[str, str]:
    """Each table as Parquet below ``path``; the places by name."""
    places = {name: f"{path.rstrip('/')}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode(mode).parquet(places[name])
    return places
