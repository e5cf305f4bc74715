"""Sweeps over configurations, selection, slices in and out of sample, walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siglab.config import IDENTITY, StrategyConfig, candidates, grid
from siglab.errors import ValidationError
from siglab.functions import frames
from siglab.operators import scorecard
from siglab.plans import engine


def config_table(df: DataFrame, configs: Sequence[StrategyConfig]) -> DataFrame:
    """config_id and the identity columns of each configuration."""
    rows = [(i, *(getattr(c, k) for k in IDENTITY)) for i, c in enumerate(configs)]
    kinds = "config_id int, label string, signal_family string, short_window int, long_window int, momentum_window int, zscore_window int, zscore_entry double, use_volatility_filter boolean, cost_per_trade double"
    return df.sparkSession.createDataFrame(rows, kinds)


def config_sweep(panel: DataFrame, configs: Sequence[StrategyConfig], keys: Sequence[str] = frames.KEYS, check: bool = False) -> DataFrame:
    """Identity columns and figures of each series and configuration, best Sharpe ratio first, ties by order."""
    if not configs:
        raise ValueError("A sweep needs at least one configuration.")
    scored = scorecard.kpis(engine.bars(panel, configs, keys, components=False, check=check), [*keys, engine.CONFIG])
    named = scored.join(F.broadcast(config_table(panel, configs)), engine.CONFIG)  # as many rows as the caller listed
    return named.select(*keys, engine.CONFIG, *IDENTITY, *scorecard.KPIS).orderBy(*keys, F.desc_nulls_last("sharpe_ratio"), engine.CONFIG)


def parameter_sweep(panel: DataFrame, shorts: Sequence[int], longs: Sequence[int], cost_per_trade: float = 0.001, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """The trend grid: windows, cost and figures."""
    out = config_sweep(panel, grid(shorts, longs, cost_per_trade), keys)
    return out.drop(*(c for c in IDENTITY if c not in ("short_window", "long_window", "cost_per_trade")))


def best(scored: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """The row of highest Sharpe ratio for each of ``keys``, ties to the first configuration."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("sharpe_ratio"), engine.CONFIG)
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def heatmap(scored: DataFrame, longs: Sequence[int], keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """Sharpe ratios by short window (rows) and long window (columns)."""
    return scored.groupBy(*keys, "short_window").pivot("long_window", list(longs)).agg(F.first("sharpe_ratio"))


def numbered(panel: DataFrame, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """``rn`` from 0 in time order, and ``n_rows`` of the series."""
    return panel.withColumn("rn", (F.row_number().over(frames.ordered(keys)) - 1).cast("int")).withColumn("n_rows", F.count("*").over(Window.partitionBy(*keys)))


def segments(df: DataFrame, train_fraction: float = 0.7, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """``segment``: 'train' for the first ``int(n * train_fraction)`` bars of each series, then 'test'."""
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must be strictly between 0 and 1.")
    rows = numbered(df, keys)
    cut = F.floor(F.col("n_rows") * F.lit(float(train_fraction)))
    return rows.withColumn("segment", F.when(F.col("rn") < cut, "train").otherwise("test")).drop("rn", "n_rows")


def split(panel: DataFrame, train_fraction: float = 0.7, keys: Sequence[str] = frames.KEYS) -> tuple[DataFrame, DataFrame]:
    """The early and the late part of each series; neither may be empty."""
    rows = segments(panel, train_fraction, keys)
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("segment") == "train").alias("a"), F.count_if(F.col("segment") == "test").alias("b")).agg(F.min("a"), F.min("b")).first()
    if not sizes[0] or not sizes[1]:
        raise ValueError("The split leaves one of its parts empty.")
    return tuple(rows.filter(F.col("segment") == x).drop("segment") for x in ("train", "test"))


def segment_kpis(bars: DataFrame, train_fraction: float = 0.7, keys: Sequence[str] = frames.KEYS, extended: bool = False) -> DataFrame:
    """Figures of the early and the late bars of runs over the whole series (what is early is causal, so it equals a run over that part)."""
    own = [*keys, engine.CONFIG]
    return scorecard.kpis(segments(bars, train_fraction, own), [*own, "segment"], extended)


def folds(panel: DataFrame, train_size: int, test_size: int, keys: Sequence[str] = frames.KEYS) -> DataFrame:
    """Each bar once for each fold that it lies in: ``fold``, and ``part`` ('train' or 'test')."""
    whole = train_size + test_size
    rows = numbered(panel, keys).withColumn("_last", F.floor((F.col("n_rows") - whole) / test_size)).filter(F.col("n_rows") >= whole)
    low = F.greatest(F.lit(0), F.ceil((F.col("rn") - (whole - 1)) / test_size)).cast("int")
    high = F.least(F.floor(F.col("rn") / test_size), F.col("_last")).cast("int")
    each = rows.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high").withColumn("fold", F.explode(F.sequence("_low", "_high")))
    return each.withColumn("part", F.when(F.col("rn") - F.col("fold") * test_size < train_size, "train").otherwise("test")).drop("rn", "n_rows", "_last", "_low", "_high")


def walk_forward(panel: DataFrame, configs: Sequence[StrategyConfig] | None = None, train_size: int = 250, test_size: int = 125, cost_per_trade: float = 0.001, keys: Sequence[str] = frames.KEYS, check: bool = True) -> DataFrame:
    """For each fold the configuration of best training Sharpe ratio, and how it did on the bars after.

    All folds and configurations run as one plan; positions are causal, so a run over a whole fold holds the
    training run as its beginning.
    """
    configs = candidates(cost_per_trade) if configs is None else list(configs)
    if check:
        shortest = panel.groupBy(*keys).count().agg(F.min("count")).first()[0] or 0
        if shortest < train_size + test_size:
            raise ValueError(f"Need at least train_size + test_size = {train_size + test_size} rows for walk-forward validation, got {shortest}.")
        need = max(c.warmup for c in configs) + 2
        if train_size < need:
            raise ValidationError(f"Insufficient rows: need at least {need}, got {train_size}.")
    own = [*keys, "fold"]
    split_ = folds(panel.select(*keys, "ts", "close"), train_size, test_size, keys)
    spans = split_.groupBy(*own).agg(F.min(F.when(F.col("part") == "train", F.col("ts"))).alias("_a"), F.max(F.when(F.col("part") == "train", F.col("ts"))).alias("_b"), F.max("ts").alias("_c"))
    scored = scorecard.kpis(engine.bars(split_, configs, own, components=False), [*own, engine.CONFIG, "part"])
    wide = scored.groupBy(*own, engine.CONFIG).agg(
        F.max(F.when(F.col("part") == "train", F.col("sharpe_ratio"))).alias("sharpe_ratio"),
        *(F.max(F.when(F.col("part") == "test", F.col(c))).alias(f"test_{d}") for c, d in (("sharpe_ratio", "sharpe"), ("total_return", "total_return"), ("baseline_return", "baseline_return"), ("max_drawdown", "max_drawdown"))),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    chosen = best(wide, own).join(F.broadcast(config_table(panel, configs).select(engine.CONFIG, "signal_family", "label")), engine.CONFIG).join(spans, own)
    return chosen.select(*own, day("_a").alias("train_start"), day("_b").alias("train_end"), day("_c").alias("test_end"), "signal_family", "label", F.col("sharpe_ratio").alias("train_sharpe"), "test_sharpe", "test_total_return", "test_baseline_return", "test_max_drawdown").orderBy(*own)
