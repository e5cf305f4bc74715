import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siglab.config import StrategyConfig, candidates, check_windows, execution_cost, from_row, grid, resolve_execution
from siglab.errors import ValidationError
from siglab.functions import running
from siglab.operators import attribution, exposure, families, features, robustness, scorecard
from siglab.plans import engine, sweep
from siglab.sources import walks

# Published results of the default run (label: total return, Sharpe ratio, drawdown, active days, trades).
GOLDEN = {
    "meanrev 40/1.5": (0.120119, 0.514661, -0.082543, 119, 68), "meanrev 40/1": (0.118335, 0.40298, -0.116467, 230, 88), "meanrev 20/1.5": (0.003022, 0.052025, -0.11012, 119, 82),
    "trend 30/90": (-0.091525, -0.222876, -0.187745, 257, 10), "momentum 120": (-0.183888, -0.621687, -0.210162, 226, 24), "composite 20/60 +volfilter": (-0.221393, -0.847782, -0.224634, 191, 32),
    "composite 20/60": (-0.273524, -0.961006, -0.276548, 248, 28), "momentum 20": (-0.313618, -1.000729, -0.364567, 295, 81), "trend 10/40": (-0.330819, -1.121925, -0.362699, 272, 24),
}
REVERSION = StrategyConfig(signal_family="mean_reversion", zscore_window=40)


@pytest.fixture(scope="module")
def run(walk):
    return engine.bars(walk, REVERSION).cache()


def test_sweep_golden(walk):
    out = sweep.config_sweep(walk, candidates()).toPandas()
    assert len(out) == 13 and out.sharpe_ratio.is_monotonic_decreasing
    for label, want in GOLDEN.items():
        got = out[out.label == label].iloc[0]
        assert np.allclose([got.total_return, got.sharpe_ratio, got.max_drawdown, got.active_days, got.trade_count], want, atol=1.1e-6)
    assert np.allclose(out.baseline_return, -0.230318, atol=1e-6) and np.allclose(out.excess_return, out.total_return - out.baseline_return)


def test_walk_forward_golden(walk):
    out = sweep.walk_forward(walk).toPandas()
    assert out.label.tolist() == ["meanrev 40/1.5", "meanrev 20/1.5", "composite 20/60 +volfilter", "meanrev 40/1.5"]
    assert np.allclose(out.test_sharpe, [0.863459, -0.992671, -1.088014, 0.762132], atol=1.1e-6)
    assert out.train_start.tolist()[0] == "2021-01-01" and out.test_end.tolist()[-1] == "2023-11-16"
    with pytest.raises(ValueError, match="Need at least"):
        sweep.walk_forward(walk, train_size=700, test_size=100)
    with pytest.raises(ValidationError, match="Insufficient rows"):
        sweep.walk_forward(walk, train_size=100, test_size=50)


def test_folds_hold_whole_windows_only(spark):
    out = sweep.folds(walks.seeded(spark, 800, 5), 250, 125).groupBy("fold", "part").count().toPandas()
    assert sorted(out["count"].tolist()) == [125] * 4 + [250] * 4


def test_ladder_stress_and_regimes_golden(run):
    ladder = attribution.cost_ladder(run).toPandas()
    assert np.allclose(ladder.total_return, [0.221372, 0.168731, 0.118335, -0.020317, -0.214616], atol=1.1e-6)
    assert attribution.cost_ladder(run, structured=True).toPandas().total_return.nunique() == 1
    stress = attribution.stress(run).toPandas().set_index("scenario").total_return
    assert np.allclose(stress[["higher_costs", "volatility_shock", "adverse_drift", "amplified_downside"]], [-0.214616, 0.094603, -0.231416, -0.356553], atol=1.1e-6)
    regimes = attribution.by_regime(run).toPandas()
    assert regimes.regime.tolist() == list(features.REGIMES) and regimes.n_days.tolist() == [228, 227, 166, 69] and np.allclose(regimes.total_return, [0.009417, -0.067929, 0.038361, 0.144732], atol=1.1e-6)


def test_identities_of_bars(run):
    b = run.orderBy("ts").toPandas()
    assert b.position.iloc[0] == 0 and np.allclose(b.net_return, b.gross_return - b.cost) and np.allclose(b.cost, b.fee_cost + b.spread_cost + b.slippage_cost)
    assert np.allclose(b.strategy_equity, (1 + b.strategy_return).cumprod()) and np.allclose(b.position.iloc[1:], b.exposure.fillna(0).iloc[:-1])


def test_features_are_causal(short):
    whole = features.feature_frame(short).drop("vol_regime").orderBy("ts").limit(200).toPandas()
    early = features.feature_frame(short.orderBy("ts").limit(200)).drop("vol_regime").orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(whole, early)
    assert len(features.feature_frame(short).columns) == 23


def test_a_panel_equals_its_series(spark, walk, short):
    both = walk.union(short.withColumn("series_id", F.lit("other")))
    configs = [StrategyConfig(), StrategyConfig(signal_family="composite", use_volatility_filter=True)]
    key = ["config_id", "total_return", "sharpe_ratio", "max_drawdown"]
    whole = sweep.config_sweep(both, configs).toPandas()
    for name, one in (("synthetic", walk), ("other", short)):
        alone = sweep.config_sweep(one, configs).toPandas()
        pd.testing.assert_frame_equal(whole[whole.series_id == name][key].reset_index(drop=True), alone[key])


def test_composite_averages_what_is_known_and_filter_only_removes(walk):
    c = StrategyConfig(signal_family="composite")
    plain = families.signal_frame(walk, c).orderBy("ts").toPandas()
    assert (plain.target_position > 0).sum() >= 248 and plain.target_position.isna().sum() > 0
    kept = families.signal_frame(walk, StrategyConfig(signal_family="composite", use_volatility_filter=True)).orderBy("ts").toPandas()
    assert (kept.target_position.fillna(0) <= plain.target_position.fillna(0)).all() and (kept.risk_on.iloc[:119] == 1).all()


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.0, 0.05, 0.1]))
def test_guard_equals_the_loop(spark, seed, level):
    rng = np.random.default_rng(seed)
    p, m = rng.integers(0, 2, 90).astype(float), rng.normal(0, 0.03, 90)
    rows = spark.createDataFrame([("a", i, float(x), float(y), level) for i, (x, y) in enumerate(zip(p, m))], "series_id string, ts int, position double, market_return double, guard_level double")
    got = exposure.guarded(rows, ["series_id"]).orderBy("ts").toPandas().position.to_numpy()
    want, equity, peak, off = [], 1.0, 1.0, False
    for x, y in zip(p, m):
        x = 0.0 if off else x
        want.append(x)
        equity *= 1 + x * y
        peak = max(peak, equity)
        off = off or equity / peak - 1 <= -level
    assert got.tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.just(math.nan), st.floats(-5, 5), st.sampled_from([0.0, 1.0])), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.8, 1.0]), st.integers(0, 5))
def test_running_quantile(values, q, least):
    got = running.expanding(np.array(values), q, least)
    for i in range(len(values)):
        seen = [x for x in values[: i + 1] if not math.isnan(x)]
        assert math.isnan(got[i]) if len(seen) < max(least, 1) else got[i] == pytest.approx(np.quantile(seen, q), abs=1e-12)


def test_sizing_and_caps(walk):
    wide = lambda **x: engine.bars(walk, StrategyConfig(**x)).orderBy("ts").toPandas()
    base, part = wide(), wide(sizing_method="fixed_fraction", fixed_fraction=0.4)
    assert np.allclose(part.exposure.dropna(), base.exposure.dropna() * 0.4)
    assert wide(sizing_method="capped_exposure", fixed_fraction=2.0, max_exposure=0.5).exposure.max() == 0.5
    vt = wide(sizing_method="volatility_target", max_exposure=3.0)
    assert vt.exposure.max() <= 3.0 and vt.exposure.nunique() > 10
    assert (wide(use_risk_controls=True, vol_cap=0.1).exposure.fillna(0) <= base.exposure.fillna(0) + 1e-12).all()
    assert engine.bars(walk, StrategyConfig(use_drawdown_guard=True, drawdown_guard_level=0.01)).filter("position > 0").count() < (base.position > 0).sum()


def test_slices_begin_anew(run):
    halves = sweep.segment_kpis(run).toPandas().set_index("segment")
    b = run.orderBy("ts").toPandas()
    late = b.iloc[525:]
    assert np.isclose(halves.loc["test", "total_return"], (1 + late.strategy_return).prod() - 1)
    assert halves.loc["test", "trade_count"] == (late.position.diff().abs().fillna(0) > 0).sum()
    gap = robustness.overfit_gap(sweep.segment_kpis(run), ["series_id", "config_id"]).first()
    assert np.isclose(gap.gap, halves.loc["train", "sharpe_ratio"] - halves.loc["test", "sharpe_ratio"])
    a, z = sweep.split(run, 0.7)
    assert a.count() == 525 and z.count() == 225
    with pytest.raises(ValueError, match="between 0 and 1"):
        sweep.split(run, 1.0)


def test_extended_figures(run):
    b = run.orderBy("ts").toPandas()
    got = scorecard.kpis(run, ["series_id", "config_id"], extended=True).first()
    r = b.strategy_return
    rolling = (r.rolling(63).mean() * 252 / (r.rolling(63).std(ddof=0) * np.sqrt(252))).replace([np.inf, -np.inf], np.nan).dropna()
    assert np.isclose(got.rolling_sharpe_median, rolling.median()) and np.isclose(got.win_rate, (r > 0).mean()) and np.isclose(got.cost_drag, b.gross_equity.iloc[-1] - b.strategy_equity.iloc[-1])
    assert got.benchmark_return is None and got.exposure_max == 1.0


def test_benchmark_is_carried_forward(spark, short):
    other = short.withColumn("benchmark_close", F.when(F.dayofmonth("ts") % 2 == 0, F.col("close")))
    b = engine.bars(other, StrategyConfig()).orderBy("ts").toPandas()
    want = b.benchmark_close.ffill().pct_change().fillna(0)
    assert np.allclose(b.benchmark_return, want) and np.allclose(b.benchmark_equity, (1 + want).cumprod())


def test_bootstrap(run):
    paths = robustness.bootstrap_paths(run, 20).toPandas()
    again = robustness.bootstrap_paths(run, 20).toPandas()
    assert len(paths) == 20 and np.allclose(sorted(paths.total_return), sorted(again.total_return)) and (paths.max_drawdown <= 0).all()
    seeded = robustness.bootstrap_seeded(run.orderBy("ts").toPandas().strategy_return, 200)
    assert seeded["p5_total_return"] <= seeded["median_total_return"] <= seeded["p95_total_return"] and 0 <= seeded["probability_of_loss"] <= 1
    with pytest.raises(ValueError):
        robustness.bootstrap_seeded([])


def test_robustness_score():
    out = robustness.robustness_score({"sharpe_ratio": 0.75, "max_drawdown": -0.1}, 0.5, [0.2, 0.1, 0.05])
    assert out == {"score": 64.5, "oos_sharpe_points": 20.0, "stability_points": 12.5, "drawdown_points": 12.0, "cost_points": 20.0}
    assert robustness.robustness_score({"sharpe_ratio": -1, "max_drawdown": -0.9}, None, None)["score"] == 0.0


@pytest.mark.parametrize(
    ("change", "said"),
    [({"signal_family": "x"}, "signal_family"), ({"short_window": 60}, "strictly"), ({"short_window": 0}, "positive"), ({"sizing_method": "x"}, "sizing_method"), ({"max_exposure": 0}, "max_exposure"), ({"signal_family": "mean_reversion", "zscore_entry": 0.0}, "zscore_entry"), ({"sizing_method": "volatility_target", "target_volatility": 0}, "target_volatility")],
)
def test_config_checks(change, said):
    with pytest.raises(ValidationError, match=said):
        StrategyConfig(**change).check()


def test_config_helpers(walk):
    with pytest.raises(ValidationError, match="integers"):
        check_windows(1.5, 3)
    assert StrategyConfig(use_volatility_filter=True).warmup == 120 and StrategyConfig(fee=0.1, spread=0.2).rates.total == pytest.approx(0.3)
    assert [c.label for c in candidates()][-1] == "composite 20/60 +volfilter" and len(grid((5, 10), (8, 20))) == 3
    with pytest.raises(ValueError, match="no valid scenarios"):
        grid((5,), (5,))
    row = {"signal_family": "momentum", "short_window": 20, "long_window": 60, "momentum_window": 5, "zscore_window": 20, "zscore_entry": 1.0, "cost_per_trade": 0.002, "use_volatility_filter": False}
    assert from_row(row) == StrategyConfig(signal_family="momentum", momentum_window=5, cost_per_trade=0.002)
    assert execution_cost("Generic low-cost broker") == 0.0005 and resolve_execution("?", 0.01)["is_custom"]
    with pytest.raises(KeyError):
        execution_cost("?")
    with pytest.raises(ValueError):
        execution_cost("Custom assumptions")
    with pytest.raises(ValidationError, match="Insufficient"):
        engine.bars(walk.limit(30), StrategyConfig(), check=True)
    with pytest.raises(ValueError):
        sweep.config_sweep(walk, [])


def test_one_exchange_serves_windows_sweep_and_scorecard(walk):
    from siglab.sources import walks as w

    base = w.seeded(walk.sparkSession, 200, 1)
    plan = scorecard.kpis(engine.bars(base, [StrategyConfig(), StrategyConfig(10, 40)], components=False), ["series_id", "config_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
