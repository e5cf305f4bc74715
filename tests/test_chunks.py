"""Long series by chunks: numbering, lent rows, scans, the guard, thresholds and exact quantiles, against whole windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siglab.config import StrategyConfig, candidates
from siglab.functions import chunks, running, selection
from siglab.operators import exposure, features
from siglab.plans import chunked, engine
from siglab.sources import walks


@pytest.fixture(scope="module")
def panel(spark):
    """Three series of differing lengths, one with a gap of two years in its days."""
    own = walks.seeded(spark, 330, 3).withColumn("series_id", F.lit("a")).unionByName(walks.seeded(spark, 700, 5).withColumn("series_id", F.lit("b"))).unionByName(walks.seeded(spark, 5, 6).withColumn("series_id", F.lit("c")))
    gap = F.when((F.col("series_id") == "b") & (F.col("ts") > "2022-06-01"), F.date_add("ts", 730)).otherwise(F.col("ts"))
    return own.withColumn("ts", gap.cast(own.schema["ts"].dataType)).withColumn("benchmark_close", F.when(F.dayofmonth("ts") % 3 == 0, F.col("close") * 1.02)).cache()


def frame(df, keys):
    out = df.toPandas()
    return out[sorted(out.columns)].sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("rows", [7, 64, 5000])
def test_numbers_follow_the_order(panel, rows):
    got = chunks.numbered(panel, ["series_id"], [F.asc("ts")], chunks.time_bucket(panel, rows=rows))
    want = panel.withColumn("at_", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1)
    assert frame(got, ["series_id", "ts"]).at_.tolist() == frame(want, ["series_id", "ts"]).at_.tolist()


@pytest.mark.parametrize(("rows", "lookback"), [(10, 0), (10, 3), (10, 25), (100, 99)])
def test_each_chunk_is_lent_the_rows_before_it(spark, rows, lookback):
    df = spark.createDataFrame([("a", i) for i in range(57)] + [("b", i) for i in range(3)], "series_id string, at_ long")
    got = chunks.lent(df, ["series_id"], lookback, rows).toPandas()
    for (s, c), part in got.groupby(["series_id", "chunk_"]):
        n = 57 if s == "a" else 3
        own, lent = sorted(part[~part.lent_].at_), sorted(part[part.lent_].at_)
        assert own == list(range(c * rows, min(n, (c + 1) * rows)))
        if own:
            assert lent == list(range(max(0, c * rows - lookback), c * rows))
    assert chunks.returned(chunks.lent(df, ["series_id"], lookback, rows)).count() == 60


def test_scans_equal_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, float(x) if x > -1 else None) for s in "ab" for i, x in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame(rows, "series_id string, at_ long, x double").withColumn("chunk_", F.floor(F.col("at_") / 8))
    known = (lambda x: F.last(x, ignorenulls=True), F.col("x"), lambda a, b: b, F.max_by("x", F.when(F.col("x").isNotNull(), F.col("at_"))))
    scans = {"s": (F.sum, F.col("x"), chunks.plus), "m": (F.max, F.col("x"), F.greatest), "p": (F.product, 1 + F.col("x"), chunks.times), "l": known}
    w = Window.partitionBy("series_id").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("x").over(w), "m": F.max("x").over(w), "p": F.product(1 + F.col("x")).over(w), "l": F.last("x", True).over(w)})
    pd.testing.assert_frame_equal(frame(chunks.scanned(df, ["series_id"], scans), ["series_id", "at_"]), frame(want, ["series_id", "at_"]), rtol=1e-12)


def test_keys_must_be_known(spark):
    df = spark.createDataFrame([(None, 1)], "series_id string, t long")
    with pytest.raises(Exception, match="null"):
        chunks.numbered(df, ["series_id"], [F.asc("t")], F.lit(0)).collect()


CONFIGS = [
    *candidates(),
    StrategyConfig(signal_family="momentum", momentum_window=20, use_drawdown_guard=True, drawdown_guard_level=0.05),
    StrategyConfig(signal_family="momentum", momentum_window=20, use_drawdown_guard=True, drawdown_guard_level=0.0),
    StrategyConfig(sizing_method="volatility_target", max_exposure=2.0, use_risk_controls=True, vol_cap=0.15, fee=0.001, spread=0.0005),
]


@pytest.mark.parametrize("rows", [31, 256])
def test_chunked_backtest_equals_the_window_plan(panel, rows):
    keys = ["series_id", "config_id", "ts"]
    want, got = frame(engine.bars(panel, CONFIGS, components=False), keys), frame(chunked.bars(panel, CONFIGS, components=False, rows=rows), keys)
    pd.testing.assert_frame_equal(got, want, rtol=1e-12, check_dtype=False)


def test_no_window_of_the_chunked_plan_is_over_a_whole_series(panel):
    """Windows over rows have the chunk among their keys; those over a series alone read totals, a row a chunk."""
    plan = chunked.bars(panel, CONFIGS[-1], rows=64)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and "chunk_" not in line.split("windowspecdefinition(")[1].split(", ts#")[0].split("ASC")[0] and "bucket_" not in line:
            assert any("HashAggregate" in x for x in lines[i + 1 : i + 8]), line


@pytest.mark.parametrize("rows", [1, 4, 9])
def test_guard_by_chunks_equals_the_loop(spark, rows):
    rng, told = np.random.default_rng(rows), []
    for s in range(120):
        level = float(rng.choice([0.0, 0.05, 0.1, 0.3, 1.0]))
        moves = rng.choice([-0.2, -0.06, -0.05, -0.01, 0.0, 0.01, 0.05, 0.2], rng.integers(1, 40))
        told += [(s, i, 1.0, float(m), 1.0 if i else None, level) for i, m in enumerate(moves)]
    df = spark.createDataFrame(told, "series_id long, at_ long, position double, market_return double, before_ double, guard_level double")
    got = frame(exposure.guarded_by_chunks(df.withColumn("chunk_", F.floor(F.col("at_") / rows)), ["series_id"]), ["series_id", "at_"])
    for s, part in got.groupby("series_id"):
        equity, peak, off, want = 1.0, 1.0, False, []
        for m, level in zip(part.market_return, part.guard_level):
            want.append(0.0 if off else 1.0)
            equity *= 1 + want[-1] * m
            peak = max(peak, equity)
            # Equity that stands at the level to the last bit may be told either way by products in another order.
            off = off or equity / peak - 1 < -level + 1e-13
        assert part.position.tolist() == want and part.before_.tolist()[1:] == want[:-1]


def test_long_thresholds_equal_running_ones(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=2500), 1)
    x[rng.random(2500) < 0.1] = np.nan
    parts = {"a": x, "b": rng.normal(size=1800), "c": np.repeat([1.0, 2.0], 90), "d": np.full(40, np.nan)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "at_": np.arange(len(v)), "v": v}) for k, v in parts.items()])).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    for q in (0.0, 0.8):
        got = running.long_thresholds(df, "v", q, 60, ["series_id"], rows=200, lookups=150).toPandas().set_index(["series_id", "at_"]).threshold_
        whole = frame(running.with_quantile(df, "v", q, 60, "q", ["series_id"], by="at_"), ["series_id", "at_"])
        for s, v in parts.items():
            want = running.expanding(v, q, 60)
            assert np.allclose(whole[whole.series_id == s].q.to_numpy(float), want, equal_nan=True, atol=1e-12)
            assert np.allclose([got.get((s, i), np.nan) for i in range(len(v))], want, equal_nan=True, atol=1e-12)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_equal_percentiles(spark, accuracy):
    rng = np.random.default_rng(7)
    values = {"a": rng.normal(size=5000), "b": np.round(rng.normal(size=3000), 1), "c": [1.0], "d": [None, float("nan")], None: rng.random(400)}
    df = spark.createDataFrame([(k, float(x) if x is not None else None) for k, v in values.items() for x in v], "series_id string, v double")
    p = [0.0, 0.05, 0.33, 0.5, 0.9, 1.0]
    got = {r.series_id: r.quantiles for r in selection.exact_quantiles(df, "v", p, ["series_id"], accuracy=accuracy).collect()}
    assert set(got) == set(values) and got["d"] == [None] * len(p)
    for k in ("a", "b", "c", None):
        assert np.allclose(got[k], np.quantile(np.array(values[k], float), p), atol=1e-12)


def test_regimes_use_them(panel):
    got = frame(features.with_regimes(panel), ["series_id", "ts"])
    for _, part in got.groupby("series_id"):
        vol = part.regime_vol.dropna()
        if len(vol):
            low, high = np.quantile(vol, 0.33), np.quantile(vol, 0.90)
            assert (part[part.regime_vol <= low].vol_regime == "low").all() and (part[part.regime_vol > high].vol_regime == "stress").all()


def test_one_long_series_is_the_work_of_many_tasks(spark):
    """60,000 bars of one series, by chunks of 4,096: every task of the last stage has a share, and figures equal a walk in numpy."""
    n = 60_000
    z = np.random.default_rng(12).standard_normal(n)
    close = 100 * np.exp(np.cumsum(0.004 * z))
    bars = spark.createDataFrame(pd.DataFrame({"series_id": "one", "ts": pd.date_range("2000-01-01", periods=n, freq="h"), "close": close}))
    c = StrategyConfig(signal_family="momentum", momentum_window=50, use_drawdown_guard=True, drawdown_guard_level=0.9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is put into one task again
    try:
        out = chunked.bars(bars, c, components=False, rows=4096).withColumn("task", F.spark_partition_id()).toPandas().sort_values("ts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shares = out.task.value_counts()
    assert len(out) == n and len(shares) >= 3 and shares.max() < 0.6 * n
    move = np.r_[0.0, close[1:] / close[:-1] - 1]
    target = np.r_[np.full(50, np.nan), (close[50:] / close[:-50] - 1 > 0).astype(float)]
    position = np.nan_to_num(np.r_[np.nan, target[:-1]])
    grown = np.cumprod(1 + position * move)
    hit = np.flatnonzero(grown / np.maximum(1, np.maximum.accumulate(grown)) - 1 <= -0.9)
    position[hit[0] + 1 if len(hit) else n :] = 0.0
    assert np.array_equal(out.position.to_numpy(), position)
    turnover = np.abs(np.diff(np.r_[position[0], position]))
    assert np.allclose(out.strategy_equity, np.cumprod(1 + position * move - turnover * c.rates.total), rtol=1e-9)
