"""CSV text with rejects, calendars, window checks; sessions and the backtest as streams; the seeded bootstrap in parallel."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siglab.config import StrategyConfig
from siglab.operators import robustness
from siglab.plans import engine
from siglab.sources import gates, rejects, walks
from siglab.streaming import backtest, sessions


def test_every_line_is_told_once_with_its_reason(spark, tmp_path):
    text = {
        "a,2021-01-04,10.5": None, "a,2021-01-05T09:30:00,11": None, " b , 2021-01-04 , 7 ": None, 'c,2021-01-04,"8"': None, "a,2021-01-04,10.6": "repeated", "a,2021-01-06": "fields", "a,2021-01-06,1,2": "fields", ",2021-01-06,1": "series",
        "  ,2021-01-06,1": "series", "a,someday,1": "date", "a,,1": "date", "a,2021-02-30,1": "date", "a,2021-01-07,": "close missing", "a,2021-01-07,ten": "close missing", "a,2021-01-07,NaN": "close missing", "a,2021-01-07,Infinity": "close missing",
        "a,2021-01-08,0": "close not positive", "a,2021-01-08,-3": "close not positive", "x": "fields",
    }
    (tmp_path / "1.csv").write_text("\n".join(["series_id,ts,close", *list(text)[:9]]))
    (tmp_path / "2.csv").write_text("\n".join(["series_id,ts,close", *list(text)[9:]]))
    found = rejects.sorted_out(rejects.lines(spark, str(tmp_path)), header=True).cache()
    assert {r.line: r.reason for r in found.collect()} == text and found.count() == len(text)
    assert {r for r in text.values() if r} == set(rejects.REASONS)
    good = {(r.series_id, r.ts, r.close) for r in rejects.panel(found).collect()}
    day = dt.datetime(2021, 1, 4)
    assert good == {("a", day, 10.5), ("a", dt.datetime(2021, 1, 5, 9, 30), 11.0), ("b", day, 7.0), ("c", day, 8.0)}
    assert rejects.rejected(found).columns == ["line", "reason"]
    odd = spark.createDataFrame([(None,), ("",)], "line string")
    assert {r.reason for r in rejects.sorted_out(odd).collect()} == {"fields"} and rejects.sorted_out(odd.limit(0)).count() == 0


def test_columns_in_another_order(spark):
    lines = spark.createDataFrame([("5,x,2021-01-04,a",)], "line string")
    row = rejects.sorted_out(lines, ("close", "note", "ts", "series_id")).first()
    assert (row.series_id, row.close, row.reason) == ("a", 5.0, None)


def test_calendar_has_the_days_without_rows(spark):
    rows = spark.createDataFrame([("2021-01-01",), ("2021-01-01",), ("2021-01-02",), ("2021-01-06",), (None,)], "d string")
    got = [(r.ts.isoformat(), r.n_rows) for r in walks.calendar(rows, "d").orderBy("ts").collect()]
    assert got == [("2021-01-01", 2), ("2021-01-04", 0), ("2021-01-05", 0), ("2021-01-06", 1)]
    assert walks.calendar(rows.limit(0), "d").count() == 0


def test_window_checks_by_series(short):
    got = {(r.short_window, r.long_window): r.verdict for r in gates.window_checks(short, [(0, 5), (5, 5), (5, 298), (5, 299)]).collect()}
    assert got == {(0, 5): "not positive", (5, 5): "not less", (5, 298): "usable", (5, 299): "too short"}


# Sessions


def events(spark, told):
    return spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), float(v)) for u, m, v in told], "user_id long, ts timestamp, value double")


def plain_sessions(told, gap):
    out = []
    for user in sorted({u for u, *_ in told}):
        for m, v in sorted((m, v) for u, m, v in told if u == user):
            if out and out[-1][0] == user and m - out[-1][2] <= gap:
                out[-1] = (user, out[-1][1], m, out[-1][3] + 1, out[-1][4] + v)
            else:
                out.append((user, m, m, 1, v))
    return sorted((u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=a), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=b + gap), n, t) for u, a, b, n, t in out)


def test_sessions_equal_islands(spark):
    rng = np.random.default_rng(0)
    told = [(int(rng.integers(4)), int(rng.integers(600)), 1) for _ in range(150)]
    got = sorted(map(tuple, sessions.sessions(events(spark, told), 20 * 60).collect()))
    assert got == plain_sessions(told, 20)


def test_streamed_sessions_and_late_events(spark, tmp_path):
    """Four micro-batches: sessions go on across them, one of an earlier time is late, and a repeated batch changes nothing."""
    batches = [[(1, 0, 1), (1, 10, 1), (2, 5, 1)], [(1, 25, 1), (2, 50, 1), (3, 58, 1)], [(1, 200, 1), (2, 140, 1)], [(3, 20, 1), (1, 260, 1), (2, 150, 1)]]
    source = tmp_path / "in"
    job = sessions.Sessions(spark, str(tmp_path / "out"), gap=20 * 60, delay=60 * 60)
    for i, told in enumerate(batches):
        events(spark, told).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(source))
        job.start(stream, str(tmp_path / "state")).awaitTermination(120)
        if i == 2:
            job.take(events(spark, told), 2)  # as after a failure
    late = {(1, 20, 1), (2, 20, 1), (3, 20, 1)} & {x for b in batches for x in b}
    assert sorted((r.user_id, r.ts) for r in job.table("late").collect()) == sorted((u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for u, m, _ in late)
    on_time = [x for b in batches for x in b if x not in late]
    every = sorted(map(tuple, job.table("done").unionByName(spark.read.parquet(job._at("open", 3))).collect()))
    assert every == plain_sessions(on_time, 20)
    mark = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=260 - 60)
    assert all(r.ended < mark for r in job.table("done").collect()) and job.table("done").count() >= 4


# The backtest as a stream


CONFIGS = [
    StrategyConfig(10, 40),
    StrategyConfig(signal_family="momentum", momentum_window=20, use_drawdown_guard=True, drawdown_guard_level=0.05),
    StrategyConfig(signal_family="mean_reversion", zscore_window=20, sizing_method="capped_exposure", fixed_fraction=1.5, max_exposure=0.8),
    StrategyConfig(signal_family="composite", sizing_method="volatility_target", max_exposure=1.5, use_risk_controls=True, vol_cap=0.15, fee=0.0005, spread=0.0002),
]


@pytest.mark.parametrize("c", CONFIGS, ids=lambda c: c.label)
def test_advancing_bar_by_bar_equals_the_batch(spark, short, c):
    """The state passed on after any number of bars gives what the window plan gives for the whole series."""
    want = engine.bars(short, c, components=False).orderBy("ts").toPandas()
    state, told, at, rng = backtest._FRESH, [], 0, np.random.default_rng(3)
    reads = max(c.warmup, c.short_window, c.vol_lookback, 20) + 2
    while at < len(want):
        part = want.iloc[at : at + int(rng.integers(1, 40))]
        state, figures = backtest.advance(state, list(part.ts), part.close.to_numpy(), c, reads)
        told.append(pd.DataFrame(figures))
        at += len(part)
    got = pd.concat(told, ignore_index=True)
    for name in backtest.FIGURES:
        assert np.allclose(got[name].to_numpy(float), want[{"turnover": "turnover_"}.get(name, name)].to_numpy(float), equal_nan=True, atol=1e-11), name


def test_stream_equals_batch_over_events(spark, tmp_path):
    """Hourly bars of the events' panel, in four files by time, with two bars that come again too late."""
    c = StrategyConfig(signal_family="composite", sizing_method="volatility_target", max_exposure=1.5, use_drawdown_guard=True, drawdown_guard_level=0.10, fee=0.0005, spread=0.0002)
    panel = walks.event_panel(spark.read.parquet("/root/testdata/sf0.01/events.parquet")).cache()
    cuts = [x.isoformat(sep=" ") for x in pd.Series([r.ts for r in panel.select("ts").distinct().collect()]).quantile([0.25, 0.5, 0.75])]
    lots = [panel.filter(F.col("ts") < cuts[0]), *(panel.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, cuts[1:])), panel.filter(F.col("ts") >= cuts[-1])]
    lots[2] = lots[2].unionByName(lots[0].orderBy("ts", "series_id").limit(2).withColumn("close", F.lit(1.0)))
    for i, lot in enumerate(lots):
        lot.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = backtest.backtest(spark.readStream.schema(panel.schema).parquet(str(tmp_path / "in")), c)
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    late = out[out.late]
    assert len(late) == 2 and (late.close == 1.0).all() and late.strategy_equity.isna().all()
    keys = ["series_id", "ts"]
    got, want = out[~out.late].sort_values(keys, ignore_index=True), engine.bars(panel, c, components=False).toPandas().sort_values(keys, ignore_index=True)
    assert len(got) == len(want) > 3000
    for name in ("position", "cost", "strategy_return", "strategy_equity", "gross_equity", "baseline_equity"):
        assert np.allclose(got[name], want[name], atol=1e-9), name


def test_a_stream_refuses_what_needs_the_whole_past(short):
    with pytest.raises(ValueError, match="whole past"):
        backtest.backtest(short, StrategyConfig(use_volatility_filter=True))


# The seeded bootstrap


@pytest.mark.parametrize("block", [1 << 20, 997])
def test_seeded_paths_equal_the_generator(spark, short, walk, monkeypatch, block):
    monkeypatch.setattr(robustness, "NUMBERS_A_BLOCK", block)
    simulations = 1000 if block > 1000 else 50
    bars = engine.bars(short.unionByName(walk.withColumn("series_id", F.lit("long"))).unionByName(walk.limit(1).withColumn("series_id", F.lit("one"))), StrategyConfig(), components=False).cache()
    got = robustness.seeded_paths(bars, simulations).toPandas()
    for series, part in got.groupby("series_id"):
        r = bars.filter(F.col("series_id") == series).orderBy("ts").toPandas().strategy_return
        want = robustness.bootstrap_seeded(r, simulations)
        part = part.sort_values("sim_id")
        assert np.array_equal(part.total_return, want["total_returns"]) and np.array_equal(part.max_drawdown, want["max_drawdowns"]), series
    assert len(got) == 3 * simulations


def test_rejected_numbers_are_counted():
    """With a length near 2^32 about half of the numbers are rejected: the draws are still the generator's."""
    for n in (2**31 + 12345, 3_000_000_001, 1, 7):
        rows, good = robustness._taken(robustness._numbers(5, 0, 4000), n)
        want = np.random.default_rng(5).integers(0, n, good.sum())
        assert np.array_equal(rows[good][: len(want)], want) or n == 1
    assert (~good).sum() == 0
    parts = np.concatenate([robustness._numbers(9, a, b - a) for a, b in ((0, 7), (7, 8), (8, 31), (31, 100))])
    assert np.array_equal(parts, robustness._numbers(9, 0, 100))
