"""Stored panels: the same results, without an exchange of their rows."""

import re

import pytest
from pyspark.sql import functions as F

from siglab.config import StrategyConfig, candidates, grid
from siglab.functions import frames
from siglab.operators import scorecard
from siglab.plans import engine, sweep
from siglab.sources import store, walks


@pytest.fixture(scope="module")
def stored(spark):
    panel = walks.scaled(spark, 7, 260).cache()
    yield panel, store.write(panel.filter(F.year("ts") < 2022), "test_panel_store", buckets=3)
    spark.sql("DROP TABLE IF EXISTS test_panel_store")


def test_rows_come_back_and_appends_are_not_doubled(spark, stored):
    panel, first = stored
    assert first.count() == panel.filter(F.year("ts") < 2022).count()
    whole = store.append(panel, "test_panel_store")
    assert whole.count() == panel.count() and whole.exceptAll(panel).count() == 0
    assert store.append(panel, "test_panel_store").count() == panel.count()


def test_a_sweep_over_a_stored_panel_exchanges_no_rows(spark, stored):
    panel, _ = stored
    held = store.read(spark, "test_panel_store")
    configs = grid((5, 10), (20, 40))
    run = scorecard.kpis(engine.bars(held, configs, components=False), [*frames.KEYS, engine.CONFIG])
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    # With the sweep's own order, only its result is exchanged; with the filter, besides, one array a series.
    swept = sweep.config_sweep(held, configs)._jdf.queryExecution().executedPlan().toString()
    assert swept.count("Exchange hashpartitioning") == 0 and swept.count("Exchange rangepartitioning") <= 1
    filtered = sweep.config_sweep(held, candidates())._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|Single)", filtered)) <= 1 and "Bucketed: true" in filtered


def test_results_are_those_of_the_plain_panel(spark, stored):
    panel, _ = stored
    held = store.read(spark, "test_panel_store")
    own = panel.join(held.select("series_id", "ts"), ["series_id", "ts"], "left_semi")
    c = StrategyConfig(signal_family="momentum", momentum_window=20)
    a, b = (engine.bars(x, c, components=False).select("series_id", "ts", F.round("strategy_equity", 9).alias("e")) for x in (held, own))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_buckets_follow_the_size(spark):
    assert store.buckets_for(walks.seeded(spark, 50)) == 1
    assert store.buckets_for(walks.scaled(spark, 40, 10), rows=50) == 8
