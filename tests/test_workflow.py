import pytest

from siglab.config import ResearchParams
from siglab.operators import views
from siglab.plans import engine, workflow
from siglab.sources import walks


def test_pipeline_writes_everything(spark, tmp_path):
    r = workflow.run_pipeline(spark, str(tmp_path / "out"), n_days=400, simulations=50)
    assert len(r["sweep"]) == 13 and r["n_obs"] == 400 and r["train_size"] == 280 and len(r["walk_forward"]) == 1
    text = open(r["files"]["report"]).read()
    assert text.count("<h2>") == 10 and "<script" not in text and "http" not in text and "<svg" in text
    assert {"features", "regime_summary", "equity_curve", "monte_carlo", "sweep_heatmap"} <= set(r["files"])
    back = spark.read.csv(r["files"]["parameter_sweep_summary"], header=True)
    assert back.count() == 13 and back.columns[0] == "label"


def test_research_of_given_settings(spark):
    r = workflow.run_research(walks.seeded(spark, 320, 2), ResearchParams(signal_family="momentum", mc_simulations=50, fee=0.001))
    assert r["label"] == "momentum 40" and r["walk_forward"] is not None and 0 <= r["robustness"]["score"] <= 100
    assert r["cost_sensitivity"].total_return.nunique() == 1
    notes = workflow.analyst_notes(r)
    assert notes and all(set(x) == {"level", "text"} for x in notes)


def test_short_series_tell_why_there_are_no_folds(spark):
    r = workflow.run_research(walks.seeded(spark, 200, 2), ResearchParams(mc_simulations=20))
    assert r["walk_forward"] is None and "Insufficient rows" in r["walk_forward_message"]
    with pytest.raises(ValueError):
        workflow.run_research(walks.seeded(spark, 70, 2))


def test_views(short):
    run = engine.bars(short, workflow.StrategyConfig())
    assert views.benchmark(run) is None and views.trough(run).first().trough <= 0
    bins = views.histogram(run, "strategy_return").toPandas()
    assert bins.n.sum() == 300 and bins.bin.between(1, 40).all()
    assert views.formatted(0.1234, "pct") == "+12.3%" and views.formatted(0.0, "pct") == "0.0%" and views.formatted(7.0, "int") == "7"


def test_whole_runs_take_one_series(spark):
    panel = walks.scaled(spark, 2, 300)
    for run in (lambda: workflow.run_pipeline(spark, panel=panel), lambda: workflow.run_research(panel)):
        with pytest.raises(ValueError, match="one series"):
            run()


def test_a_registered_family_runs_like_the_others(short):
    from pyspark.sql import functions as F

    from siglab.operators import families

    families.register("calm", lambda c, s: {"vol": s.volatility(c.vol_lookback), "target": F.when(s.volatility(c.vol_lookback) < 0.012, 1.0).otherwise(0.0)})
    c = workflow.StrategyConfig(signal_family="calm")
    out = engine.bars(short, c).toPandas().sort_values("ts")
    assert c.label == "calm 20/60" and out.position.isin([0, 1]).all() and out.position.nunique() == 2


def test_the_volatility_filter_takes_no_wide_rows_through_python(short):
    """Only (series, time, volatility) goes through Python, and the rows stay where the first exchange put them."""
    from siglab.config import candidates

    plan = engine_plan(short, candidates())
    python = [x for x in plan.splitlines() if "FlatMapGroupsInArrow" in x]
    assert len(python) == 1 and python[0].split("],")[0].count("#") <= 4, python
    assert plan.count("Exchange ") <= 3 and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")
    joined = plan.split("Join")[0]
    assert joined.count("Exchange") == 0  # the windows above the join need no exchange of their own


def engine_plan(panel, configs):
    from siglab.plans import engine

    return engine.bars(panel, configs)._jdf.queryExecution().executedPlan().toString()
