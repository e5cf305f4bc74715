"""Research over a panel says of each series what a run over that series alone says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglab.plans import panels, workflow
from siglab.sources import walks


@pytest.fixture(scope="module")
def panel(spark):
    parts = [walks.seeded(spark, n, seed, series_id=name) for name, n, seed in (("long", 640, 42), ("other", 520, 7), ("brief", 260, 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).cache()


def test_tables_equal_single_runs(spark, panel):
    tables = {k: v.toPandas() for k, v in panels.research(panel, simulations=60).items() if k in ("selection", "segments", "kpis", "walk_forward", "cost_sensitivity", "stress", "regimes", "overfit", "robustness")}
    assert set(tables["walk_forward"].series_id) == {"long", "other"} and set(tables["selection"].series_id) == {"long", "other", "brief"}
    for name in ("long", "other"):
        alone = workflow.run_pipeline(spark, panel=panel.filter(F.col("series_id") == name), simulations=60)
        own = {k: v[v.series_id == name].reset_index(drop=True) for k, v in tables.items()}
        assert own["selection"].label.tolist() == [alone["label"]]
        halves = own["segments"].set_index("segment")
        for part, key in (("train", "in_sample_kpis"), ("test", "out_of_sample_kpis")):
            assert all(np.isclose(halves.loc[part, k], v, atol=1e-12) for k, v in alone[key].items())
        assert all(np.isclose(own["kpis"][k][0], v, atol=1e-12) for k, v in alone["extended_kpis"].items() if v is not None)
        assert np.allclose(own["walk_forward"].sort_values("fold").test_sharpe, alone["walk_forward"].test_sharpe) and np.allclose(own["cost_sensitivity"].total_return, alone["cost_sensitivity"].total_return)
        assert np.allclose(own["stress"].sort_values("scenario_order").sharpe_ratio, alone["stress"].sharpe_ratio) and np.allclose(own["regimes"].sort_values("regime_order").n_days, alone["regimes"].n_days)
        assert round(own["robustness"].score[0], 1) == pytest.approx(alone["robustness"]["score"], abs=0.11) and bool(own["overfit"].overfit_flag[0]) == alone["overfit"]["overfit_flag"]


def test_tables_are_written(panel, tmp_path):
    tables = panels.research(panel, simulations=20)
    places = panels.write({k: tables[k] for k in ("selection", "notes", "bootstrap")}, str(tmp_path / "out"))
    spark = panel.sparkSession
    assert spark.read.parquet(places["bootstrap"]).count() == 3 and {r.note for r in spark.read.parquet(places["notes"]).collect()} == {"short", "alone"}
