from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_core_query_has_a_twin():
    from siglab.catalogue import queries

    # A seeded generator's numbers can't be put in SQL; its query is held against the generator in a test.
    assert set(queries.QUERIES) - {"bootstrap_seeded_summary"} == set(queries.TWINS) and set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["returns", "regime_labels", "validation_gates", "sig_volfilter", "drawdown_guard", "kpis_extended", "heatmap_pivot", "robustness_points", "quality_notes", "loader_gates", "loaded_panel", "window_checks", "in_market_histogram", "regime_scaled"])
def test_queries_match_their_twins(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = [c for c in sorted(got.columns) if got[c].dtype.kind != "f"]
    same = lambda x: x[sorted(got.columns)].astype({c: "datetime64[ns]" for c in key if c == "ts"}).sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(same(got), same(want), check_dtype=False)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_bootstrap_draws_a_thousand_paths_as_the_twin_does(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.execute(entry.oracle_sql()["bootstrap_summary"]).df().set_index("series_id").sort_index()
    got = entry.queries()["bootstrap_summary"](spark, SF).toPandas().set_index("series_id").sort_index()
    assert (got.n_simulations == 1000).all() and list(got.index) == list(want.index)
    assert ((got[want.columns] - want).abs() < 2e-6).all().all()


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 6 * 13


def test_only_absent_optional_modules_are_passed_over(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "broken_part.py").write_text("import no_such_module_at_all\n")
    assert entry._optional("no_such_package.part") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_part")
