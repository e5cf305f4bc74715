"""Ties that the last bits of a sum or product must not decide."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siglab.config import StrategyConfig
from siglab.operators import families, features, views
from siglab.plans import chunked, engine
from siglab.sources import walks


@pytest.fixture
def unsteady(spark):
    """Makes of a panel one whose prices differ in their last bits each time that it is read, as sums over a shuffle do."""

    def noisy(batches):
        rng = np.random.default_rng()
        for x in batches:
            yield x.assign(close=x.close * (1 + rng.normal(size=len(x)) * 1e-13))

    spark.conf.set("spark.sql.exchange.reuse", "false")  # else both readings may be one
    yield lambda panel: panel.mapInPandas(noisy, panel.schema)
    spark.conf.unset("spark.sql.exchange.reuse")


def several(spark, days, series=8):
    parts = [walks.seeded(spark, days, i).withColumn("series_id", F.lit(f"s{i}")) for i in range(series)]
    for x in parts[1:]:
        parts[0] = parts[0].unionByName(x)
    return parts[0]


def test_the_trough_is_the_first_of_equally_deep_days(spark):
    import duckdb

    # Flat bars after the deepest: their equity is one product, multiplied in another order where a twin's tree of it has a new node.
    equity = [1.0, 0.9, 0.9 * (1 - 2e-16), 0.9 * (1 - 4e-16), 0.95]
    rows = [("a", 0, dt.date(2024, 1, 1 + i), x) for i, x in enumerate(equity)]
    bars = spark.createDataFrame(rows, "series_id string, config_id int, ts date, strategy_equity double")
    assert views.trough(bars).first().trough_ts == dt.date(2024, 1, 2)
    con, sql = duckdb.connect(), entry.oracle_sql()["trough"]
    con.execute("CREATE TABLE bars (series_id VARCHAR, config_id INT, ts DATE, eq DOUBLE)")
    con.executemany("INSERT INTO bars VALUES (?, ?, ?, ?)", rows)
    assert con.execute("WITH " + sql[sql.rindex("d AS (SELECT *, (eq") :]).fetchone()[3] == dt.date(2024, 1, 2)


def test_a_value_that_is_the_quantile_is_in_the_lower_regime(spark, unsteady):
    # 161 bars have 101 volatilities, so each bound is one of them.
    got = features.with_regimes(unsteady(several(spark, 161))).groupBy("series_id").pivot("vol_regime", list(features.REGIMES)).count().toPandas()
    assert len(got) == 8 and all(tuple(x) == (34, 33, 24, 10) for x in got[list(features.REGIMES)].to_numpy())


def test_rows_without_a_series_have_no_regime(spark):
    panel = several(spark, 161, 1).withColumn("series_id", F.lit(None).cast("string"))
    assert features.with_regimes(panel.unionByName(several(spark, 161, 1))).count() == 161


FILTERED = StrategyConfig(signal_family="composite", use_volatility_filter=True)


def test_the_filter_passes_a_volatility_that_is_its_threshold(spark, unsteady):
    panel = several(spark, 600)
    got, want = (families.signal_frame(x, FILTERED).select("series_id", "ts", "risk_on", "target_position").toPandas().sort_values(["series_id", "ts"], ignore_index=True) for x in (unsteady(panel), panel))
    assert got.equals(want)


def test_bars_by_chunks_read_one_panel(spark, unsteady):
    panel = several(spark, 600)
    kept = ["series_id", "ts", "position"]
    got, want = (x.select(*kept).toPandas().sort_values(["series_id", "ts"], ignore_index=True) for x in (chunked.bars(unsteady(panel), FILTERED, rows=200), engine.bars(panel, FILTERED)))
    assert got.equals(want)
