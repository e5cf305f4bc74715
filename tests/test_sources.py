import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siglab.errors import ValidationError
from siglab.sources import files, gates, walks


def _frame(spark, values, start="2021-01-04"):
    days = pd.bdate_range(start, periods=len(values)).date
    return spark.createDataFrame([("a", d, v) for d, v in zip(days, values)], "series_id string, ts date, close double")


def test_walk_is_reproducible_and_follows_its_law(spark):
    a, b = walks.seeded(spark, 120, 3).toPandas(), walks.seeded(spark, 120, 3).toPandas()
    assert a.equals(b) and not np.allclose(a.close, walks.seeded(spark, 120, 4).toPandas().close)
    z = np.random.default_rng(3).standard_normal(120)
    assert np.allclose(a.close, 100 * np.exp(np.cumsum(0.0002 + 0.012 * z)))
    assert all(d.weekday() < 5 for d in a.ts)
    with pytest.raises(ValueError):
        walks.seeded(spark, 0)


def test_scaled_walk_has_every_series_and_only_weekdays(spark):
    out = walks.scaled(spark, 3, 40).toPandas()
    assert out.groupby("series_id").size().tolist() == [40, 40, 40]
    assert (out.close > 0).all() and all(d.weekday() < 5 for d in out.ts)
    assert not out.duplicated(["series_id", "ts"]).any()


def test_csv_in_any_order_with_optional_columns(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Date,close,VOLUME,benchmark_close\n2021-01-06,3,30,1\n2021-01-04,1,10,1\n2021-01-05,2,20,1\n")
    out = files.from_csv(spark, str(path)).orderBy("ts").toPandas()
    assert out.close.tolist() == [1, 2, 3] and list(out.columns) == ["series_id", "ts", "close", "volume", "benchmark_close"]


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("date,price\n2021-01-04,1\n", "'close' column not found"), ("date,Close\n2021-01-04,1\n", "'close' column not found"), ("date,close\n2021-01-04,1\n2021-01-04,2\n", "duplicate"),
        ("date,close\n2021-01-04,-1\n", "non-positive"), ("day,close\n2021-01-04,1\n", "No timestamp column"), ("date,close\nxx,1\n", "unparseable"), ("date,close\n2021-01-04,\n", "missing"), ("date,close\n", "no rows"),
    ],
)
def test_csv_gates(spark, tmp_path, text, said):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises(ValueError, match=said):
        files.from_csv(spark, str(path))


def test_missing_file_and_uploads(spark):
    with pytest.raises(ValueError, match="not found"):
        files.from_csv(spark, "/tmp/no-such-file.csv")
    assert files.from_upload(spark, io.StringIO("timestamp,close\n2021-01-04,1\n")).count() == 1
    with pytest.raises(ValueError, match="Could not read"):
        files.from_upload(spark, io.StringIO(""))
    assert files.sample(spark).count() == 420


@pytest.mark.parametrize(("values", "said"), [([1.0, None], "missing/NaN"), ([1.0, float("nan")], "missing/NaN"), ([1.0, -5.0], "non-positive"), ([1.0], "Insufficient rows")])
def test_hard_gates(spark, values, said):
    with pytest.raises(ValidationError, match=said):
        gates.validate(_frame(spark, values))


def test_gates_of_type_emptiness_and_columns(spark):
    with pytest.raises(ValidationError, match="Spark DataFrame"):
        gates.validate(pd.DataFrame())
    with pytest.raises(ValidationError, match="empty"):
        gates.validate(_frame(spark, [1.0]).filter("false"))
    with pytest.raises(ValidationError, match="Missing required"):
        gates.validate(_frame(spark, [1.0, 2.0]).withColumnRenamed("close", "price"))
    good = _frame(spark, [1.0, 2.0])
    assert gates.validate(good) is good


def test_quality_notes(spark):
    stale = walks.seeded(spark, 400, 11).withColumn("close", F.when(F.month("ts") > 3, 123.0).otherwise(F.col("close")))
    notes = gates.quality_notes(stale)["synthetic"]
    assert any("exactly zero" in x for x in notes) and any("benchmark" in x for x in notes) and not any("Short" in x for x in notes)
    assert any("Short series" in x for x in gates.quality_notes(_frame(spark, [1.0, 2.0]))["a"])


def test_gate_counts_of_dirty_and_of_empty_rows(spark):
    raw = spark.createDataFrame([("2021-01-04", "1"), ("2021-01-04", "x"), ("soon", "-2"), (None, "NaN")], "date string, close string")
    assert files.gate_counts(files.parsed(raw)).first().asDict() == {"n_rows": 4, "bad": 2, "twice": 1, "missing": 2, "low": 1}
    assert files.gate_counts(files.parsed(raw.filter("false"))).first().n_rows == 0


def test_a_series_without_notes_is_listed(spark):
    panel = walks.seeded(spark, 400, 11).withColumn("benchmark_close", F.col("close"))
    assert gates.quality_notes(panel) == {"synthetic": []} and gates.notes(panel).count() == 0
