from pathlib import Path

import pytest

from siglab.streaming import bars

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.skipif(not Path(EVENTS).exists(), reason="needs the events table")
def test_stream_and_batch_agree(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(EVENTS).orderBy("ts")
    rows.coalesce(1).write.parquet(str(source))
    query = bars.write_bars(bars.bars(bars.read_events(spark, str(source)), "1 day", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = bars.bars(spark.read.parquet(EVENTS), "1 day")
    assert streamed.count() > 0 and streamed.exceptAll(batch.select(streamed.columns)).count() == 0
