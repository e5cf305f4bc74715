import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_stages_take_and_give_documents(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < len(p.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
    assert p.run(spark, SF).count() == sizes[-1]
    # A sequence is rebuilt from its own rows: the ids of its pieces, one after another.
    got = docs.toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        whole = b"".join(g.ids)
        assert len(whole) == 4 * g.length.sum() and [zlib.crc32(x) for x in g.ids] == g.ids_crc32.tolist()
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "toxicity")).select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert clean <= kept and len(toxic & kept) <= 0.2 * len(toxic)


def test_stages_over_awkward_tables(spark, docs, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names, no rows."""
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words under one id"), (None, "x y z"), (4, long), (5, " \n \n"), (7, None, None)]
    table = docs(rows)
    for name in ("line_runs_key", "u_", "repeats_", "mixed_at_", "text_key", "dart_id", "row", "ids", "p_toxic", "class_id"):
        table = table.withColumn(name, F.lit("x"))
    for name, stage in p.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name == "toxicity":
            assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs(rows).select("doc_id", "text").collect()))
        elif name == "line_dedup":
            assert out.count() == len(rows) and out.filter("text is null").count() == 0
        elif name == "near_dedup":
            assert sorted((r.doc_id or 0, r.text and r.text[:5]) for r in out.collect()) == sorted([(1, None), (3, "a b c"), (3, "other"), (0, "x y z"), (4, "w0 w1")])
        elif name == "mixing":
            assert {(r.doc_id, r.text) for r in out.collect()} <= {(r[0], r[1]) for r in rows}
        else:
            assert out.filter("piece = 0").count() == len(rows)
        assert name == "packing" or tuple(out.columns) == p.COLUMNS
        none = stage(spark, table.filter("false"), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns
