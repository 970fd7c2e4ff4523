from __future__ import annotations

from pyspark.sql import DataFrameWriter

from routelore import schemas
from routelore.sources import files

NAME = "spark.sql.maxConcurrentOutputFileWriters"


def test_samples_are_written_without_a_sort_by_split(spark, tmp_path, monkeypatch):
    asked, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: asked.append(int(spark.conf.get(NAME, "0"))) or write(self, *a, **k))
    before = spark.conf.get(NAME, "0")
    rows = spark.range(90).coalesce(1).selectExpr("cast(id AS string) AS route_id", "element_at(array('train', 'validation', 'test'), cast(id % 3 AS int) + 1) AS split")
    files.write_samples(rows, str(tmp_path / "samples"))
    assert asked and asked[0] >= 3
    assert spark.conf.get(NAME, "0") == before
    assert len(list(tmp_path.glob("samples/split=*/*.parquet"))) == 3
    back = spark.read.parquet(str(tmp_path / "samples"))
    assert sorted(back.columns) == sorted(schemas.PAIRWISE_SAMPLES.fieldNames())
    assert {(r["route_id"], r["split"]) for r in back.collect()} == {(r["route_id"], r["split"]) for r in rows.collect()}
    for split in ("train", "validation", "test"):
        held = [int(r["route_id"]) for r in spark.read.parquet(str(tmp_path / "samples" / f"split={split}")).collect()]
        assert held == sorted(held)
