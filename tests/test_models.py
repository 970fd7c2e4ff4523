from __future__ import annotations

import numpy as np
import pytest

from routelore.operators import distribution as D
from routelore.operators import models as ML


@pytest.mark.parametrize("rows", [1, 2, 1001, 4000])
@pytest.mark.parametrize("sample_rows", [3, 500, 50_000])
def test_medians_are_exact_whatever_the_sample_says(spark, rows, sample_rows):
    rng = np.random.default_rng(rows)
    held = {
        "real": rng.normal(size=rows),
        "flag": (np.arange(rows) % 2).astype(float),
        "constant": np.full(rows, 7.0),
        "sparse": np.where(rng.random(rows) < 0.9, np.nan, rng.exponential(size=rows)),
        "absent": np.full(rows, np.nan),
    }
    table = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*held.values())]
    df = spark.createDataFrame(table, ", ".join(f"{c} double" for c in held))
    found = D.medians(df, list(held), sample_rows)
    for c, v in held.items():
        v = v[~np.isnan(v)]
        assert found[c] == (pytest.approx(np.median(v), rel=1e-15) if len(v) else None)


def test_unreadable_and_infinite_features_are_missing(spark):
    df = spark.createDataFrame([("1.5", 2, float("inf"), 0), ("x", None, float("nan"), 1), (None, 3, 0.1, 1)], "a string, b long, c double, label long")
    rows = ML.prepare(df, ["a", "b", "c"]).collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [(1.5, 2.0, None), (None, None, None), (None, 3.0, float(np.float32(0.1)))]


@pytest.mark.parametrize("name", ML.MODEL_NAMES)
def test_a_fit_passes_over_rows_that_are_written_once_and_dealt_evenly(spark, monkeypatch, name):
    df = spark.range(400).selectExpr("float(id % 7) AS x", "if(id % 5 = 0, null, id % 3) AS y", "cast(id % 7 > 3 AS long) AS label").coalesce(1)
    written, stage = [], ML.stage_table
    monkeypatch.setattr(ML, "stage_table", lambda rows, table: written.append((table, rows.rdd.getNumPartitions())) or stage(rows, table))
    model = ML.train(name, df, ["x", "y"], trees=3, depth=2)
    assert written == [("training_rows", spark.sparkContext.defaultParallelism)]
    assert spark.sparkContext.getCheckpointDir()
    scored = ML.score(model, df, ["x", "y"])
    assert scored.columns == [*df.columns, "predicted_probability"]
    assert scored.where("(predicted_probability > 0.5) = (label = 1)").count() > 380
