"""The whole chain of jobs on a small set of nested files."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from routelore.plans import jobs
from routelore.sources.nested import Part


def write_inputs(folder, routes=40):
    rng = np.random.default_rng(0)
    raw, sequences, packages, times = {}, {}, {}, {"training_build": {}, "evaluation_apply": {}}
    for r in range(routes):
        n = int(rng.integers(6, 10))
        rid = f"r{r:03d}"
        stops = {f"s{i}": {"lat": 0.1 * i, "lng": 0.2, "type": "Station" if i == 0 else "Dropoff", "zone_id": None if i == 3 else f"Z{i // 2}"} for i in range(n)}
        raw[rid] = {"station_code": "A", "executor_capacity_cm3": 10.0, "route_score": ["High", "Medium", "Low"][r % 3], "stops": stops}
        sequences[rid] = {"actual": {f"s{i}": i for i in range(n)}}
        packages[rid] = {
            f"s{i}": {"p": {"planned_service_time_seconds": 10.0 * i, "dimensions": {"length_cm": 2.0, "width_cm": 2.0, "height_cm": float(i)}, "scan_status": "DELIVERED"}}
            for i in range(1, n)
        }
        times["training_build" if r % 4 else "evaluation_apply"][rid] = {
            f"s{i}": {f"s{j}": float(abs(i - j) * 10 + rng.integers(0, 8)) for j in range(n) if j != i} for i in range(n)
        }
    paths = {}
    for name, value in (("routes", raw), ("sequences", sequences), ("packages", packages), *times.items()):
        paths[name] = str(folder / f"{name}.json")
        (folder / f"{name}.json").write_text(json.dumps(value))
    return Part("all", paths["routes"], paths["sequences"], paths["packages"]), {s: paths[s] for s in times}


def test_all_jobs(spark, tmp_path):
    part, travel = write_inputs(tmp_path)
    t = jobs.Tables(spark, str(tmp_path / "out"))
    jobs.clean(t, [part], travel)
    jobs.check_quality(t)
    assert t.read("training_ready_routes").where("recommended_for_training").count() == 40
    jobs.explore(t)
    jobs.split(t)
    jobs.sample(t, negatives=3)
    summary = {r["split"]: r for r in t.read("pairwise_sample_summary").collect()}
    assert summary["train"]["routes_processed"] == 28
    assert sum(r["skipped_positive_missing_travel_time"] for r in summary.values()) == 0
    for name in ("route_outlier_flags", "single_source_summary", "quality_closing_summary", "training_flag_summary", "zone_missing_by_route_score", "route_size_histogram",
                 "travel_time_box_by_route_score", "feature_correlations", "eda_closing_summary", "split_overlap_check", "split_sample_coverage"):
        assert t.read(name).count() > 0, name
    seen = Observation("rows")  # a query observed by the user must not keep models from being sent to tasks
    t.read("routes_summary").observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 40
    best = jobs.train(t, ["logistic_regression", "gradient_boosted_trees"], trees=5, depth=3)
    for name in (best, "gradient_boosted_trees"):
        scorer = jobs.load_scorer(t, name)
    jobs.search_weights(t, scorer, step=0.5, max_vectors=8)
    assert t.read("weight_grid_results").count() == 8
    jobs.generate(t, scorer)
    metrics = t.read("route_metrics").toPandas()
    assert len(metrics) == 3 * 12 and metrics["route_valid"].all()
    jobs.compare(t, iterations=200)
    manifest = jobs.final_tables(t, best)
    assert manifest.count() == 10
    assert t.read("figure_tradeoff").count() == 3 and t.read("baseline_route_metrics").count() > 0
    with pytest.raises(FileExistsError):
        jobs.split(t)
    with pytest.raises(FileNotFoundError):
        jobs.Tables(spark, str(tmp_path / "none")).read("route_splits")


def test_scorer_uses_the_saved_features(spark, tmp_path):
    from routelore.operators import models

    rng = np.random.default_rng(1)
    rows = [("train" if i % 3 else "test", float(rng.normal()), float(i % 2), float(rng.normal()), i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "split string, travel_time_ij double, same_zone double, route_progress double, label int")
    used = models.feature_columns([df])
    t = jobs.Tables(spark, str(tmp_path))
    model = models.train("logistic_regression", df, used)
    model.write().save(t.path("models/logistic_regression"))
    t.write("model_features", spark.createDataFrame(list(enumerate(used)), "place int, feature string"))
    scorer = jobs.load_scorer(t, "logistic_regression")
    got = scorer.probability({f: np.array(df.toPandas()[f]) for f in used})
    want = models.score(model, df, used).toPandas()["predicted_probability"]
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-5)
