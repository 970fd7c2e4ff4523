"""Subgroup metrics from rows that are shuffled before they are repeated per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from routelore.operators import metrics as M

BY = ["split", "group_name", "group_value"]


@pytest.fixture(scope="module")
def scored(spark):
    """Decisions with one positive, several or none, tied probabilities, and missing values of every group."""
    rng, rows = np.random.default_rng(6), []
    for d in range(260):
        score, stops, n = str(rng.choice(["High", "Low", ""])), float(rng.choice([40, 90, 260])), int(rng.integers(1, 9))
        positives = 1 if rng.random() < 0.7 else int(rng.integers(0, 3))
        for k in range(n):
            zone = int(rng.integers(0, 3))
            p = float(np.round(rng.random(), 1 if d % 2 else 6))
            rows.append((("train", "test")[d % 2], str(d // 7), d % 7, f"s{k}", k, int(k < positives), p, score, stops, (d % 7) / 7.0,
                         7 - d % 7, zone == 0, zone == 1, int(rng.integers(0, 2)), float(rng.choice([0, 1, 2, 4, 9])), float(rng.choice([0, 30, 100, 500]))))
    columns = ["split", "route_id", "position", "candidate_stop", "negative_sample_rank", "label", "predicted_probability", "route_score", "number_of_stops", "route_progress",
               "remaining_stop_count", "same_zone", "zone_changed", "candidate_has_time_window", "candidate_package_count", "candidate_total_planned_service_time"]
    pdf = pd.DataFrame(rows, columns=columns).astype({"same_zone": int, "zone_changed": int})
    df = spark.createDataFrame(pdf)
    return df.replace(260.0, None, ["number_of_stops"]).replace(9.0, None, ["candidate_package_count"])


@pytest.mark.parametrize("rows_per_block", [30, 500_000])
def test_subgroups_equal_metrics_of_repeated_rows(scored, rows_per_block):
    want = M.all_metrics(M.subgroup_rows(scored), BY).toPandas().set_index(BY).sort_index()
    got = M.subgroup_metrics(scored, rows_per_block=rows_per_block).toPandas().set_index(BY).sort_index()
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-12)


def test_rows_are_shuffled_once_for_all_groups(scored):
    plan = M._subgroup_ranks(M.with_subgroups(scored))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # the rows, and the positives among them
