from __future__ import annotations

import numpy as np
import pandas as pd

from routelore.operators import routing as G
from routelore.operators.scoring import LogitScorer


def members(sizes):
    rows = pd.DataFrame({"route_id": np.repeat([f"r{i}" for i in range(len(sizes))], sizes), "zone": "z"})
    rows["stop_id"], rows["number_of_stops"] = [f"s{i}" for i in range(len(rows))], np.repeat(sizes, sizes)
    for k, c in enumerate(("is_station", "is_dropoff", *G.STOP_FEATURES)):
        rows[c] = (np.arange(len(rows)) * (k + 3) % 7).astype(float)
    return rows


def times_of(own):
    at = np.arange(len(own)) * 37 % 11
    matrix = np.abs(at[:, None] - at[None, :]).astype(float)
    return lambda stop: matrix[stop], lambda: matrix


def test_routes_of_usual_length_walk_many_at_a_time(monkeypatch):
    """Each step costs some sixty array calls whatever the number of routes, so a few dozen routes have to share them."""
    m = pd.DataFrame({"route_id": np.repeat([f"r{i:03d}" for i in range(120)], 60), "batch": 0})
    monkeypatch.setattr(G, "_greedy_batch", lambda *a: {})
    plans = [(G.NEAREST, "", (0.0,) * 5)] * 3
    together = list(G._walked(m, [plans], lambda own: None, None, lambda m, starts, sizes, batch, got: len(sizes)))
    assert sum(together) == 120 and len(together) <= 2


def test_a_step_works_on_the_stops_left_only():
    """Features of a state are worked out for the stops it may still visit."""
    widths = []

    class Recording(LogitScorer):
        def probability(self, features):
            widths.append(features["travel_time_ij"].shape[1])
            return super().probability(features)

    m = members([9, 9, 7])
    plans = [(G.HYBRID, f"w{i}", (1.0 - i / 4, i / 4, 0.0, 0.0, 0.0)) for i in range(5)]
    list(G._walked(m.assign(batch=0), [plans], times_of, Recording(0.1, {"travel_time_ij": -0.01}), G._figures_of))
    assert widths == list(range(8, 0, -1))


def test_longest_runs_of_rows_equal_patience_sorting():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 31, 200)
    orders = np.stack([np.r_[rng.permutation(n), np.zeros(30 - n, int)] for n in sizes])
    want = [len(G.patience_tile([], list(enumerate(row[:n].tolist())))[0]) for row, n in zip(orders, sizes)]
    assert G._longest_runs(orders, sizes).tolist() == want
    assert G._distinct_stops(orders, sizes).tolist() == sizes.tolist()
    assert G._distinct_stops(np.array([[0, 2, 2, 1]]), np.array([3])).tolist() == [2]


def test_routes_too_long_for_a_matrix_walk_the_same_way(monkeypatch):
    m = members([12, 9, 5, 1])
    plans = [(G.NEAREST, "", (0.0,) * 5), *[(G.HYBRID, f"w{i}", (1.0 - i / 9, i / 18, 0.0, 0.0, i / 18)) for i in range(9)]]
    scorer = LogitScorer(0.1, {"travel_time_ij": -0.01, "candidate_package_count": 0.3, "remaining_stop_count": 0.2})

    def walked(result):
        return pd.concat(list(G._walked(m.assign(batch=0), [plans], times_of, scorer, result))).sort_values(["route_id", "weight_id", "method"], kind="stable").reset_index(drop=True)

    want = [walked(r) for r in (G._steps_of, G._figures_of)]
    monkeypatch.setattr(G, "MATRIX_STOPS", 3)
    for r, w in zip((G._steps_of, G._figures_of), want):
        pd.testing.assert_frame_equal(walked(r), w)
