"""Route generation by greedy next-stop choice, and the evaluation of generated against driven routes.

Members are ``pairwise.attributed_sequence`` rows of admitted routes; travel times hold one source per route
(``edges_of_admitted``). Ties go to the stop that comes first in the driven order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from routelore.functions import scalars as S
from routelore.operators.joins import choose_source
from routelore.operators.ordering import null_safe_join
from routelore.operators.travel import StopTravel, Travel, end_columns, route_sources, time_between, with_times
from routelore.schemas import WEIGHTS
from routelore.sources.staging import stage_table

NEAREST, PREFERENCE, HYBRID = "travel_time_nearest_neighbor", "preference_greedy", "hybrid_greedy"
BEST_LABEL = "hybrid_greedy_best_weight"
#: Positions of a sequence that one task compares at a time.
ROUTE_BLOCK = 200_000
#: Weight plans of a route that one task walks together.
PLANS_AT_ONCE = 50
#: Cells (plan or stop, stop) of the routes that are walked together.
AT_ONCE = 240_000
#: Stops up to which a route's travel times are worked out at once.
MATRIX_STOPS = 500
STEP_SCHEMA = (
    "route_id string, method string, weight_id string, position long, stop_id string, actual_position long, "
    "candidate_count long, travel_time double, probability double, cost double, plans_sharing long"
)
FIGURE_SCHEMA = (
    "route_id string, method string, weight_id string, stop_count long, generated_total_travel_time double, lcs_similarity double, "
    "position_match_ratio double, generated_same_zone_ratio double, zone_change_count long, route_valid boolean"
)
STOP_FEATURES = (
    "package_count",
    "total_planned_service_time",
    "has_time_window",
    "time_window_package_count",
    "total_package_volume_cm3",
    "delivered_count",
    "attempted_count",
    "rejected_count",
    "unknown_status_count",
)
COMPONENTS = ("travel_norm", "preference_penalty", "zone_penalty", "time_window_risk", "workload_norm")
Plan = tuple[str, str, Sequence[float]]  # method, weight id, five weights


# ---- admission --------------------------------------------------------------------------------------------------
def sequence_admission(ids: DataFrame, sequence: DataFrame) -> DataFrame:
    """route_id, stop_count and sequence_status: ok, missing_or_short_sequence or duplicate_stop_in_sequence."""
    per_stop = sequence.groupBy("route_id", "stop_id").agg(F.count("*").alias("n"))
    per_route = per_stop.groupBy("route_id").agg(F.sum("n").alias("stop_count"), F.max("n").alias("__most"))
    count = F.coalesce("stop_count", F.lit(0).cast("long"))
    status = (
        F.when(count < 2, "missing_or_short_sequence").when(F.col("__most") > 1, "duplicate_stop_in_sequence").otherwise("ok")
    )
    return ids.select("route_id").join(per_route, "route_id", "left").select(
        "route_id", count.alias("stop_count"), status.alias("sequence_status")
    )


def route_admission(admission: DataFrame, lookup: DataFrame, travel: Travel) -> DataFrame:
    """Adds the source to use and route_status: ok, the sequence problem, missing_source or missing_matrix."""
    sources = lookup.select(
        "route_id", "travel_time_source", choose_source(lookup).alias("found")
    )
    matrices = route_sources(travel).select("route_id", F.col("source").alias("found"), F.lit(True).alias("__m"))
    joined = admission.join(sources, "route_id", "left").join(matrices, ["route_id", "found"], "left")
    listed = F.coalesce(F.col("travel_time_source"), F.lit("missing_source")) != "missing_source"
    status = (
        F.when(F.col("sequence_status") != "ok", F.col("sequence_status"))
        .when(~listed, "missing_source")
        .when(F.col("__m").isNull(), "missing_matrix")
        .otherwise("ok")
    )
    return joined.select(
        "route_id", "stop_count", F.when(status == "ok", F.col("found")).alias("source"), status.alias("route_status")
    )


def admission_counts(admitted: DataFrame) -> DataFrame:
    """One row: requested, processable and skipped routes by reason."""
    s = F.col("route_status")
    return admitted.agg(
        F.count("*").alias("route_count_requested"),
        F.count_if(s == "ok").alias("route_count_processable"),
        F.count_if(s.isin("missing_or_short_sequence", "duplicate_stop_in_sequence")).alias("routes_skipped_invalid_sequence"),
        F.count_if(s == "missing_source").alias("routes_skipped_missing_source"),
        F.count_if(s == "missing_matrix").alias("routes_skipped_missing_matrix"),
    )


def edges_of_admitted(edges: Travel, admitted: DataFrame) -> Travel:
    """Finite travel times of each admitted route's chosen source."""
    wanted = admitted.where(F.col("route_status") == "ok").select("route_id", "source")
    if isinstance(edges, StopTravel):
        return edges.only(edges.sources.join(wanted, ["route_id", "source"], "left_semi"))
    kept = edges.join(wanted, ["route_id", "source"], "left_semi")
    return kept.select("route_id", "from_stop", "to_stop", S.finite(F.col("travel_time")).alias("travel_time")).where(
        F.col("travel_time").isNotNull()
    )


# ---- one decision, set-based ------------------------------------------------------------------------------------
def decision_candidates(decisions: DataFrame, unvisited: DataFrame, travel: Travel, keys: Sequence[str]) -> DataFrame:
    """Feature and component rows of every unvisited stop of every decision.

    decisions: keys, route_id, step, current_zone, current_is_station, current_is_dropoff, current_stop, one row per
    key. unvisited: keys and member columns of the stops left. Ranges for scaling are aggregates joined back, so a
    route with very many stops is combined before the shuffle; nothing is windowed or collected per route.
    """
    keys = list(keys)
    on = list(dict.fromkeys([*keys, "route_id"]))
    pairs = unvisited.join(decisions, on)
    remaining = unvisited.groupBy(*on).agg(F.count("*").alias("remaining_stop_count"))
    timed = with_times(pairs, travel, "__t", "current_stop", "stop_id").join(remaining, on)
    flags = S.zone_pair_flags(F.col("current_zone"), F.col("zone"))
    load = S.workload(*[F.col(c) for c in ("package_count", "total_planned_service_time", "time_window_package_count", "total_package_volume_cm3")])
    rows = timed.withColumns(flags).withColumns({"__load": load}).select(
        *on,
        "step",
        "current_stop",
        F.col("stop_id").alias("candidate_stop"),
        F.col("position").alias("actual_position"),
        F.col("__t").alias("travel_time"),
        F.coalesce("__t", F.lit(0.0)).alias("travel_time_ij"),
        *flags,
        F.col("number_of_stops").cast("double").alias("number_of_stops"),
        S.progress_of_serving(F.col("step"), F.col("number_of_stops")).alias("route_progress"),
        F.col("remaining_stop_count").cast("double").alias("remaining_stop_count"),
        "current_is_station",
        "current_is_dropoff",
        F.col("is_station").alias("candidate_is_station"),
        F.col("is_dropoff").alias("candidate_is_dropoff"),
        *[F.col(c).cast("double").alias(f"candidate_{c}") for c in STOP_FEATURES],
        "__load",
    )
    return _with_components(rows, on)


def _scaled(value: Column, low: Column, high: Column) -> Column:
    near = (high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    return F.when(near, F.lit(0.0)).otherwise((value - low) / (high - low))


def _with_components(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    ranges = rows.groupBy(*on).agg(
        F.min("travel_time").alias("__tlo"), F.max("travel_time").alias("__thi"),
        F.min("__load").alias("__llo"), F.max("__load").alias("__lhi"),
    )
    travel = F.when(F.col("travel_time").isNotNull(), _scaled(F.col("travel_time"), F.col("__tlo"), F.col("__thi")))
    return (
        rows.join(ranges, list(on))
        .withColumns(
            {
                "travel_norm": F.coalesce(travel, F.lit(1.0)),
                "zone_penalty": S.zone_penalty(F.col("zone_missing_in_pair"), F.col("zone_changed")),
                "time_window_risk": S.window_risk(F.col("candidate_has_time_window")),
                "workload_norm": _scaled(F.col("__load"), F.col("__llo"), F.col("__lhi")),
            }
        )
        .drop("__tlo", "__thi", "__llo", "__lhi", "__load")
    )


def with_costs(candidates: DataFrame, probability: Column, weights: Sequence[Column | float]) -> DataFrame:
    """Adds probability, preference_penalty and hybrid_cost."""
    scored = candidates.withColumn("probability", probability).withColumn("preference_penalty", 1.0 - F.col("probability"))
    return scored.withColumn("hybrid_cost", S.weighted_cost([F.col(c) for c in COMPONENTS], weights))


def choose_next(candidates: DataFrame, keys: Sequence[str], method: Column) -> DataFrame:
    """The chosen candidate of each decision: nearest, most preferred or cheapest, ties by driven order."""
    far = F.coalesce("travel_time", F.lit(float("inf")))
    badness = (
        F.when(method == NEAREST, far).when(method == PREFERENCE, -F.col("probability")).otherwise(F.col("hybrid_cost"))
    )
    best = F.min_by(
        F.struct("candidate_stop", "actual_position", "travel_time", "probability", "hybrid_cost"),
        F.struct(badness.alias("b"), F.col("actual_position").alias("a")),
    )
    return candidates.groupBy(*keys).agg(best.alias("__b"), F.count("*").alias("candidate_count")).select(
        *keys, "candidate_count", "__b.*"
    )


def first_decisions(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The decision at the start of every route and the stops it can choose from."""
    start = members.where(F.col("position") == 0).select(
        "route_id",
        F.lit(0).cast("long").alias("step"),
        F.col("stop_id").alias("current_stop"),
        F.col("zone").alias("current_zone"),
        F.col("is_station").alias("current_is_station"),
        F.col("is_dropoff").alias("current_is_dropoff"),
    )
    return start, members.where(F.col("position") > 0)


# ---- whole routes -----------------------------------------------------------------------------------------------
def _masked_scale(values: np.ndarray, use: np.ndarray, missing: float) -> np.ndarray:
    """Min-max scaling of each row over the cells in use; constant rows become 0, other cells ``missing``."""
    scaled = np.where(use, values, np.inf)
    low = scaled.min(axis=1, keepdims=True)
    high = np.where(use, values, -np.inf).max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        near = (high - low) <= 1e-9 * np.maximum(np.abs(low), np.abs(high))
        scaled -= low
        scaled /= np.where(near, np.inf, high - low)
    return np.where(use, scaled, missing)


def _greedy_batch(m: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray, times: Sequence, plans: Sequence[Plan], scorer) -> dict[str, np.ndarray]:
    """Some plans of some routes at once: arrays (route and plan, step) of chosen stops and their figures, empty after a route's end.

    Route i has the ``sizes[i]`` rows of ``m`` from ``starts[i]`` on, the longest first; ``times``: a pair of functions for each, the travel times
    from a stop's place to all of the route's, and all of them as a matrix. Plans of a route that have made the same choices so far are one state,
    worked out once: a step costs the features of its distinct states for the stops they have left, and of each plan only the weighted
    sum. Memory is plans x stops, and a matrix for each route of at most ``MATRIX_STOPS`` stops.
    """
    routes, w, n = len(sizes), len(plans), int(sizes.max())
    valid = np.arange(n) < sizes[:, None]
    at = np.where(valid, starts[:, None] + np.arange(n), starts[:, None])
    zone = m["zone"].to_numpy()
    codes = np.where(zone == S.UNKNOWN_ZONE, -1, pd.factorize(zone)[0])[at]
    arrays = {c: m[c].to_numpy(float)[at] for c in STOP_FEATURES}
    station, dropoff = m["is_station"].to_numpy(float)[at], m["is_dropoff"].to_numpy(float)[at]
    load = (
        arrays["package_count"] + arrays["total_planned_service_time"] / 60.0
        + arrays["time_window_package_count"] + arrays["total_package_volume_cm3"] / 10000.0
    )
    n_stops = m["number_of_stops"].to_numpy(float)[starts]
    risk = np.where(arrays["has_time_window"] == 1, 0.0, 1.0)
    methods = np.tile(np.array([p[0] for p in plans]), routes)
    weights = np.tile(np.array([list(p[2]) for p in plans], float).reshape(w, 5), (routes, 1))
    nearest, preferred = (methods == NEAREST)[:, None], (methods == PREFERENCE)[:, None]
    by_candidate = {f"candidate_{c}": a for c, a in arrays.items()}
    by_candidate |= {"candidate_is_station": station, "candidate_is_dropoff": dropoff}
    by_candidate = {f: by_candidate.get(f) for f in scorer.features}  # unknown features serve as 0
    matrices = None
    if n <= MATRIX_STOPS:
        matrices = np.full((routes, n, n), np.nan)
        for i, (size, (_row, matrix)) in enumerate(zip(sizes, times)):
            matrices[i, :size, :size] = matrix()
    state, route, current = np.repeat(np.arange(routes), w), np.arange(routes), np.zeros(routes, int)
    left = np.tile(np.arange(1, n), (routes, 1))  # each state's stops still to visit, in driven order; beyond a route's end they do not count
    out = {k: np.full((routes * w, n - 1), np.nan) for k in ("travel", "probability", "cost")}
    picked, shared = np.zeros((routes * w, n - 1), int), np.zeros((routes * w, n - 1), int)
    same_zone, zone_changed = np.zeros((routes * w, n - 1), bool), np.zeros((routes * w, n - 1), bool)
    for step in range(n - 1):
        going = int(np.searchsorted(-sizes, -(step + 1), side="left"))  # routes with a stop left
        rows = slice(0, going * w)
        if len(state) > going * w:
            kept, state = np.unique(state[rows], return_inverse=True)
            route, current, left = route[kept], current[kept], left[kept]
        many = len(current)
        free = np.arange(n - 1 - step) < (sizes[route] - 1 - step)[:, None]
        cells = route[:, None] * n + left
        of_left = lambda a: a.ravel().take(cells)
        if matrices is not None:
            tt = matrices.ravel().take((route * n + current)[:, None] * n + left)
        else:
            tt = np.full((many, n), np.nan)
            for i, (r, stop) in enumerate(zip(route, current)):
                tt[i, : sizes[r]] = times[r][0](stop)
            tt = np.take_along_axis(tt, left, axis=1)
        known = np.isfinite(tt)
        here, there = codes[route, current][:, None], of_left(codes)
        missing = (here < 0) | (there < 0)
        same = ~missing & (here == there)
        changed = ~missing & ~same
        step_features = {
            "travel_time_ij": lambda: np.where(known, tt, 0.0),
            "same_zone": lambda: same.astype(float),
            "zone_changed": lambda: changed.astype(float),
            "zone_missing_in_pair": lambda: missing.astype(float),
            "number_of_stops": lambda: n_stops[route][:, None],
            "route_progress": lambda: (step / np.maximum(n_stops[route] - 1, 1))[:, None],
            "remaining_stop_count": lambda: (sizes[route] - 1.0 - step)[:, None],
            "current_is_station": lambda: station[route, current][:, None],
            "current_is_dropoff": lambda: dropoff[route, current][:, None],
        }
        features = {f: step_features[f]() if f in step_features else np.zeros((many, 1)) if a is None else of_left(a) for f, a in by_candidate.items()}
        p = np.broadcast_to(scorer.probability(features), tt.shape)
        if not np.isfinite(p).all():
            p = np.nan_to_num(p, nan=0.0, posinf=1.0, neginf=0.0)
        p = np.clip(p, 0.0, 1.0)
        parts = (
            _masked_scale(tt, free & known, 1.0), 1.0 - p, np.where(missing, 0.5, changed.astype(float)),
            of_left(risk), _masked_scale(of_left(load), free, 0.0),
        )
        cost = parts[0][state]
        cost *= weights[rows, 0:1]
        for i in range(1, 5):
            part = parts[i][state]
            part *= weights[rows, i : i + 1]
            cost += part
        badness = cost
        if nearest[rows].any():
            badness = np.where(nearest[rows], np.where(known, tt, np.finfo(float).max)[state], badness)
        if preferred[rows].any():
            badness = np.where(preferred[rows], -p[state], badness)
        column = np.where(free[state], badness, np.inf).argmin(axis=1)
        picked[rows, step] = left[state, column]
        shared[rows, step] = np.bincount(state, minlength=many)[state]
        out["travel"][rows, step] = tt[state, column]
        out["probability"][rows, step] = p[state, column]
        out["cost"][rows, step] = cost[np.arange(len(state)), column]
        same_zone[rows, step], zone_changed[rows, step] = same[state, column], changed[state, column]
        reached, state = np.unique(state * n + column, return_inverse=True)
        before, column = reached // n, reached % n
        route, current = route[before], left[before, column]
        left = left[before][np.arange(n - 1 - step) != column[:, None]].reshape(len(reached), n - 2 - step)
    return {"picked": picked, "shared": shared, "same_zone": same_zone, "zone_changed": zone_changed, **out}


def _steps_of(m: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray, batch: Sequence[Plan], got: dict[str, np.ndarray]) -> pd.DataFrame:
    """A row for each step of each route and plan; position 0 is the given start."""
    w, n = len(batch), int(sizes.max())
    held = np.repeat(np.arange(n) < sizes[:, None], w, axis=0)
    first = lambda x, v: np.concatenate([np.full((len(x), 1), v), x], axis=1)
    picked = first(got["picked"], 0)
    position = np.broadcast_to(np.arange(n), held.shape)
    per = lambda x: np.repeat(x, held.sum(axis=1))
    return pd.DataFrame(
        {
            "route_id": per(np.repeat(m["route_id"].to_numpy()[starts], w)),
            "method": per(np.tile(np.array([p[0] for p in batch], object), len(sizes))),
            "weight_id": per(np.tile(np.array([p[1] for p in batch], object), len(sizes))),
            "position": position[held],
            "stop_id": m["stop_id"].to_numpy()[(np.repeat(starts, w)[:, None] + picked)[held]],
            "actual_position": picked[held],
            "candidate_count": (np.repeat(sizes, w)[:, None] - position)[held],
            **{c: first(got[k], np.nan)[held] for c, k in (("travel_time", "travel"), ("probability", "probability"), ("cost", "cost"))},
            "plans_sharing": first(got["shared"], w)[held],
        }
    )


def _longest_runs(orders: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the longest increasing run of the first ``sizes`` numbers of each row, all below the width: patience sorting row by row at once."""
    width = orders.shape[1]
    values = np.ascontiguousarray(np.where(np.arange(width) < sizes[:, None], orders, width).T, np.int32)
    tails, rows = np.full(values.shape, width, np.int32), np.arange(len(orders))
    for j, own in enumerate(values):
        tails[(tails[: j + 1] < own).sum(axis=0, dtype=np.int16), rows] = own
    return (tails < width).sum(axis=0)


def _distinct_stops(orders: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of different numbers among the first ``sizes`` of each row."""
    met = np.zeros(orders.shape, bool)
    held = np.arange(orders.shape[1]) < sizes[:, None]
    met[np.nonzero(held)[0], orders[held]] = True
    return met.sum(axis=1)


def _figures_of(m: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray, batch: Sequence[Plan], got: dict[str, np.ndarray]) -> pd.DataFrame:
    """A row for each route and plan: what ``leg_totals`` and ``order_agreement`` find on its steps."""
    w, n = len(batch), np.repeat(sizes, len(batch))
    legs = np.arange(int(sizes.max()) - 1) < (n - 1)[:, None]
    timed = np.where(legs, np.isfinite(got["travel"]), True).all(axis=1) & (n > 1)
    total = np.where(legs & np.isfinite(got["travel"]), got["travel"], 0.0).sum(axis=1)
    at = got["picked"]
    if legs.shape[1] < MATRIX_STOPS:
        orders = np.concatenate([np.zeros((len(n), 1), int), at], axis=1)
        longest, distinct = _longest_runs(orders, n), _distinct_stops(orders, n)
    else:
        longest, distinct = np.empty(len(n), int), np.empty(len(n), int)
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}  # plans of a route that walk the same way are compared once
        for i, size in enumerate(n):
            key = (i // w, at[i].tobytes())
            if key not in seen:
                order = [0, *at[i, : size - 1].tolist()]
                seen[key] = len(patience_tile([], list(enumerate(order)))[0]), len(set(order))
            longest[i], distinct[i] = seen[key]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 1, (got["same_zone"] & legs).sum(axis=1) / (n - 1), np.nan)
    moved = pd.array((got["zone_changed"] & legs).sum(axis=1), "Int64")
    moved[n < 2] = pd.NA
    return pd.DataFrame(
        {
            "route_id": np.repeat(m["route_id"].to_numpy()[starts], w),
            "method": np.tile(np.array([p[0] for p in batch], object), len(sizes)),
            "weight_id": np.tile(np.array([p[1] for p in batch], object), len(sizes)),
            "stop_count": n,
            "generated_total_travel_time": np.where(timed, total, np.nan),
            "lcs_similarity": longest / n,
            "position_match_ratio": (((at == np.arange(1, at.shape[1] + 1)) & legs).sum(axis=1) + 1) / n,
            "generated_same_zone_ratio": share,
            "zone_change_count": moved,
            "route_valid": distinct == n,
        }
    )


def _whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups only, from frames sorted by the keys."""
    keys, held = list(keys), []
    for f in frames:
        if not len(f):
            continue
        other = (f[keys] != f[keys].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pd.concat([*held, f.iloc[:cut]], ignore_index=True)
            held = [f.iloc[cut:]]
        elif held and (held[0][keys].iloc[0] != f[keys].iloc[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = [f]
        else:
            held.append(f)
    if held:
        yield pd.concat(held, ignore_index=True)


def _walked(m: pd.DataFrame, batches: Sequence[Sequence[Plan]], times_of, scorer, result, cells: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """``result`` of all routes of ``m``, whose rows are sorted by route, batch of plans and position. Routes of like length are walked
    together as long as their plans and stops stay within ``AT_ONCE`` cells."""
    ids, dealt = m["route_id"].to_numpy(), m["batch"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (dealt[1:] != dealt[:-1])])
    sizes = np.diff(np.r_[starts, len(m)])
    for b in np.unique(dealt[starts]):
        own = np.flatnonzero(dealt[starts] == b)
        own = own[np.argsort(-sizes[own], kind="stable")]
        plans = batches[b]
        while len(own):
            n = int(sizes[own[0]])
            together = max(1, AT_ONCE // (n * max(len(plans), min(n, MATRIX_STOPS))))
            some, own = own[:together], own[together:]
            times = [times_of(m.iloc[starts[i] : starts[i] + sizes[i]]) for i in some]
            size = max(1, cells // n)
            for start in range(0, len(plans), size):
                batch = plans[start : start + size]
                yield result(m, starts[some], sizes[some], batch, _greedy_batch(m, starts[some], sizes[some], times, batch, scorer))


def _times_of_edges(m: pd.DataFrame, e: pd.DataFrame):
    """Travel times from a stop's place, and from all, from the route's edges as a sparse index."""
    at = pd.Series(np.arange(len(m)), index=m["stop_id"])
    e = e[e["from_stop"].isin(at.index) & e["to_stop"].isin(at.index)]
    source = at.reindex(e["from_stop"]).to_numpy(int)
    order = np.argsort(source, kind="stable")
    begin = np.searchsorted(source[order], np.arange(len(m) + 1))
    to, time = at.reindex(e["to_stop"]).to_numpy(int)[order], e["travel_time"].to_numpy(float)[order]

    def times(stop: int) -> np.ndarray:
        out, own = np.full(len(m), np.nan), slice(begin[stop], begin[stop + 1])
        out[to[own]] = time[own]
        return out

    return times, lambda: np.stack([times(stop) for stop in range(len(m))])


def _times_of_stops(columns: Sequence[str], row):
    """Travel times from a stop's place, and from all, worked out from the stops' own columns."""

    def times_of(m: pd.DataFrame):
        values, source = {c: m[f"__{c}"].to_numpy() for c in columns}, m["__source"].iloc[0]

        def times(stop: int) -> np.ndarray:
            out = np.asarray(row({c: v[stop] for c, v in values.items()}, values, source), float)
            out[stop] = np.nan
            return out

        def matrix() -> np.ndarray:
            found = row({c: v[:, None] for c, v in values.items()}, {c: v[None, :] for c, v in values.items()}, source)
            out = np.array(np.broadcast_to(found, (len(m), len(m))), float)
            np.fill_diagonal(out, np.nan)
            return out

        return times, matrix

    return times_of


def _walk(members: DataFrame, travel: Travel, plans: Sequence[Plan], scorer, plans_at_once: int, result, schema: str) -> DataFrame:
    """``result`` of every (route, plan). Work is dealt by (route, batch of plans), so no task holds the whole weight grid."""
    needed = ["route_id", "position", "stop_id", "zone", "is_station", "is_dropoff", "number_of_stops", *STOP_FEATURES]
    own = [(a, b, tuple(c)) for a, b, c in plans]
    batches = [own[i : i + plans_at_once] for i in range(0, len(own), plans_at_once)]
    # Walking is heavy per row, so all sides keep a full set of partitions instead of being coalesced by their size.
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    dealt = F.explode(F.array(*[F.lit(i) for i in range(len(batches))])).alias("batch")

    if isinstance(travel, StopTravel):
        known = members.select(*needed).join(travel.sources.select("route_id", F.col("source").alias("__source")), "route_id", "left")
        values = travel.stops.select("route_id", "stop_id", *[F.col(c).alias(f"__{c}") for c in travel.columns])
        known = known.join(values, ["route_id", "stop_id"], "left").select("*", dealt)
        times_of = _times_of_stops(travel.columns, travel.row)

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for m in _whole_groups(frames, ["route_id", "batch"]):
                yield from _walked(m, batches, times_of, scorer, result)

        placed = known.repartition(tasks, "route_id", "batch").sortWithinPartitions("route_id", "batch", "position")
        return S.sanitize(placed.mapInPandas(walk, schema))
    wanted = travel.join(members.where(F.col("position") == 0).select("route_id"), "route_id", "left_semi")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, m: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("position", kind="stable").reset_index(drop=True)
        found = list(_walked(m, batches, lambda held: _times_of_edges(held, e), scorer, result)) if len(m) else []
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in names})

    def groups(df: DataFrame):
        return df.repartition(tasks, "route_id", "batch").groupBy("route_id", "batch")

    left, right = groups(members.select(*needed, dealt)), groups(wanted.select("route_id", "from_stop", "to_stop", "travel_time", dealt))
    return S.sanitize(left.cogroup(right).applyInPandas(run, schema))


def generate_routes(
    members: DataFrame, travel: Travel, plans: Sequence[Plan], scorer, plans_at_once: int = PLANS_AT_ONCE
) -> DataFrame:
    """Every step of the greedy route of every (route, plan); position 0 is the given start.

    Choosing the next stop depends on all earlier choices, so a route is walked in one task, whatever its length, with
    its edges as a sparse index or its times worked out as they are asked for. ``plans_sharing`` is the number of plans of a batch for which the
    step was worked out at once.
    """
    return _walk(members, travel, plans, scorer, plans_at_once, _steps_of, STEP_SCHEMA)


def generated_metrics(
    members: DataFrame, travel: Travel, plans: Sequence[Plan], scorer, actual: DataFrame, plans_at_once: int = PLANS_AT_ONCE
) -> DataFrame:
    """``route_metrics`` of ``generate_routes`` for many plans: a route's steps are measured where they are walked, so no step is written,
    shuffled or joined again. ``actual`` holds the members' own order."""
    made = _walk(members, travel, plans, scorer, plans_at_once, _figures_of, FIGURE_SCHEMA)
    driven = driven_totals(actual, travel, members.select("route_id", "stop_id", "zone"))
    return with_driven(made, driven, ["route_id", "method", "weight_id"])


# ---- evaluation -------------------------------------------------------------------------------------------------
def sequence_legs(sequence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consecutive stops as from_stop and to_stop, by an equi-join on the next position."""
    keys = list(keys)
    following = sequence.select(*keys, (F.col("position") - 1).alias("position"), F.col("stop_id").alias("to_stop"))
    return sequence.select(*keys, "position", F.col("stop_id").alias("from_stop")).join(following, [*keys, "position"])


def leg_totals(legs: DataFrame, travel: Travel, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sequence: total travel time (null if any leg has none), same-zone ratio over all legs, zone changes."""
    if isinstance(travel, StopTravel):
        # Zone and the columns that times follow from are one table of stops, met once from each end.
        own = end_columns(travel)
        known = travel.sources.select("route_id", F.col("source").alias("__source"), F.lit(True).alias("__known")).distinct()
        places = travel.stops.select("route_id", "stop_id", *[F.col(c).alias(f"__end_{c}") for c in travel.columns], F.lit(True).alias("__end"))
        places = places.join(zones.select("route_id", "stop_id", "zone"), ["route_id", "stop_id"], "full")
        ends = [
            places.select("route_id", F.col("stop_id").alias(stop), F.col("zone").alias(f"__{m}"), *[F.col(c).alias(f"{m}{c}") for c in own])
            for stop, m in (("from_stop", "a"), ("to_stop", "b"))
        ]
        met = legs.join(ends[0], ["route_id", "from_stop"], "left").join(ends[1], ["route_id", "to_stop"], "left").join(known, "route_id", "left")
        zoned = met.withColumn("travel_time", time_between(travel, "a", "b", "from_stop", "to_stop", "__source"))
    else:
        timed = with_times(legs, travel, "travel_time")
        left = zones.select("route_id", F.col("stop_id").alias("from_stop"), F.col("zone").alias("__a"))
        right = zones.select("route_id", F.col("stop_id").alias("to_stop"), F.col("zone").alias("__b"))
        zoned = timed.join(left, ["route_id", "from_stop"], "left").join(right, ["route_id", "to_stop"], "left")
    flags = S.zone_pair_flags(F.coalesce("__a", F.lit(S.UNKNOWN_ZONE)), F.coalesce("__b", F.lit(S.UNKNOWN_ZONE)))
    return zoned.groupBy(*keys).agg(
        F.when(F.count("travel_time") == F.count("*"), F.sum("travel_time")).alias("total_travel_time"),
        F.avg(flags["same_zone"].cast("double")).alias("same_zone_ratio"),
        F.sum(flags["zone_changed"]).alias("zone_change_count"),
    )


def patience_tile(tails: Sequence[int], moves: Sequence[tuple[int, int | None]]) -> tuple[list[int], list[int]]:
    """One tile of patience sorting: the tails left, and the positions whose move takes the least tail of a higher range.

    ``tails`` are the rising tails of a range of values before a block of positions. A move (position, value) puts the value in place of
    the first tail that is not below it; if the range has none, the value is added and the tail to take is in a higher range.
    A move (position, None) takes the range's least tail, coming from a lower range."""
    tails, least, on = list(tails), 0, []
    for position, value in moves:
        if value is None:
            if least < len(tails):
                least += 1
            else:
                on.append(position)
            continue
        k = bisect_left(tails, value, least)
        if k == len(tails):
            tails.append(value)
            on.append(position)
        else:
            tails[k] = value
    return tails[least:], on


def _one_tile_lengths(rows: DataFrame) -> DataFrame:
    """__k and lcs_length of sequences of one tile each, one after the other as the sorted rows come."""
    order = ["position", "value"]
    placed = rows.select("__k", *order, F.row_number().over(W.partitionBy("__k").orderBy(*order)).alias("place"))
    schema = T.StructType([T.StructField("__k", rows.schema["__k"].dataType), T.StructField("lcs_length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tails = [], []
        for b in batches:
            key, values = b.column("__k"), b.column("value").to_pylist()
            starts, lengths = np.flatnonzero(b.column("place").to_numpy() == 1).tolist(), []
            tails, _ = patience_tile(tails, list(enumerate(values[: starts[0] if starts else None])))  # the rest of the last key
            for lo, hi in zip(starts, [*starts[1:], len(values)]):
                if keys:
                    lengths.append(len(tails))
                keys.append(key.slice(lo, 1))
                tails, _ = patience_tile([], list(enumerate(values[lo:hi])))
            if lengths:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys[: len(lengths)]), pa.array(lengths, pa.int64())], names=schema.names)
                keys = keys[len(lengths) :]
        if keys:
            yield pa.RecordBatch.from_arrays([keys[0], pa.array([len(tails)], pa.int64())], names=schema.names)

    return placed.sortWithinPartitions("__k", *order).mapInArrow(run, schema)


def lcs_lengths(matched: DataFrame, keys: Sequence[str], block: int = ROUTE_BLOCK) -> DataFrame:
    """Longest common subsequence of two orders of the same distinct stops, per key.

    ``matched``: keys, position (generated), actual_position. It equals the longest increasing run of actual positions, which
    patience sorting finds as its number of tails. The sort is cut into tiles of ``block`` positions by ``block`` values: a tile needs the tails that
    the block before left in its range, and the moves that lower ranges passed on, both staged. Tiles on a diagonal are worked
    side by side, so no task holds more than some blocks of a sequence; one within a block is a single tile.
    """
    keys = list(keys)
    tile = ["__k", "i", "j"]
    rows = matched.select(F.struct(*keys).alias("__k"), F.floor(F.col("position") / block).alias("i"), F.floor(F.col("actual_position") / block).alias("j"),
                          F.col("position").cast("long").alias("position"), F.col("actual_position").cast("long").alias("value"))
    if rows.where("i > 0 OR j > 0").isEmpty():
        return _one_tile_lengths(rows).select("__k.*", "lcs_length")
    last = rows.groupBy("__k").agg(F.max("i").alias("last_i"), F.max("j").alias("last_j"))
    rows = null_safe_join(rows, last, ["__k"], "inner")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])  # a move passed on has no value

    def work(key: tuple, held: pa.Table) -> pa.Table:
        own = sorted(zip(held.column("position").to_pylist(), held.column("value").to_pylist()), key=lambda m: (m[0], m[1] or 0))
        start = sum(p < 0 for p, _ in own)  # tails come as values at position -1
        tails, on = patience_tile([v for _, v in own[:start]], own[start:])
        i, j = key[1].as_py(), key[2].as_py()
        moves = [(i + 1, j, -1, v) for v in tails] + [(i, j + 1, p, None) for p in on]
        names = [n for n in held.column_names if n not in ("i", "j", "position", "value")]
        columns = {n: pa.chunked_array([pa.concat_arrays([held.column(n).slice(0, 1).combine_chunks()] * len(moves))]) if moves else held.column(n).slice(0, 0) for n in names}
        for n, c in zip(("i", "j", "position", "value"), zip(*moves) if moves else ((),) * 4):
            columns[n] = pa.chunked_array([pa.array(c, pa.int64())])
        return pa.table([columns[n] for n in schema.names], names=schema.names)

    def sweep(tiles: DataFrame) -> DataFrame:
        return tiles.groupBy(*tile).applyInArrow(work, schema)

    rounds = last.agg(F.max(F.col("last_i") + F.col("last_j"))).first()[0] + 1
    done, carried = [], None
    rows = stage_table(rows, "order_tiles")
    for r in range(rounds):
        here = rows.where(F.col("i") + F.col("j") == r)
        if carried is not None:
            here = here.unionAll(carried.where(f"i + j = {r}"))
        found = stage_table(sweep(here), "order_tiles")
        done.append(found.where("value IS NOT NULL AND i > last_i").groupBy("__k").agg(F.count("*").alias("n")))
        carried = found.where("i <= last_i AND j <= last_j")
    lengths = reduce(DataFrame.unionAll, done).groupBy("__k").agg(F.sum("n").alias("lcs_length"))
    return lengths.select("__k.*", "lcs_length")


def order_agreement(generated: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per generated sequence: lcs_similarity, position_match_ratio and route_valid against the driven sequence."""
    keys = list(keys)
    known = actual.select("route_id", "stop_id", F.col("position").alias("actual_position"))
    # Written once, as counts, the check for long sequences and the lengths all read it.
    matched = stage_table(generated.select(*keys, "position", "stop_id").join(known, ["route_id", "stop_id"], "left").drop("stop_id"), "matched")
    lengths = actual.groupBy("route_id").agg(F.count("*").alias("stop_count"))
    per = (
        matched.groupBy(*keys)
        .agg(
            F.count("*").alias("__n"),
            F.count_if(F.col("position") == F.col("actual_position")).alias("__same"),
            F.count_distinct("actual_position").alias("__distinct"),
        )
        .join(lengths, "route_id")
    )
    lcs = lcs_lengths(matched.where(F.col("actual_position").isNotNull()).select(*keys, "position", "actual_position"), keys)
    n = F.col("stop_count")
    return null_safe_join(per, lcs, keys, "left").select(
        *keys,
        "stop_count",
        S.ratio(F.coalesce("lcs_length", F.lit(0)), n).alias("lcs_similarity"),
        S.ratio(F.col("__same"), n).alias("position_match_ratio"),
        ((F.col("__n") == n) & (F.col("__distinct") == n)).alias("route_valid"),
    )


def route_metrics(
    generated: DataFrame, actual: DataFrame, travel: Travel, zones: DataFrame, keys: Sequence[str] = ("route_id", "method", "weight_id")
) -> DataFrame:
    """One metric row per generated sequence, with the ratio to the driven route."""
    keys = list(keys)
    made = leg_totals(sequence_legs(generated, keys), travel, zones, keys).withColumnsRenamed(
        {"total_travel_time": "generated_total_travel_time", "same_zone_ratio": "generated_same_zone_ratio"}
    )
    agreed = order_agreement(generated, actual, keys)
    return with_driven(null_safe_join(agreed, made, keys, "left"), driven_totals(actual, travel, zones), keys)


def driven_totals(actual: DataFrame, travel: Travel, zones: DataFrame) -> DataFrame:
    """Travel time and same-zone ratio of the driven routes."""
    return leg_totals(sequence_legs(actual, ["route_id"]), travel, zones, ["route_id"]).select(
        "route_id",
        F.col("total_travel_time").alias("actual_total_travel_time"),
        F.col("same_zone_ratio").alias("actual_same_zone_ratio"),
    )


def with_driven(made: DataFrame, driven: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The figures of generated sequences beside those of the driven routes."""
    actual_time, made_time = F.col("actual_total_travel_time"), F.col("generated_total_travel_time")
    return made.join(driven, "route_id", "left").select(
        *keys,
        "stop_count",
        "actual_total_travel_time",
        "generated_total_travel_time",
        F.when(actual_time > 0, made_time / actual_time).alias("travel_time_ratio_to_actual"),
        "lcs_similarity",
        "position_match_ratio",
        "generated_same_zone_ratio",
        "actual_same_zone_ratio",
        "zone_change_count",
        "route_valid",
    )


def method_summary(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of eight metrics and the valid rate."""
    averaged = (
        "actual_total_travel_time",
        "generated_total_travel_time",
        "travel_time_ratio_to_actual",
        "lcs_similarity",
        "position_match_ratio",
        "generated_same_zone_ratio",
        "actual_same_zone_ratio",
        "zone_change_count",
    )
    return metrics.groupBy(*by).agg(
        F.count("route_id").alias("route_count"),
        *[F.avg(S.finite(F.col(m).cast("double"))).alias(f"avg_{m}") for m in averaged],
        F.avg(F.col("route_valid").cast("double")).alias("valid_route_rate"),
    )


def stops_from_samples(samples: DataFrame) -> DataFrame:
    """Stop attributes rebuilt from pairwise rows: per attribute the first usable value, by decision and rank.

    A stop seen both as current and as candidate takes the candidate's value where it has one.
    """
    order = F.struct("position", "negative_sample_rank", "candidate_stop")

    def usable(name: str, fallback) -> Column:
        text = F.trim(F.col(name).cast("string"))
        good = F.col(name).isNotNull() & ~F.lower(text).isin("", "nan", "none", "null")
        return F.coalesce(F.min_by(F.when(good, F.col(name)), F.when(good, order)), F.lit(fallback))

    shared = {"zone": S.UNKNOWN_ZONE, "type": "", "is_station": 0, "is_dropoff": 0}
    as_current = samples.groupBy("route_id", F.col("current_stop").alias("stop_id")).agg(
        *[usable(f"current_{c}", None).alias(f"__{c}") for c in shared]
    )
    as_candidate = samples.groupBy("route_id", F.col("candidate_stop").alias("stop_id")).agg(
        *[usable(f"candidate_{c}", None).alias(c) for c in shared],
        *[usable(f"candidate_{c}", None).cast("double").alias(c) for c in STOP_FEATURES],
    )
    joined = as_current.join(as_candidate, ["route_id", "stop_id"], "full")
    return joined.select(
        "route_id",
        "stop_id",
        *[F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(v)).alias(c) for c, v in shared.items()],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in STOP_FEATURES],
    )


