"""Route admission, generation, evaluation and weight search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import pairwise_views as PV
from catalog import routing_views as RV
from catalog import views as V
from catalog.registry import query
from routelore.functions import scalars as S
from routelore.operators import joins as J
from routelore.operators import routing as G
from routelore.operators import weights as WT
from routelore.operators.ordering import attach_single_row
from routelore.schemas import WEIGHTS


@query(
    "g0_recorded_split_check",
    """SELECT count(*) FILTER (s.split IS NOT NULL AND s.split <> 'train') AS wrong_split, count(*) FILTER (s.split IS NULL) AS no_split
FROM (SELECT DISTINCT route_id FROM packages) p LEFT JOIN splits s ON p.route_id = s.route_id""",
    "packages", "splits",
)
def g0(spark, d):
    ids = V.packages(spark, d).select("route_id").distinct()
    return J.recorded_split_check(ids, PV.splits(spark, d), "train")


@query(
    "g1_sequence_admission",
    """SELECT r.route_id, coalesce(n, 0) AS stop_count, CASE WHEN coalesce(n, 0) < 2 THEN 'missing_or_short_sequence' WHEN most > 1 THEN 'duplicate_stop_in_sequence' ELSE 'ok' END AS sequence_status
FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS route_id FROM orders) r LEFT JOIN (SELECT route_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS most FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS route_id, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY route_id) s ON r.route_id = s.route_id""",
)
def g1(spark, d):
    ids = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("route_id")).distinct()
    seq = V.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("route_id"), F.col("l_linenumber").cast("string").alias("stop_id"))
    return G.sequence_admission(ids, seq)


query("g2_route_admission", "SELECT * FROM admitted", "admitted")(RV.admitted.lazy)


@query(
    "g2_admission_counts",
    """SELECT count(*) AS route_count_requested, count(*) FILTER (route_status = 'ok') AS route_count_processable,
  count(*) FILTER (route_status IN ('missing_or_short_sequence', 'duplicate_stop_in_sequence')) AS routes_skipped_invalid_sequence,
  count(*) FILTER (route_status = 'missing_source') AS routes_skipped_missing_source, count(*) FILTER (route_status = 'missing_matrix') AS routes_skipped_missing_matrix FROM admitted""",
    "admitted",
)
def g2b(spark, d):
    return G.admission_counts(RV.admitted(spark, d))


FIRST = "(SELECT route_id, 'x' AS method, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS cur, [CAST(0 AS BIGINT)] AS visited FROM members WHERE pos = 0)"


def _first(spark, d):
    decisions, unvisited = G.first_decisions(RV.members(spark, d))
    return G.decision_candidates(decisions, unvisited, RV.chosen_travel(spark, d), ["route_id"])


@query(
    "g3_candidate_features",
    f"""SELECT route_id, step, current_stop, candidate_stop, pos AS actual_position, tt AS travel_time, travel_time_ij, same_zone, zone_changed, zone_missing_in_pair,
  CAST(number_of_stops AS DOUBLE) AS number_of_stops, CAST(remaining_stop_count AS DOUBLE) AS remaining_stop_count, candidate_package_count, candidate_has_time_window,
  travel_norm, zone_penalty, time_window_risk, workload_norm FROM ({RV.candidates_sql(FIRST)})""",
    "members", "chosen_edges",
)
def g3(spark, d):
    return _first(spark, d).select(
        "route_id", "step", "current_stop", "candidate_stop", "actual_position", "travel_time", "travel_time_ij", "same_zone", "zone_changed",
        "zone_missing_in_pair", "number_of_stops", "remaining_stop_count", "candidate_package_count", "candidate_has_time_window", "travel_norm",
        "zone_penalty", "time_window_risk", "workload_norm",
    )


@query(
    "g4_next_stop_by_method",
    f"""SELECT route_id, t.method, count(*) AS candidate_count, arg_min(candidate_stop, [CASE t.method WHEN '{G.NEAREST}' THEN coalesce(tt, 1e300::DOUBLE) WHEN '{G.PREFERENCE}' THEN -p ELSE {RV.COST} END, CAST(pos AS DOUBLE)]) AS candidate_stop
FROM ({RV.candidates_sql(FIRST)}), (VALUES ('{G.NEAREST}'), ('{G.PREFERENCE}'), ('{G.HYBRID}')) t(method) GROUP BY ALL""",
    "members", "chosen_edges",
)
def g4(spark, d):
    costed = G.with_costs(_first(spark, d), RV.SCORER.column(), RV.BEST)
    methods = F.array(*[F.lit(m) for m in (G.NEAREST, G.PREFERENCE, G.HYBRID)])
    rows = costed.withColumn("method", F.explode(methods))
    return G.choose_next(rows, ["route_id", "method"], F.col("method")).select("route_id", "method", "candidate_count", "candidate_stop")


query("g5_greedy_routes", "SELECT * FROM steps", "steps", recursive=True)(lambda spark, d: RV.steps.lazy(spark, d).drop("plans_sharing"))


@query(
    "s8_generated_route_rows",
    "SELECT h.split, s.route_id, s.method, s.position, s.stop_id FROM steps s JOIN (SELECT route_id, split FROM members WHERE pos = 0) h ON s.route_id = h.route_id",
    "steps", "members", recursive=True,
)
def s8(spark, d):
    header = RV.members(spark, d).where("position = 0").select("route_id", "split")
    return RV.steps(spark, d).join(header, "route_id").select("split", "route_id", "method", "position", "stop_id")


@query("g6_actual_route_totals", "SELECT route_id, total_travel_time, same_zone_ratio, zone_change_count FROM driven_legs", "driven_legs")
def g6(spark, d):
    legs = G.sequence_legs(RV.actual(spark, d), ["route_id"])
    return G.leg_totals(legs, RV.chosen_travel(spark, d), RV.zones(spark, d), ["route_id"])


KEYS = ["route_id", "method", "weight_id"]


@query("g7_order_agreement", "SELECT * FROM agreement", "agreement", recursive=True)
def g7(spark, d):
    return G.order_agreement(RV.steps(spark, d), RV.actual(spark, d), KEYS)


@query("g9_generated_leg_totals", "SELECT * FROM made_legs", "made_legs", recursive=True)
def g9(spark, d):
    return G.leg_totals(G.sequence_legs(RV.steps(spark, d), KEYS), RV.chosen_travel(spark, d), RV.zones(spark, d), KEYS)


query("g11_route_metrics", "SELECT * FROM metrics", "metrics", recursive=True)(RV.metrics.lazy)


@query("g12_method_summary", RV.summary_sql("metrics", "split, method"), "metrics", recursive=True)
def g12(spark, d):
    return G.method_summary(RV.metrics(spark, d), ["split", "method"])


@query("g15_weight_search")
def g15(spark, d):
    """300 vectors of the 0.05 grid on all admitted routes, averaged, scored and ranked."""
    grid = WT.weight_grid(spark, 0.05, 300)
    members = RV.members(spark, d)
    evaluated = WT.evaluate_weights(members, RV.chosen_travel(spark, d), grid, RV.SCORER, RV.actual(spark, d))
    return WT.weight_results(evaluated)


@query("g16_weight_results", "SELECT * FROM results", "results")
def g16(spark, d):
    return WT.weight_results(RV.trials(spark, d))


@query(
    "g17_baseline_metrics",
    f"""SELECT route_id, method, weight_id, lcs_similarity FROM metrics WHERE method IN ('{G.NEAREST}', '{G.PREFERENCE}')
UNION ALL SELECT route_id, '{G.BEST_LABEL}', weight_id, lcs_similarity FROM trials WHERE weight_id = (SELECT weight_id FROM results WHERE rank = 1)""",
    "metrics", "trials", "results", recursive=True,
)
def g17(spark, d):
    out = WT.baseline_metrics(RV.metrics(spark, d), RV.trials(spark, d), WT.best_weights(RV.results(spark, d)))
    return out.select("route_id", "method", "weight_id", "lcs_similarity")


@query(
    "s15_best_weight_row",
    f"SELECT weight_id, {', '.join(WEIGHTS)}, rank FROM results WHERE rank = 1",
    "results",
)
def s15(spark, d):
    return WT.best_weights(RV.results(spark, d)).select("weight_id", *WEIGHTS, "rank")


_first_value = "arg_min(CASE WHEN {c} IS NOT NULL AND lower(trim(CAST({c} AS VARCHAR))) NOT IN ('', 'nan', 'none', 'null') THEN {c} END, CASE WHEN {c} IS NOT NULL AND lower(trim(CAST({c} AS VARCHAR))) NOT IN ('', 'nan', 'none', 'null') THEN o END)"
_shared = {"zone": "'UNKNOWN_ZONE'", "type": "''", "is_station": "0", "is_dropoff": "0"}


@query(
    "g19_stops_from_samples",
    f"""SELECT coalesce(a.route_id, b.route_id) AS route_id, coalesce(a.stop_id, b.stop_id) AS stop_id, {', '.join(f'coalesce(b.{c}, a.{c}, {v}) AS {c}' for c, v in _shared.items())},
  {', '.join(f'coalesce(b.{c}, 0.0) AS {c}' for c in G.STOP_FEATURES)}
FROM (SELECT route_id, current_stop AS stop_id, {', '.join(_first_value.format(c='current_' + c) + ' AS ' + c for c in _shared)} FROM (SELECT *, lpad(CAST(position AS VARCHAR), 9, '0') || lpad(CAST(negative_sample_rank AS VARCHAR), 3, '0') || candidate_stop AS o FROM samples) GROUP BY ALL) a
FULL JOIN (SELECT route_id, candidate_stop AS stop_id, {', '.join(_first_value.format(c='candidate_' + c) + ' AS ' + c for c in _shared)},
  {', '.join('CAST(' + _first_value.format(c='candidate_' + c) + ' AS DOUBLE) AS ' + c for c in G.STOP_FEATURES)} FROM (SELECT *, lpad(CAST(position AS VARCHAR), 9, '0') || lpad(CAST(negative_sample_rank AS VARCHAR), 3, '0') || candidate_stop AS o FROM samples) GROUP BY ALL) b
ON a.route_id = b.route_id AND a.stop_id = b.stop_id""",
    "samples",
)
def g19(spark, d):
    return G.stops_from_samples(PV.samples(spark, d))


_terms = ("travel_norm", "1.0::DOUBLE - p", "zone_penalty", "time_window_risk", "workload_norm")
_parts = ", ".join(f"avg({c}) AS c{i}" for i, c in enumerate(_terms))
_grid = "SELECT a, b, c, e, 20 - a - b - c - e AS f FROM " + ", ".join(f"(SELECT unnest(range(21)) AS {x})" for x in "abce") + " WHERE a + b + c + e <= 20"


@query(
    "g13_grid_mean_costs",
    f"""SELECT {', '.join(f'round({x} / 20.0::DOUBLE, 10) AS {w}' for x, w in zip("abcef", WEIGHTS))}, {' + '.join(f'round({x} / 20.0::DOUBLE, 10) * c{i}' for i, x in enumerate("abcef"))} AS mean_cost
FROM ({_grid}), (SELECT {_parts} FROM ({RV.candidates_sql(FIRST)}))""",
    "members", "chosen_edges",
)
def g13(spark, d):
    """Every vector of the weight grid with the mean cost that it gives the first decisions' candidates."""
    scored = G.with_costs(_first(spark, d), RV.SCORER.column(), [0.2] * 5)
    means = scored.agg(*[F.avg(c).alias(c) for c in G.COMPONENTS])
    grid = attach_single_row(WT.full_grid(spark, 0.05), means)
    return grid.select(*WEIGHTS, S.weighted_cost([F.col(c) for c in G.COMPONENTS], [F.col(w) for w in WEIGHTS]).alias("mean_cost"))
