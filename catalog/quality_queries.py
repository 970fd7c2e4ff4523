"""Join, quality and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import coverage_views as CV
from catalog import views as V
from catalog.registry import cte, lazy_view, query
from routelore.operators import coverage as K
from routelore.operators import joins as J
from routelore.operators import ordering as O
from routelore.operators import quality as Q


@query(
    "j1_route_left_chain",
    """SELECT r.route_id, r.route_score, q.can_use_for_training, c.transition_count, s.travel_time_source FROM routes r
LEFT JOIN quality q ON r.route_id = q.route_id LEFT JOIN completeness c ON r.route_id = c.route_id
LEFT JOIN lookup s ON r.route_id = s.route_id""",
    "routes", "quality", "completeness", "lookup",
)
def j1(spark, d):
    return J.left_chain(
        V.routes(spark, d).select("route_id", "route_score"),
        [
            V.quality(spark, d).select("route_id", "can_use_for_training"),
            CV.completeness(spark, d).select("route_id", "transition_count"),
            CV.lookup(spark, d).select("route_id", "travel_time_source"),
        ],
    )


@query(
    "j2_stop_packages_zero_filled",
    """SELECT s.route_id, s.stop_id, s.type, coalesce(p.package_count, 0) AS package_count,
  coalesce(p.total_package_volume_cm3, 0) AS total_package_volume_cm3
FROM stops s LEFT JOIN packages p ON s.route_id = p.route_id AND s.stop_id = p.stop_id""",
    "stops", "packages",
)
def j2(spark, d):
    cols = ["package_count", "total_package_volume_cm3"]
    right = V.packages(spark, d).select("route_id", "stop_id", *cols)
    return J.left_lookup(V.stops(spark, d).select("route_id", "stop_id", "type"), right, ["route_id", "stop_id"], cols)


@query(
    "j3_stop_roles",
    """SELECT t.route_id, t.from_stop, t.to_stop, t.position, f.zone_id AS from_zone, f.type AS from_type, g.zone_id AS to_zone, g.type AS to_type
FROM transitions t LEFT JOIN stops f ON t.route_id = f.route_id AND t.from_stop = f.stop_id
LEFT JOIN stops g ON t.route_id = g.route_id AND t.to_stop = g.stop_id""",
    "transitions", "stops",
)
def j3(spark, d):
    return J.with_stop_roles(V.transitions(spark, d).drop("label"), V.stops(spark, d))


@query(
    "j4_unmatched_counts",
    """SELECT (SELECT count(*) FROM transitions t WHERE NOT EXISTS (SELECT 1 FROM packages p WHERE p.route_id = t.route_id AND p.stop_id = t.from_stop)) AS from_without_packages,
  (SELECT count(*) FROM transitions t WHERE NOT EXISTS (SELECT 1 FROM packages p WHERE p.route_id = t.route_id AND p.stop_id = t.to_stop)) AS to_without_packages""",
    "transitions", "packages",
)
def j4(spark, d):
    t, p = V.transitions(spark, d), V.packages(spark, d)
    return O.side_by_side(
        J.count_unmatched(t, p, {"route_id": "route_id", "from_stop": "stop_id"}, "from_without_packages"),
        J.count_unmatched(t, p, {"route_id": "route_id", "to_stop": "stop_id"}, "to_without_packages"),
    )


@query(
    "j5_route_key_sets",
    """SELECT count(*) FILTER (a AND NOT b) AS missing_count, count(*) FILTER (b AND NOT a) AS extra_count, count(*) FILTER (a AND b) AS overlap_count FROM (
SELECT coalesce(r.route_id, p.route_id) AS id, r.route_id IS NOT NULL AS a, p.route_id IS NOT NULL AS b
FROM (SELECT DISTINCT route_id FROM routes) r FULL JOIN (SELECT DISTINCT route_id FROM packages) p ON r.route_id = p.route_id)""",
    "routes", "packages",
)
def j5(spark, d):
    return J.compare_key_sets(V.routes(spark, d), V.packages(spark, d), "route_id")


query("j6_edge_lookup", "SELECT * FROM build_detail", "build_detail")(CV.build_detail)
query("j7_missing_side_kept", "SELECT * FROM detail", "detail")(CV.travel_detail.lazy)


@query(
    "j8_semi_join_usable",
    "SELECT * FROM transitions WHERE route_id IN (SELECT route_id FROM quality WHERE can_use_for_training)",
    "transitions", "quality",
)
def j8(spark, d):
    return J.keep_ids(V.transitions(spark, d), V.quality(spark, d).where("can_use_for_training"))


@lazy_view
def sequence(spark, d):
    from routelore.operators.pairwise import stop_sequence

    return stop_sequence(V.transitions(spark, d))


@query(
    "j9_candidate_ranges",
    """SELECT route_id, position, stop_id AS current_stop, CASE WHEN position + 2 < n THEN position + 2 END AS first_candidate_position,
  CASE WHEN position + 2 < n THEN n - 1 END AS last_candidate_position, greatest(0, n - position - 2) AS candidate_count
FROM sequence WHERE n >= 2""",
    "sequence",
)
def j9(spark, d):
    return J.candidate_ranges(sequence(spark, d), 2)


@query(
    "j11_outer_join_prefixed",
    """SELECT coalesce(a.route_id, b.route_id) AS route_id, a.n AS stops_n, b.n AS packages_n FROM
(SELECT route_id, count(*) AS n FROM stops GROUP BY route_id) a FULL JOIN
(SELECT route_id, count(*) AS n FROM packages GROUP BY route_id) b ON a.route_id = b.route_id""",
    "stops", "packages",
)
def j11(spark, d):
    a = V.stops(spark, d).groupBy("route_id").agg(F.count("*").alias("n"))
    b = V.packages(spark, d).groupBy("route_id").agg(F.count("*").alias("n"))
    return J.outer_join_prefixed(a, b, "route_id", ("stops", "packages"))


@query(
    "j12_first_row_per_key",
    """SELECT route_id, stop_id, package_id, scan_status FROM raw_packages
QUALIFY row_number() OVER (PARTITION BY route_id, stop_id ORDER BY package_id, coalesce(scan_status, ''), start_time_utc) = 1""",
    "raw_packages",
)
def j12(spark, d):
    rows = V.raw_packages(spark, d).select("route_id", "stop_id", "package_id", "scan_status", "start_time_utc")
    order = F.struct("package_id", F.coalesce("scan_status", F.lit("")), "start_time_utc")
    return J.first_per_key(rows, ["route_id", "stop_id"], order).drop("start_time_utc")


@query(
    "j13_nearest_vectors",
    """SELECT t.name AS target_name, target_l_discount, target_l_tax, round(abs(l_discount - target_l_discount) + abs(l_tax - target_l_tax), 10) AS target_l1_distance,
  round(greatest(abs(l_discount - target_l_discount), abs(l_tax - target_l_tax)), 10) AS target_max_abs_distance, l_discount, l_tax, n, first_key
FROM (VALUES ('low', 0.013::DOUBLE, 0.021::DOUBLE), ('high', 0.097::DOUBLE, 0.064::DOUBLE)) t(name, target_l_discount, target_l_tax),
  (SELECT l_discount, l_tax, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_key FROM lineitem GROUP BY ALL) g
QUALIFY row_number() OVER (PARTITION BY t.name ORDER BY round(abs(l_discount - target_l_discount) + abs(l_tax - target_l_tax), 10),
  round(greatest(abs(l_discount - target_l_discount), abs(l_tax - target_l_tax)), 10), first_key) = 1""",
)
def j13(spark, d):
    grid = (
        V.table(spark, d, "lineitem")
        .groupBy("l_discount", "l_tax")
        .agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_key"))
    )
    targets = [("low", {"l_discount": 0.013, "l_tax": 0.021}), ("high", {"l_discount": 0.097, "l_tax": 0.064})]
    return J.nearest_vectors(grid, targets, "first_key")


@query(
    "j14_chosen_source",
    """SELECT route_id, travel_time_source, source AS first_found,
  CASE WHEN travel_time_source = 'multiple_sources' THEN 'training_build' ELSE source END AS build_first FROM chosen""",
    "chosen",
)
def j14(spark, d):
    lookup = CV.lookup(spark, d)
    return lookup.select(
        "route_id",
        "travel_time_source",
        J.choose_source(lookup).alias("first_found"),
        J.choose_source(lookup, "build_first").alias("build_first"),
    )


# ---- quality reports --------------------------------------------------------------------------------------------
@query(
    "q1_dataset_consistency",
    """SELECT (SELECT count(*) FROM routes) AS total_routes_in_routes_summary, (SELECT count(*) FROM quality) AS total_routes_in_quality_report,
  (SELECT count(*) FROM stops) AS total_stops, (SELECT count(*) FROM packages) AS total_package_stop_rows,
  (SELECT count(*) FROM transitions) AS total_actual_transitions,
  (SELECT count(*) FROM (SELECT route_id FROM routes EXCEPT SELECT route_id FROM quality)) AS routes_missing_from_quality_report,
  (SELECT count(*) FROM (SELECT route_id, stop_id FROM stops EXCEPT SELECT route_id, stop_id FROM packages)) AS stops_without_package_feature_count,
  (SELECT count(*) FROM (SELECT route_id, stop_id FROM packages EXCEPT SELECT route_id, stop_id FROM stops)) AS package_features_without_stop_count,
  (SELECT count(*) FROM transitions t WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.route_id = t.route_id AND s.stop_id = t.from_stop)) AS transitions_with_missing_from_stop_count,
  (SELECT count(*) FROM transitions t WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.route_id = t.route_id AND s.stop_id = t.to_stop)) AS transitions_with_missing_to_stop_count""",
    "routes", "quality", "stops", "packages", "transitions",
)
def q1(spark, d):
    return Q.dataset_consistency(*[getattr(V, n)(spark, d) for n in ("routes", "stops", "transitions", "packages", "quality")])


@query(
    "q2_route_validity",
    """SELECT count(*) AS total_routes, count(*) FILTER (route_exists_in_actual_sequences) AS routes_with_actual_sequence,
  count(*) FILTER (route_stop_count = sequence_stop_count) AS routes_with_matching_stop_count,
  count(*) FILTER (sequence_matches_route_stops) AS routes_with_matching_stop_ids, count(*) FILTER (has_single_station) AS routes_with_single_station,
  count(*) FILTER (can_use_for_training) AS routes_can_use_for_training, count(*) FILTER (NOT can_use_for_training) AS routes_not_usable_for_training,
  100.0 * count(*) FILTER (can_use_for_training) / count(*) AS usable_route_percentage FROM quality""",
    "quality",
)
def q2(spark, d):
    return Q.route_validity(V.quality(spark, d))


@query(
    "q3_unusable_route_reasons",
    """SELECT q.route_id, r.route_score, q.route_stop_count, q.sequence_stop_count, q.number_of_station_stops, q.has_single_station, q.sequence_matches_route_stops,
  CASE WHEN NOT route_exists_in_actual_sequences THEN 'missing_actual_sequence' WHEN route_stop_count <> sequence_stop_count THEN 'stop_count_mismatch'
    WHEN NOT sequence_matches_route_stops THEN 'stop_id_mismatch' WHEN q.number_of_station_stops = 0 THEN 'no_station'
    WHEN q.number_of_station_stops > 1 THEN 'multiple_stations' ELSE 'other' END AS reason_not_usable
FROM quality q LEFT JOIN routes r ON q.route_id = r.route_id WHERE NOT can_use_for_training""",
    "quality", "routes",
)
def q3(spark, d):
    return Q.unusable_routes(V.quality(spark, d), V.routes(spark, d))


def outlier_sql(table: str, cols, extremes: bool) -> str:
    parts = []
    for c in cols:
        more = (
            f""", count(*) FILTER (v = 0) AS zero_value_count, 100.0 * count(*) FILTER (v = 0) / count(v) AS zero_value_percentage,
  count(*) FILTER (v > p99) AS extreme_high_value_count, max(p99) AS extreme_high_threshold_p99"""
            if extremes
            else ""
        )
        parts.append(
            f"""SELECT '{c}' AS feature, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
  max(p01) AS p01, max(p05) AS p05, max(p25) AS p25, max(p50) AS p50, max(p75) AS p75, max(p95) AS p95, max(p99) AS p99,
  max(p25 - 1.5 * (p75 - p25)) AS lower_bound, max(p75 + 1.5 * (p75 - p25)) AS upper_bound,
  count(*) FILTER (v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25)) AS outlier_count,
  100.0 * count(*) FILTER (v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25)) / count(v) AS outlier_percentage{more}
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table}),
  (SELECT {', '.join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {n}" for n, p in Q.OUTLIER_QUANTILES.items())} FROM {table})"""
        )
    return "\nUNION ALL ".join(parts)


@query("q4_route_outlier_summary", outlier_sql("routes", Q.ROUTE_OUTLIER_COLUMNS, False), "routes")
def q4a(spark, d):
    return Q.outlier_summary(V.routes(spark, d), Q.ROUTE_OUTLIER_COLUMNS)


@query("q4_package_outlier_summary", outlier_sql("packages", Q.PACKAGE_OUTLIER_COLUMNS, True), "packages")
def q4b(spark, d):
    return Q.outlier_summary(V.packages(spark, d), Q.PACKAGE_OUTLIER_COLUMNS, extremes=True)


def flags_sql(table: str, keys: str, cols) -> str:
    flags = ", ".join(f"CASE WHEN {c} < b_{c}[1] - 1.5 * (b_{c}[2] - b_{c}[1]) OR {c} > b_{c}[2] + 1.5 * (b_{c}[2] - b_{c}[1]) THEN '{c}' END" for c in cols)
    bounds = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS b_{c}" for c in cols)
    return f"SELECT {keys}, concat_ws(';', {flags}) AS outlier_flags FROM {table}, (SELECT {bounds} FROM {table})"


@query("q5_route_outlier_flags", flags_sql("routes", "route_id", Q.ROUTE_OUTLIER_COLUMNS), "routes")
def q5a(spark, d):
    return Q.with_outlier_flags(V.routes(spark, d), Q.ROUTE_OUTLIER_COLUMNS).select("route_id", "outlier_flags")


@query("q5_package_outlier_flags", flags_sql("packages", "route_id, stop_id", Q.PACKAGE_OUTLIER_COLUMNS), "packages")
def q5b(spark, d):
    flagged = Q.with_outlier_flags(V.packages(spark, d), Q.PACKAGE_OUTLIER_COLUMNS)
    return flagged.select("route_id", "stop_id", "outlier_flags")


@lazy_view
def station_check(spark, d):
    return Q.station_sequence_check(V.routes(spark, d), V.quality(spark, d), V.transitions(spark, d))


cte(
    "station_check",
    """SELECT r.route_id, r.station_stop_id, r.number_of_station_stops, q.has_single_station, t.first_stop AS first_stop_in_actual_sequence,
  r.station_stop_id IS NOT DISTINCT FROM t.first_stop AS station_is_first_stop, coalesce(t.n, 0) AS transition_count,
  greatest(r.number_of_stops - 1, 0) AS expected_transition_count, coalesce(t.n, 0) = greatest(r.number_of_stops - 1, 0) AS transition_count_matches_expected
FROM routes r LEFT JOIN quality q ON r.route_id = q.route_id LEFT JOIN (SELECT route_id, count(*) AS n, arg_min(from_stop, position) AS first_stop
  FROM transitions GROUP BY route_id) t ON r.route_id = t.route_id""",
    "routes", "quality", "transitions",
)
query("q6_station_sequence_check", "SELECT * FROM station_check", "station_check")(station_check)


@lazy_view
def dropoff_check(spark, d):
    return Q.dropoff_package_check(V.stops(spark, d), V.packages(spark, d))


cte(
    "dropoff_check",
    """SELECT route_id, count(*) FILTER (k = 'dropoff') AS total_dropoff_stops, count(*) FILTER (k = 'dropoff' AND n = 0) AS dropoff_stops_with_zero_packages,
  count(*) FILTER (k = 'station' AND n > 0) AS station_stops_with_packages, CAST(coalesce(sum(n) FILTER (k = 'station'), 0) AS DOUBLE) AS station_package_count,
  CASE WHEN count(*) FILTER (k = 'dropoff') = 0 THEN 0.0 ELSE CAST(count(*) FILTER (k = 'dropoff' AND n = 0) AS DOUBLE) / count(*) FILTER (k = 'dropoff') END AS dropoff_zero_package_ratio
FROM (SELECT s.route_id, lower(s.type) AS k, coalesce(p.package_count, 0) AS n FROM stops s LEFT JOIN packages p
  ON s.route_id = p.route_id AND s.stop_id = p.stop_id) GROUP BY route_id""",
    "stops", "packages",
)
query("q7_dropoff_package_check", "SELECT * FROM dropoff_check", "dropoff_check")(dropoff_check)


@query(
    "q7_zero_package_dropoffs",
    """SELECT s.route_id, s.stop_id, s.type, coalesce(p.package_count, 0) AS package_count FROM stops s LEFT JOIN packages p
  ON s.route_id = p.route_id AND s.stop_id = p.stop_id WHERE lower(s.type) = 'dropoff' AND coalesce(p.package_count, 0) = 0""",
    "stops", "packages",
)
def q7b(spark, d):
    return Q.zero_package_dropoffs(V.stops(spark, d), V.packages(spark, d))


def reliability_sql() -> str:
    rows = []
    for name, field, counted, handling, limit, fixed, why in Q.RELIABILITY_RULES:
        pick = "coalesce((SELECT {} FROM missing WHERE field = '" + str(field) + "'), 0)"
        m = pick.format("missing_count") if field else "0"
        t = pick.format("total_count") if field else f"(SELECT count(*) FROM {counted})"
        r = pick.format("missing_ratio") if field else "0.0"
        core = str(fixed).lower() if limit is None else f"{r} <= {limit}"
        rows.append(
            f"SELECT '{name}' AS feature_name, CAST({m} AS BIGINT) AS missing_count, CAST({t} AS BIGINT) AS total_count, "
            f"CAST({r} AS DOUBLE) AS missing_ratio, '{handling}' AS proposed_handling, {core} AS use_as_core_feature, '{why}' AS explanation"
        )
    return "\nUNION ALL ".join(rows)


@query("q8_feature_reliability", reliability_sql(), "missing", "stops", "packages")
def q8(spark, d):
    return Q.feature_reliability(V.missing(spark, d), V.stops(spark, d), V.packages(spark, d))


@query("q9_single_source_completeness", "SELECT * FROM build_completeness", "build_completeness")
def q9b(spark, d):
    return K.single_source_completeness(CV.build_detail(spark, d))


STATS_SQL = """coalesce(avg(travel_time_ij), 0.0) AS average_actual_transition_travel_time, coalesce(quantile_cont(travel_time_ij, 0.5), 0.0) AS median_actual_transition_travel_time,
  coalesce(quantile_cont(travel_time_ij, 0.95), 0.0) AS p95_actual_transition_travel_time, coalesce(max(travel_time_ij), 0.0) AS max_actual_transition_travel_time"""


@query(
    "q9_single_source_summary",
    f"""SELECT count(*) AS total_actual_transitions_checked, count(travel_time_ij) AS transitions_with_travel_time,
  count(*) - count(travel_time_ij) AS transitions_missing_travel_time, CAST(count(*) - count(travel_time_ij) AS DOUBLE) / count(*) AS missing_travel_time_ratio,
  (SELECT count(*) FROM build_completeness WHERE missing_travel_time_count > 0) AS routes_with_any_missing_travel_time,
  (SELECT count(*) FROM build_completeness WHERE missing_travel_time_count = 0) AS routes_with_complete_actual_transition_travel_time, {STATS_SQL} FROM build_detail""",
    "build_detail", "build_completeness",
)
def q9c(spark, d):
    return K.single_source_summary(CV.build_detail(spark, d))


@lazy_view
def ready(spark, d):
    return Q.training_ready_routes(
        V.routes(spark, d),
        V.quality(spark, d),
        station_check(spark, d),
        CV.completeness(spark, d),
        V.routes(spark, d),
        dropoff_check(spark, d),
    )


cte(
    "ready",
    """SELECT *, can_use_for_training_original AND has_single_station AND sequence_matches_route_stops AND station_is_first_stop
  AND transition_count_matches_expected AND has_complete_actual_transition_travel_time AS recommended_for_training,
  concat_ws(';', CASE WHEN NOT can_use_for_training_original THEN 'first_round_not_usable' END, CASE WHEN NOT has_single_station THEN 'station_count_issue' END,
    CASE WHEN NOT sequence_matches_route_stops THEN 'stop_id_mismatch' END, CASE WHEN NOT station_is_first_stop THEN 'station_not_first_stop' END,
    CASE WHEN NOT transition_count_matches_expected THEN 'transition_count_mismatch' END,
    CASE WHEN NOT has_complete_actual_transition_travel_time THEN 'missing_actual_transition_travel_time' END,
    CASE WHEN severe_route_outlier THEN 'severe_route_outlier_flag' END, CASE WHEN severe_package_issue THEN 'zero_package_dropoff_flag' END) AS exclusion_reason
FROM (SELECT r.route_id, r.route_score, q.can_use_for_training AS can_use_for_training_original, q.has_single_station, q.sequence_matches_route_stops,
  s.station_is_first_stop, s.transition_count_matches_expected,
  coalesce(c.has_complete_actual_transition_travel_time, false) AS has_complete_actual_transition_travel_time,
  r.number_of_stops < 2 OR r.missing_zone_ratio >= 1 AS severe_route_outlier, coalesce(k.dropoff_stops_with_zero_packages, 0) > 0 AS severe_package_issue
FROM routes r LEFT JOIN quality q ON r.route_id = q.route_id LEFT JOIN station_check s ON r.route_id = s.route_id
LEFT JOIN completeness c ON r.route_id = c.route_id LEFT JOIN dropoff_check k ON r.route_id = k.route_id)""",
    "routes", "quality", "station_check", "completeness", "dropoff_check",
)
query("q10_training_ready_routes", "SELECT * FROM ready", "ready")(ready)
query("q11_source_lookup", "SELECT * FROM lookup", "lookup")(CV.lookup.lazy)
query("q12_multi_source_completeness", "SELECT * FROM completeness", "completeness")(CV.completeness)


@query(
    "q12_multi_source_integrity",
    f"""SELECT (SELECT count(*) FROM lookup) AS total_routes_checked, (SELECT count(*) FROM lookup WHERE found_in_training_build) AS routes_found_in_training_build,
  (SELECT count(*) FROM lookup WHERE found_in_training_apply) AS routes_found_in_training_apply,
  (SELECT count(*) FROM lookup WHERE found_in_evaluation_apply) AS routes_found_in_evaluation_apply,
  (SELECT count(*) FROM lookup WHERE source_count = 0) AS routes_missing_from_all_sources, (SELECT count(*) FROM lookup WHERE source_count > 1) AS routes_in_multiple_sources,
  count(*) AS total_actual_transitions_checked, count(travel_time_ij) AS transitions_with_travel_time, count(*) - count(travel_time_ij) AS transitions_missing_travel_time,
  CAST(count(*) - count(travel_time_ij) AS DOUBLE) / count(*) AS missing_travel_time_ratio,
  (SELECT count(*) FROM completeness WHERE has_complete_actual_transition_travel_time) AS routes_with_complete_actual_transition_travel_time,
  (SELECT count(*) FROM completeness WHERE NOT has_complete_actual_transition_travel_time) AS routes_with_any_missing_travel_time, {STATS_SQL} FROM detail""",
    "lookup", "completeness", "detail",
)
def q12b(spark, d):
    return K.multi_source_integrity(CV.lookup(spark, d), CV.travel_detail(spark, d))


@query(
    "q12_source_transition_summary",
    """SELECT l.label AS travel_time_source, count(c.route_id) AS route_count, CAST(coalesce(sum(transition_count), 0) AS BIGINT) AS transition_count,
  CAST(coalesce(sum(transitions_with_travel_time), 0) AS BIGINT) AS transitions_with_travel_time,
  CAST(coalesce(sum(transitions_missing_travel_time), 0) AS BIGINT) AS transitions_missing_travel_time,
  CAST(coalesce(CAST(sum(transitions_missing_travel_time) AS DOUBLE) / sum(transition_count), 0.0) AS DOUBLE) AS missing_travel_time_ratio
FROM (VALUES ('training_build'), ('training_apply'), ('evaluation_apply'), ('multiple_sources'), ('missing_source')) l(label)
LEFT JOIN completeness c ON c.travel_time_source = l.label GROUP BY l.label""",
    "completeness",
)
def q12c(spark, d):
    return K.source_transition_summary(CV.completeness(spark, d))


@query(
    "q13_complete_route_transitions",
    "SELECT * FROM detail WHERE travel_time_missing = 0 AND route_id IN (SELECT route_id FROM completeness WHERE has_complete_actual_transition_travel_time)",
    "detail", "completeness",
)
def q13(spark, d):
    detail = CV.travel_detail(spark, d)
    return K.complete_route_transitions(detail, K.complete_routes(K.multi_source_completeness(detail)))


@query(
    "q30_quality_closing_summary",
    """SELECT (SELECT count(*) FROM ready) AS total_routes, (SELECT count(*) FROM ready WHERE recommended_for_training) AS recommended_training_ready_routes,
  (SELECT missing_ratio FROM missing WHERE field = 'zone_id') AS zone_id_missing_ratio, (SELECT missing_ratio FROM missing WHERE field = 'planned_service_time') AS planned_service_time_missing_ratio,
  (SELECT missing_ratio FROM missing WHERE field = 'package_dimensions') AS package_dimensions_missing_ratio, (SELECT missing_ratio FROM missing WHERE field = 'scan_status') AS scan_status_missing_ratio,
  (SELECT CAST(sum(travel_time_missing) AS DOUBLE) / count(*) FROM detail) AS travel_time_missing_ratio,
  (SELECT count(*) FROM station_check WHERE NOT station_is_first_stop) AS routes_station_not_first,
  (SELECT count(*) FROM station_check WHERE NOT transition_count_matches_expected) AS routes_with_transition_count_mismatch,
  (SELECT count(*) FROM dropoff_check WHERE dropoff_stops_with_zero_packages > 0) AS routes_with_zero_package_dropoffs""",
    "ready", "missing", "detail", "station_check", "dropoff_check",
)
def q30(spark, d):
    return Q.quality_closing_summary(
        V.missing(spark, d), station_check(spark, d), dropoff_check(spark, d), ready(spark, d), CV.travel_detail(spark, d)
    )
