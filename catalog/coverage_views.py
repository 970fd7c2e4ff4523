"""Travel-time coverage tables over the domain views."""

from __future__ import annotations

from catalog import views as V
from catalog.registry import cte, lazy_view, staged_view
from routelore.operators import coverage as K
from routelore.operators import features as X
from routelore.operators.travel import of_source


@staged_view
def lookup(spark, d):
    return K.source_lookup(V.transitions(spark, d), V.travel(spark, d))


cte(
    "lookup",
    """SELECT route_id, b AS found_in_training_build, a AS found_in_training_apply, v AS found_in_evaluation_apply,
  CASE n WHEN 0 THEN 'missing_source' WHEN 1 THEN CASE WHEN b THEN 'training_build' WHEN a THEN 'training_apply' ELSE 'evaluation_apply' END
    ELSE 'multiple_sources' END AS travel_time_source, n AS source_count,
  CASE n WHEN 0 THEN 'route_missing_from_all_travel_time_sources' WHEN 1 THEN 'ok_single_source'
    ELSE 'duplicate_route_in_multiple_sources' END AS source_status
FROM (SELECT t.route_id, coalesce(bool_or(source = 'training_build'), false) AS b, coalesce(bool_or(source = 'training_apply'), false) AS a,
  coalesce(bool_or(source = 'evaluation_apply'), false) AS v, count(DISTINCT source) AS n
  FROM (SELECT DISTINCT route_id FROM transitions) t LEFT JOIN edge_sources e ON t.route_id = e.route_id GROUP BY t.route_id)""",
    "transitions",
    "edge_sources",
)


@staged_view
def travel_detail(spark, d):
    return K.multi_source_detail(V.transitions(spark, d), V.travel(spark, d), lookup(spark, d))


cte(
    "chosen",
    """SELECT *, CASE WHEN found_in_training_build THEN 'training_build' WHEN found_in_training_apply THEN 'training_apply'
  WHEN found_in_evaluation_apply THEN 'evaluation_apply' END AS source FROM lookup""",
    "lookup",
)
cte(
    "detail",
    """SELECT t.route_id, t.from_stop, t.to_stop, t.position, e.travel_time AS travel_time_ij,
  CAST(e.travel_time IS NULL AS BIGINT) AS travel_time_missing, c.travel_time_source
FROM transitions t JOIN chosen c ON t.route_id = c.route_id LEFT JOIN edges e
  ON t.route_id = e.route_id AND t.from_stop = e.from_stop AND t.to_stop = e.to_stop AND e.source = c.source""",
    "transitions",
    "chosen",
    "edges",
)


@lazy_view
def completeness(spark, d):
    return K.multi_source_completeness(travel_detail(spark, d))


cte(
    "completeness",
    """SELECT route_id, travel_time_source, count(*) AS transition_count, count(travel_time_ij) AS transitions_with_travel_time,
  CAST(sum(travel_time_missing) AS BIGINT) AS transitions_missing_travel_time,
  CAST(sum(travel_time_missing) AS DOUBLE) / count(*) AS missing_travel_time_ratio,
  sum(travel_time_missing) = 0 AS has_complete_actual_transition_travel_time FROM detail GROUP BY ALL""",
    "detail",
)


@lazy_view
def build_detail(spark, d):
    """Coverage against the first source alone."""
    build = of_source(V.travel(spark, d), "training_build")
    return K.single_source_detail(V.transitions(spark, d), build)


cte(
    "build_detail",
    """SELECT t.route_id, t.from_stop, t.to_stop, t.position, e.travel_time AS travel_time_ij,
  CAST(e.travel_time IS NULL AS BIGINT) AS travel_time_missing FROM transitions t LEFT JOIN edges e
  ON t.route_id = e.route_id AND t.from_stop = e.from_stop AND t.to_stop = e.to_stop AND e.source = 'training_build'""",
    "transitions",
    "edges",
)
cte(
    "build_completeness",
    """SELECT route_id, count(*) AS actual_transition_count_checked, CAST(sum(travel_time_missing) AS BIGINT) AS missing_travel_time_count,
  sum(travel_time_missing) = 0 AS has_complete_actual_transition_travel_time FROM build_detail GROUP BY route_id""",
    "build_detail",
)


@staged_view
def features(spark, d):
    clean = K.clean_transitions(travel_detail(spark, d))
    return X.transition_features(clean, V.routes(spark, d), V.stops(spark, d), V.packages(spark, d))


def exact_zone(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR trim({c}) IN ('', 'nan', 'NaN', 'None', 'null') THEN 'UNKNOWN_ZONE' ELSE trim({c}) END"
    )


cte(
    "features",
    f"""SELECT *, CAST(same_zone AS BIGINT) AS same_zone_numeric, CAST(zone_changed AS BIGINT) AS zone_changed_numeric FROM (
SELECT *, NOT zone_missing_in_transition AND from_zone = to_zone AS same_zone,
  NOT zone_missing_in_transition AND from_zone <> to_zone AS zone_changed FROM (
SELECT *, from_zone = 'UNKNOWN_ZONE' OR to_zone = 'UNKNOWN_ZONE' AS zone_missing_in_transition FROM (
SELECT t.route_id, t.from_stop, t.to_stop, t.position, t.travel_time_ij, r.route_score, r.number_of_stops,
  CASE WHEN r.number_of_stops IS NULL OR r.number_of_stops = 1 THEN 0.0 ELSE greatest(0.0, least(1.0, CAST(t.position AS DOUBLE) / (r.number_of_stops - 1))) END AS route_progress,
  {exact_zone('f.zone_id')} AS from_zone, f.type AS from_type, {exact_zone('g.zone_id')} AS to_zone, g.type AS to_type,
  coalesce(p.package_count, 0) AS to_package_count, coalesce(p.total_planned_service_time, 0) AS to_total_planned_service_time,
  coalesce(p.has_time_window, 0) AS to_has_time_window, coalesce(p.time_window_package_count, 0) AS to_time_window_package_count,
  coalesce(p.total_package_volume_cm3, 0) AS to_total_package_volume_cm3, coalesce(p.unknown_status_count, 0) AS to_unknown_status_count,
  coalesce(p.delivered_count, 0) AS to_delivered_count, coalesce(p.attempted_count, 0) AS to_attempted_count,
  coalesce(p.rejected_count, 0) AS to_rejected_count
FROM (SELECT * FROM detail WHERE travel_time_missing = 0) t LEFT JOIN routes r ON t.route_id = r.route_id
LEFT JOIN stops f ON t.route_id = f.route_id AND t.from_stop = f.stop_id
LEFT JOIN stops g ON t.route_id = g.route_id AND t.to_stop = g.stop_id
LEFT JOIN packages p ON t.route_id = p.route_id AND t.to_stop = p.stop_id)))""",
    "detail",
    "routes",
    "stops",
    "packages",
)


@lazy_view
def zoned(spark, d):
    """Transitions with zones compared by the blank-only rule."""
    return X.with_zone_match(V.transitions(spark, d), V.stops(spark, d), "blank_only")


cte(
    "zoned",
    """SELECT t.*, r.route_score, coalesce(trim(f.zone_id), '') <> '' AND coalesce(trim(f.zone_id), '') = coalesce(trim(g.zone_id), '') AS same_zone
FROM transitions t LEFT JOIN stops f ON t.route_id = f.route_id AND t.from_stop = f.stop_id
LEFT JOIN stops g ON t.route_id = g.route_id AND t.to_stop = g.stop_id LEFT JOIN routes r ON t.route_id = r.route_id""",
    "transitions",
    "stops",
    "routes",
)


@lazy_view
def positions(spark, d):
    """Transitions with sequence progress and destination packages."""
    return X.with_destination_packages(X.with_sequence_progress(V.transitions(spark, d)), V.packages(spark, d))


cte(
    "positions",
    """SELECT t.*, CASE WHEN m.last = 0 THEN 0.0 ELSE CAST(t.position AS DOUBLE) / m.last END AS route_progress,
  coalesce(p.package_count, 0) AS package_count, coalesce(p.total_planned_service_time, 0) AS total_planned_service_time,
  coalesce(p.total_package_volume_cm3, 0) AS total_package_volume_cm3, coalesce(p.has_time_window, 0) AS has_time_window
FROM transitions t JOIN (SELECT route_id, max(position) AS last FROM transitions GROUP BY route_id) m ON t.route_id = m.route_id
LEFT JOIN packages p ON t.route_id = p.route_id AND t.to_stop = p.stop_id""",
    "transitions",
    "packages",
)
