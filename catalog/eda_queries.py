"""Exploratory summaries, distributions, bins and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import coverage_views as CV
from catalog import views as V
from catalog.registry import query
from routelore.operators import coverage as K
from routelore.operators import distribution as D
from routelore.operators import eda as E
from routelore.operators import joins as J
from routelore.operators import pairwise as P
from routelore.operators import sampling as SA


def describe_sql(table: str, cols, probabilities) -> str:
    stats = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "CAST(min({c}) AS DOUBLE)")]
    stats += [(n, f"quantile_cont(CAST({{c}} AS DOUBLE), {p})") for n, p in probabilities.items()]
    stats += [("max", "CAST(max({c}) AS DOUBLE)")]
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS statistic, " + ", ".join(f"{e.format(c=c)} AS {a}" for c, a in cols.items()) + f" FROM {table}" for n, e in stats
    )


QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
DECILE_LOW = "(SELECT min({c}) AS lo, max({c}) AS hi FROM {t})"


def bin_sql(table: str, c: str, n: int) -> str:
    return (
        f"SELECT *, lo + (bin - 1) * (hi - lo) / {n} AS bin_low, lo + bin * (hi - lo) / {n} AS bin_high FROM (SELECT x.*, lo, hi, "
        f"CAST(least({n}, greatest(1, coalesce(ceil(({c} - lo) / ((hi - lo) / {n})), 1))) AS BIGINT) AS bin FROM {table} x, "
        f"(SELECT min({c}) AS lo, max({c}) AS hi FROM {table}))"
    )


@query(
    "q14_training_flag_summary",
    """SELECT metric, value, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM quality) AS percentage FROM (
SELECT 'can_use_for_training' AS metric, can_use_for_training AS value FROM quality UNION ALL SELECT 'has_single_station', has_single_station FROM quality
UNION ALL SELECT 'sequence_matches_route_stops', sequence_matches_route_stops FROM quality) GROUP BY metric, value""",
    "quality",
)
def q14(spark, d):
    return E.training_flag_summary(V.quality(spark, d))


def levels_sql(table: str, cols: str) -> str:
    return f"""SELECT 'overall' AS analysis_level, 'All' AS route_score, {cols} FROM {table}
UNION ALL SELECT 'by_route_score', route_score, {cols} FROM {table} GROUP BY route_score"""


@query(
    "q15_zone_missing_summary",
    levels_sql(
        "(SELECT s.*, r.route_score FROM stops s LEFT JOIN routes r ON s.route_id = r.route_id)",
        "count(*) AS total_stops, CAST(sum(zone_missing) AS BIGINT) AS missing_zone_count, avg(zone_missing) AS missing_zone_ratio",
    ),
    "stops", "routes",
)
def q15(spark, d):
    return E.zone_missing_summary(V.stops(spark, d), V.routes(spark, d))


@query("q16_package_feature_summary", describe_sql("packages", {c: c for c in E.BURDEN_COLUMNS}, QUARTILES), "packages")
def q16(spark, d):
    return E.package_feature_summary(V.packages(spark, d))


@query(
    "q16_time_window_summary",
    "SELECT has_time_window, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM packages) AS percentage FROM packages GROUP BY has_time_window",
    "packages",
)
def q16b(spark, d):
    return E.time_window_summary(V.packages(spark, d))


@query(
    "q17_same_zone_summary",
    levels_sql("zoned", "count(*) AS transition_count, CAST(count(*) FILTER (same_zone) AS BIGINT) AS same_zone_transition_count, avg(CAST(same_zone AS INT)) AS same_zone_ratio"),
    "zoned",
)
def q17(spark, d):
    return E.same_zone_summary(CV.zoned(spark, d), V.routes(spark, d))


@query(
    "q17_zone_continuity_overall",
    """SELECT count(*) AS transition_count, count(*) FILTER (same_zone) AS same_zone_transition_count, count(*) FILTER (zone_changed) AS zone_changed_transition_count,
  count(*) FILTER (zone_missing_in_transition) AS zone_missing_transition_count, avg(CAST(same_zone AS INT)) AS same_zone_ratio FROM features""",
    "features",
)
def q17b(spark, d):
    return E.zone_continuity_overall(CV.features(spark, d))


TT = "count(travel_time_ij) AS transition_count, avg(travel_time_ij) AS mean, quantile_cont(travel_time_ij, 0.5) AS median, quantile_cont(travel_time_ij, 0.95) AS p95"


@query("q17_travel_time_by_same_zone", f"SELECT same_zone, {TT} FROM features GROUP BY same_zone", "features")
def q17c(spark, d):
    return E.travel_time_by_same_zone(CV.features(spark, d))


@query(
    "q18_progress_by_time_window",
    """SELECT has_time_window, count(*) AS count, avg(route_progress) AS mean, quantile_cont(route_progress, 0.5) AS median, stddev_samp(route_progress) AS std,
  min(route_progress) AS min, max(route_progress) AS max FROM positions GROUP BY has_time_window""",
    "positions",
)
def q18(spark, d):
    return E.progress_by_time_window(CV.positions(spark, d))


@query(
    "q18_progress_quartiles_by_time_window",
    """SELECT to_has_time_window, count(*) AS transition_count, avg(route_progress) AS mean, quantile_cont(route_progress, 0.5) AS median,
  quantile_cont(route_progress, 0.25) AS p25, quantile_cont(route_progress, 0.75) AS p75 FROM features GROUP BY to_has_time_window""",
    "features",
)
def q18b(spark, d):
    return E.progress_quartiles_by_time_window(CV.features(spark, d))


@query(
    "q18_time_window_rate_by_bin",
    f"SELECT bin, bin_low, bin_high, count(*) AS transition_count, avg(to_has_time_window) AS time_window_stop_rate FROM ({bin_sql('features', 'route_progress', 10)}) GROUP BY ALL",
    "features",
)
def q18c(spark, d):
    return E.time_window_rate_by_bin(CV.features(spark, d))


@query(
    "q19_burden_by_bin",
    f"""SELECT bin, bin_low, bin_high, count(*) AS transition_count, avg(package_count) AS package_count, avg(total_planned_service_time) AS total_planned_service_time,
  avg(total_package_volume_cm3) AS total_package_volume_cm3 FROM ({bin_sql('positions', 'route_progress', 10)}) GROUP BY ALL""",
    "positions",
)
def q19(spark, d):
    return E.burden_by_bin(CV.positions(spark, d))


@query(
    "q19_burden_stats_by_bin",
    "SELECT bin, "
    + ", ".join(
        f"count(to_{c}) AS to_{c}_count, avg(to_{c}) AS to_{c}_mean, quantile_cont(CAST(to_{c} AS DOUBLE), 0.5) AS to_{c}_median, quantile_cont(CAST(to_{c} AS DOUBLE), 0.95) AS to_{c}_p95"
        for c in E.BURDEN_COLUMNS
    )
    + f" FROM ({bin_sql('features', 'route_progress', 10)}) GROUP BY bin",
    "features",
)
def q19b(spark, d):
    return E.burden_stats_by_bin(CV.features(spark, d))


@query(
    "q20_eda_dataset_summary",
    """SELECT (SELECT count(*) FROM routes) AS total_routes, (SELECT avg(number_of_stops) FROM routes) AS average_stops_per_route,
  (SELECT count(*) FROM detail WHERE travel_time_missing = 0) AS total_clean_transitions,
  (SELECT count(*) FROM completeness WHERE has_complete_actual_transition_travel_time) AS total_complete_routes,
  (SELECT CAST(coalesce(sum(transition_count), 0) AS BIGINT) FROM completeness WHERE has_complete_actual_transition_travel_time) AS total_complete_route_transitions,
  (SELECT count(*) FROM stops) AS total_stops, (SELECT count(*) FROM packages) AS total_package_stop_rows,
  (SELECT avg(package_count) FROM packages) AS average_package_count_per_stop, (SELECT avg(total_planned_service_time) FROM packages) AS average_service_time_per_stop,
  (SELECT 100 * avg(has_time_window) FROM packages) AS percentage_stops_with_time_window,
  (SELECT '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' FROM (SELECT coalesce(route_score, 'Missing') AS s, count(*) AS n FROM routes GROUP BY 1)) AS route_score_distribution""",
    "routes", "stops", "packages", "detail", "completeness",
)
def q20(spark, d):
    detail = CV.travel_detail(spark, d)
    complete = K.complete_routes(CV.completeness(spark, d))
    return E.eda_dataset_summary(
        V.routes(spark, d), V.stops(spark, d), V.packages(spark, d), K.clean_transitions(detail), complete,
        K.complete_route_transitions(detail, complete),
    )


query("q21_transition_features", "SELECT * FROM features", "features")(CV.features.lazy)


@query("q22_travel_time_summary", describe_sql("features", {"travel_time_ij": "value"}, E.TRAVEL_QUANTILES), "features")
def q22(spark, d):
    return E.travel_time_summary(CV.features(spark, d))


@query("q22_travel_time_by_score", f"SELECT route_score, {TT} FROM features GROUP BY route_score", "features")
def q22b(spark, d):
    return E.travel_time_by_score(CV.features(spark, d))


@query(
    "q23_score_feature_comparison",
    """SELECT route_score, count(*) AS transition_count, avg(travel_time_ij) AS average_travel_time_ij, avg(CAST(same_zone AS INT)) AS same_zone_ratio,
  avg(to_package_count) AS average_to_package_count, avg(to_total_planned_service_time) AS average_to_total_planned_service_time,
  avg(to_total_package_volume_cm3) AS average_to_total_package_volume_cm3, avg(to_has_time_window) AS time_window_stop_ratio FROM features GROUP BY route_score""",
    "features",
)
def q23(spark, d):
    return E.score_feature_comparison(CV.features(spark, d))


@query(
    "q24_feature_justification",
    """SELECT r.f AS feature_name, r.e AS evidence_from_eda, r.u AS recommended_use, r.x AS explanation FROM (
SELECT avg(CAST(travel_time_ij IS NULL AS INT)) AS miss, avg(travel_time_ij) AS m, quantile_cont(travel_time_ij, 0.5) AS md, avg(CAST(same_zone AS INT)) AS sz,
  avg(to_has_time_window) AS w, abs(avg(route_progress) FILTER (to_has_time_window = 1) - avg(route_progress) FILTER (to_has_time_window = 0)) AS g,
  avg(to_package_count) AS p, avg(to_total_planned_service_time) AS s, avg(to_total_package_volume_cm3) AS v, skewness(to_total_package_volume_cm3) AS k FROM features) a,
LATERAL (SELECT unnest([
  {'f': 'travel_time_ij', 'e': printf('Missing rate after cleaning is %.4f; mean is %.2f; median is %.2f.', miss, m, md), 'u': 'core_feature', 'x': 'Travel time is central to route cost and has very low missingness after multi-source verification.'},
  {'f': 'same_zone / zone_changed', 'e': printf('Overall same-zone transition ratio is %.4f.', sz), 'u': CASE WHEN sz >= 0.2 THEN 'core_feature' ELSE 'secondary_feature' END, 'x': 'Zone continuity captures whether a transition stays in the same delivery area or crosses zones.'},
  {'f': 'to_has_time_window', 'e': printf('Time-window transition rate is %.4f; route-progress mean difference is %.4f.', w, g), 'u': CASE WHEN g >= 0.05 THEN 'core_feature' ELSE 'secondary_feature' END, 'x': 'Time-window stops can represent route-position risk and delivery timing constraints.'},
  {'f': 'to_package_count', 'e': printf('Average destination package count is %.2f.', p), 'u': CASE WHEN p > 0 THEN 'core_feature' ELSE 'not_recommended' END, 'x': 'Package count is a direct stop workload feature.'},
  {'f': 'to_total_planned_service_time', 'e': printf('Average destination planned service time is %.2f.', s), 'u': CASE WHEN s > 0 THEN 'core_feature' ELSE 'secondary_feature' END, 'x': 'Planned service time captures expected stop handling burden.'},
  {'f': 'to_total_package_volume_cm3', 'e': printf('Average destination package volume is %.2f; skewness is %.2f.', v, k), 'u': 'secondary_feature', 'x': 'Package volume may be useful but can be highly skewed, so it should be reviewed before modeling.'},
  {'f': 'scan_status / unknown_status_count', 'e': 'Earlier missing-value analysis showed high missingness for scan status.', 'u': 'auxiliary_only', 'x': 'Use scan-status-derived fields for diagnostics rather than as primary driver preference features.'}]) AS r)""",
    "features",
)
def q24(spark, d):
    return E.feature_justification(CV.features(spark, d))


@query(
    "q25_input_column_check",
    """SELECT 'routes_summary' AS table_name, count(*) AS row_count, count(DISTINCT route_id) AS unique_route_id_count, '' AS missing_required_columns,
  'depot_code' AS missing_optional_columns, 'PASS' AS status FROM routes
UNION ALL SELECT 'stops_base_features', count(*), count(DISTINCT route_id), 'geohash', '', 'FAIL' FROM stops""",
    "routes", "stops",
)
def q25(spark, d):
    rules = {
        "routes_summary": (["route_id", "route_score"], ["number_of_stops", "depot_code"]),
        "stops_base_features": (["route_id", "stop_id", "geohash"], ["zone_id"]),
    }
    return E.input_column_check({"routes_summary": V.routes(spark, d), "stops_base_features": V.stops(spark, d)}, rules)


@query(
    "q28_route_size_summary", describe_sql("routes", {"number_of_stops": "number_of_stops"}, QUARTILES), "routes"
)
def q28(spark, d):
    return D.describe(V.routes(spark, d), ["number_of_stops"])


def histogram_sql(table: str, c: str, n: int) -> str:
    return f"""WITH b AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}), h AS (SELECT CAST(least({n - 1}, coalesce(floor(({c} - lo) * {n} / (hi - lo)), 0)) AS BIGINT) AS bin, count(*) AS n
  FROM {table}, b WHERE {c} IS NOT NULL GROUP BY 1)
SELECT r AS bin, lo + r * ((hi - lo) / {n}) AS bin_low, lo + (r + 1) * ((hi - lo) / {n}) AS bin_high, coalesce(n, 0) AS count FROM b, range({n}) t(r) LEFT JOIN h ON h.bin = r"""


@query("q28_route_size_histogram", histogram_sql("routes", "number_of_stops", 30), "routes")
def q28b(spark, d):
    return D.histogram(V.routes(spark, d), "number_of_stops", 30)


@query(
    "q29_eda_closing_summary",
    """SELECT (SELECT count(*) FROM routes) AS total_routes, (SELECT count(*) FROM quality WHERE can_use_for_training) AS usable_routes, (SELECT count(*) FROM stops) AS total_stops,
  (SELECT count(*) FROM transitions) AS total_transitions, (SELECT avg(CAST(same_zone AS INT)) FROM zoned) AS same_zone_transition_ratio,
  (SELECT 100 * avg(has_time_window) FROM packages) AS percentage_of_stops_with_time_windows, (SELECT avg(package_count) FROM packages) AS average_package_count_per_stop,
  (SELECT avg(total_planned_service_time) FROM packages) AS average_service_time_per_stop""",
    "routes", "quality", "stops", "transitions", "zoned", "packages",
)
def q29(spark, d):
    return E.eda_closing_summary(*[getattr(V, n)(spark, d) for n in ("routes", "stops", "packages", "transitions", "quality")], CV.zoned(spark, d))


# ---- general aggregations and windows ---------------------------------------------------------------------------
@query(
    "a1_sums_and_means_with_null_groups",
    "SELECT route_score, count(*) AS n, CAST(sum(number_of_stops) AS BIGINT) AS total_stops, avg(executor_capacity_cm3) AS mean_capacity FROM routes GROUP BY route_score",
    "routes",
)
def a1(spark, d):
    return V.routes(spark, d).groupBy("route_score").agg(
        F.count("*").alias("n"), F.sum("number_of_stops").alias("total_stops"), F.avg("executor_capacity_cm3").alias("mean_capacity")
    )


A3_SQL = """SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50,
  quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag"""


@query("a3_exact_quantiles", A3_SQL)
def a3(spark, d):
    named = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    return D.quantiles(V.table(spark, d, "lineitem"), ["l_returnflag"], named, "l_extendedprice")


@query("a3_exact_quantiles_in_blocks", A3_SQL)
def a3_blocks(spark, d):
    """The block plan that large inputs take, forced."""
    named = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    return D.quantiles(V.table(spark, d, "lineitem"), ["l_returnflag"], named, "l_extendedprice", rows_per_block=1000)


@query(
    "a5_route_score_distribution",
    "SELECT coalesce(route_score, 'Missing') AS route_score, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM routes) AS percentage FROM routes GROUP BY 1",
    "routes",
)
def a5(spark, d):
    return E.route_score_distribution(V.routes(spark, d))


def corr_sql(table: str, pairs) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{x}' AS x_name, '{y}' AS y_name, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (
  SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""
        for x, y in pairs
    )


FEATURE_PAIRS = [(x, y) for i, x in enumerate(E.NUMERIC_FEATURES) for y in E.NUMERIC_FEATURES[i + 1 :]]


@query("a10_feature_correlations", corr_sql("features", FEATURE_PAIRS), "features")
def a10(spark, d):
    return D.correlations(CV.features(spark, d), FEATURE_PAIRS)


@query("a11_adjusted_skewness", "SELECT l_returnflag, skewness(l_extendedprice) AS skew FROM lineitem GROUP BY l_returnflag")
def a11(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy("l_returnflag")
    return rows.agg(D.adjusted_skewness(F.col("l_extendedprice")).alias("skew"))


@query("a12_distinct_counts", "SELECT count(DISTINCT route_id) AS routes, count(DISTINCT from_stop) AS stops FROM features", "features")
def a12(spark, d):
    return CV.features(spark, d).agg(F.count_distinct("route_id").alias("routes"), F.count_distinct("from_stop").alias("stops"))


@query(
    "w4_sequence_progress",
    "SELECT route_id, from_stop, to_stop, position, label, route_progress FROM positions",
    "positions",
)
def w4(spark, d):
    from routelore.operators.features import with_sequence_progress

    return with_sequence_progress(V.transitions(spark, d))


W9_SQL = """SELECT l_returnflag, v AS value, count(*) AS n, any_value(r) AS average_rank, any_value(m) AS all_n FROM (SELECT l_returnflag, v,
  rank() OVER (PARTITION BY l_returnflag ORDER BY v) + (count(*) OVER (PARTITION BY l_returnflag, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY l_returnflag) AS m
  FROM (SELECT l_returnflag, l_quantity AS v FROM lineitem)) GROUP BY l_returnflag, v"""


@query("w9_average_ranks", W9_SQL)
def w9(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("value"))
    return D.average_ranks(rows, ["l_returnflag"])


@query("w9_average_ranks_in_blocks", W9_SQL)
def w9_blocks(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("value"))
    return D.average_ranks(rows, ["l_returnflag"], rows_per_block=10)


@query(
    "w1_positions_in_blocks",
    "SELECT route_id, from_stop, to_stop, position FROM transitions",
    "transitions",
)
def w1(spark, d):
    """Consecutive pairing by the block plan that routes with very many stops take, forced."""
    from routelore.operators.ordering import ordered_positions

    placed = ordered_positions(V.raw_sequence(spark, d), ["route_id"], ["seq_position", "stop_id"], {"to_stop": "stop_id"}, rows_per_block=10)
    return placed.where("to_stop is not null").select("route_id", F.col("stop_id").alias("from_stop"), "to_stop", "position")


@query(
    "w10_ordered_stop_blocks",
    "SELECT route_id, position // 50 AS block, list(stop_id ORDER BY position) AS stop_ids FROM sequence WHERE n >= 2 GROUP BY ALL",
    "sequence",
)
def w10(spark, d):
    return P.sequence_blocks(P.stop_sequence(V.transitions(spark, d)), 50)


# ---- bins, sorts and samples ------------------------------------------------------------------------------------
@query("b1_equal_width_bins", f"SELECT l_orderkey, l_linenumber, l_extendedprice, bin, bin_low, bin_high FROM ({bin_sql('lineitem', 'l_extendedprice', 10)})")
def b1(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return D.equal_width_bins(rows, "l_extendedprice", 10)


@query("b4_histogram", histogram_sql("lineitem", "l_extendedprice", 40))
def b4(spark, d):
    return D.histogram(V.table(spark, d, "lineitem"), "l_extendedprice", 40)


@query(
    "b5_five_numbers",
    """SELECT route_score, count(*) AS n, min(travel_time_ij) AS min, quantile_cont(travel_time_ij, 0.25) AS q1, quantile_cont(travel_time_ij, 0.5) AS median,
  quantile_cont(travel_time_ij, 0.75) AS q3, max(travel_time_ij) AS max FROM features GROUP BY route_score""",
    "features",
)
def b5(spark, d):
    return D.five_numbers(CV.features(spark, d), ["route_score"], "travel_time_ij")


@query(
    "k2_category_order",
    "SELECT route_id, route_score, CAST(CASE route_score WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END AS BIGINT) AS sort_key FROM routes",
    "routes",
)
def k2(spark, d):
    key = D.category_order(F.col("route_score"), E.SCORE_ORDER).cast("long")
    return V.routes(spark, d).select("route_id", "route_score", key.alias("sort_key")).orderBy("sort_key", "route_id")


@query(
    "k3_first_routes",
    """SELECT from_stop, to_stop, route_id, position FROM transitions WHERE route_id IN (SELECT route_id FROM transitions GROUP BY route_id
  ORDER BY min(CAST(from_stop AS BIGINT)), route_id LIMIT 50)""",
    "transitions",
)
def k3(spark, d):
    rows = V.transitions(spark, d).withColumn("seen", F.col("from_stop").cast("long"))
    return SA.first_routes(rows, "seen", 50).select("from_stop", "to_stop", "route_id", "position")


@query(
    "k5_best_row",
    "SELECT route_id, number_of_stops, executor_capacity_cm3 FROM routes ORDER BY number_of_stops DESC, executor_capacity_cm3 ASC NULLS LAST, route_id LIMIT 1",
    "routes",
)
def k5(spark, d):
    rows = V.routes(spark, d).select("route_id", "number_of_stops", "executor_capacity_cm3")
    return SA.best_row(rows, [F.desc("number_of_stops"), F.asc_nulls_last("executor_capacity_cm3"), "route_id"])


HASH32 = "('0x' || substr(md5({key}), 1, 8))::BIGINT"


@query(
    "p1_row_sample",
    f"""SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY md5('43|' || event_id)) AS r FROM events
WHERE {HASH32.format(key="'42|' || event_id")} < CAST(floor(0.25 * 4294967296) AS BIGINT)) WHERE r <= 1500""",
)
def p1(spark, d):
    rows = V.table(spark, d, "events").select("event_id", "user_id")
    return SA.sample_rows(rows, ["event_id"], fraction=0.25, max_rows=1500)


@query(
    "p2_context_sample",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem)
  ORDER BY md5('42|' || l_orderkey) LIMIT 700)""",
)
def p2(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return SA.sample_contexts(rows, ["l_orderkey"], 700)


@query(
    "p3_context_sample_to_budget",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey,
  sum(n) OVER (ORDER BY md5('42|' || l_orderkey) ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)) WHERE s <= 2500)""",
)
def p3(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return SA.sample_contexts_to_budget(rows, ["l_orderkey"], 2500)


@query(
    "s11_route_chunk_manifest",
    """SELECT (r - 1) // 40 AS chunk_index, count(*) AS route_count, arg_min(route_id, r) AS first_route_id, arg_max(route_id, r) AS last_route_id
FROM (SELECT route_id, row_number() OVER (ORDER BY route_id) AS r FROM routes) GROUP BY 1""",
    "routes",
)
def s11(spark, d):
    return SA.chunk_manifest(SA.route_chunks(V.routes(spark, d), 40))


@query(
    "s13_route_id_list",
    """SELECT route_id, min(CAST(from_stop AS BIGINT)) AS first_seen FROM transitions GROUP BY route_id""",
    "transitions",
)
def s13(spark, d):
    rows = V.transitions(spark, d).withColumn("seen", F.col("from_stop").cast("long"))
    return SA.route_id_list(rows, "seen")
