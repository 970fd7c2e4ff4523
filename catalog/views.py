"""Route domain over the driver's tables: users are routes, events are stops, order lines are packages.

Each Spark view has a SQL twin of the same name in ``registry.CTES``. Views are linear in the driver's tables: the travel time
between any two stops of a route follows from both, and only the pairs that are asked for are made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.registry import cte, lazy_view, staged_view
from routelore.operators import cleaning as C
from routelore.operators.travel import StopTravel


@lazy_view
def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- raw rows ---------------------------------------------------------------------------------------------------
@lazy_view
def raw_stops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    station = (F.col("ts") == F.col("first_ts")) | ((F.col("event_type") == "signup") & (F.col("value") > 250))
    zone = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when((F.col("event_type") == "signup") & (F.col("value") < 5), "nan")
        .otherwise(F.col("event_type"))
    )
    return e.join(first, "user_id").select(
        F.col("user_id").cast("string").alias("route_id"),
        F.col("event_id").cast("string").alias("stop_id"),
        F.col("event_id").alias("stop_order"),
        (40 + F.col("value") / 1000).alias("lat"),
        (F.get_json_object("props", "$.k").cast("double") - 100).alias("lng"),
        F.when(station, "Station").otherwise("Dropoff").alias("type"),
        zone.alias("zone_id"),
    )


cte(
    "raw_stops",
    """SELECT CAST(e.user_id AS VARCHAR) AS route_id, CAST(e.event_id AS VARCHAR) AS stop_id, e.event_id AS stop_order,
  40 + e.value / 1000 AS lat, CAST(json_extract_string(e.props, '$.k') AS DOUBLE) - 100 AS lng,
  CASE WHEN e.ts = f.first_ts OR (e.event_type = 'signup' AND e.value > 250) THEN 'Station' ELSE 'Dropoff' END AS type,
  CASE WHEN e.event_type = 'error' THEN NULL WHEN e.event_type = 'signup' AND e.value < 5 THEN 'nan'
    ELSE e.event_type END AS zone_id
FROM events e JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) f ON e.user_id = f.user_id""",
)


@lazy_view
def raw_routes(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    c = table(spark, d, "customer")
    score = (
        F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "High")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "Medium")
        .when(F.col("c_mktsegment") == "MACHINERY", "Low")
    )
    return users.join(c, users.user_id == c.c_custkey, "left").select(
        F.col("user_id").cast("string").alias("route_id"),
        F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("station_code"),
        F.date_format("first_ts", "yyyy-MM-dd").alias("date_YYYY_MM_DD"),
        F.date_format("first_ts", "HH:mm:ss").alias("departure_time_utc"),
        F.col("c_acctbal").alias("executor_capacity_cm3"),
        score.alias("route_score"),
        F.col("c_nationkey").alias("nation"),
    )


cte(
    "raw_routes",
    """SELECT CAST(u.user_id AS VARCHAR) AS route_id, 'D' || CAST(c.c_nationkey AS VARCHAR) AS station_code,
  strftime(u.first_ts, '%Y-%m-%d') AS "date_YYYY_MM_DD", strftime(u.first_ts, '%H:%M:%S') AS departure_time_utc,
  c.c_acctbal AS executor_capacity_cm3,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'High' WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Medium'
    WHEN c.c_mktsegment = 'MACHINERY' THEN 'Low' END AS route_score, c.c_nationkey AS nation
FROM (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) u LEFT JOIN customer c ON u.user_id = c.c_custkey""",
)


@lazy_view
def raw_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kept = ~((F.col("event_type") == "signup") & (F.col("value") > 300))
    return e.where(kept).select(
        F.col("user_id").cast("string").alias("route_id"),
        F.col("event_id").cast("string").alias("stop_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq_position"),
    )


cte(
    "raw_sequence",
    """SELECT CAST(user_id AS VARCHAR) AS route_id, CAST(event_id AS VARCHAR) AS stop_id, epoch_us(ts) AS seq_position
FROM events WHERE NOT (event_type = 'signup' AND value > 300)""",
)


@lazy_view
def raw_packages(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    e = table(spark, d, "events").select("event_id", "user_id")
    status = (
        F.when(F.col("l_linenumber") == 7, F.lit(None))
        .when(F.col("l_returnflag") == "N", "DELIVERED")
        .when(F.col("l_returnflag") == "A", "DELIVERY_ATTEMPTED")
        .otherwise("REJECTED")
    )
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return li.join(e, li.l_orderkey == e.event_id, "left").select(
        F.coalesce(F.col("user_id"), F.col("l_suppkey")).cast("string").alias("route_id"),
        F.col("l_orderkey").cast("string").alias("stop_id"),
        F.col("l_partkey").cast("string").alias("package_id"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("double")).alias("planned_service_time_seconds"),
        day.alias("start_time_utc"),
        F.when(F.col("l_linestatus") == "O", day).alias("end_time_utc"),
        F.floor(F.col("l_extendedprice") / 100).cast("double").alias("length_cm"),
        F.col("l_quantity").cast("double").alias("width_cm"),
        F.when(F.col("l_discount") != 0, F.round(F.col("l_discount") * 100)).alias("height_cm"),
        status.alias("scan_status"),
    )


cte(
    "raw_packages",
    """SELECT CAST(coalesce(e.user_id, l.l_suppkey) AS VARCHAR) AS route_id, CAST(l.l_orderkey AS VARCHAR) AS stop_id,
  CAST(l.l_partkey AS VARCHAR) AS package_id,
  CASE WHEN l.l_tax <> 0 THEN CAST(l.l_quantity AS DOUBLE) END AS planned_service_time_seconds,
  strftime(l.l_shipdate, '%Y-%m-%d') AS start_time_utc,
  CASE WHEN l.l_linestatus = 'O' THEN strftime(l.l_shipdate, '%Y-%m-%d') END AS end_time_utc,
  CAST(floor(l.l_extendedprice / 100) AS DOUBLE) AS length_cm, CAST(l.l_quantity AS DOUBLE) AS width_cm,
  CASE WHEN l.l_discount <> 0 THEN round(l.l_discount * 100) END AS height_cm,
  CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_returnflag = 'N' THEN 'DELIVERED'
    WHEN l.l_returnflag = 'A' THEN 'DELIVERY_ATTEMPTED' ELSE 'REJECTED' END AS scan_status
FROM lineitem l LEFT JOIN events e ON l.l_orderkey = e.event_id""",
)


# ---- cleaned tables ---------------------------------------------------------------------------------------------
@staged_view
def stops(spark: SparkSession, d: str) -> DataFrame:
    return C.stop_base_features(raw_stops(spark, d))


cte(
    "stops",
    """SELECT route_id, stop_id, lat, lng, type, zone_id, CAST(zone_id IS NULL OR trim(zone_id) = '' AS BIGINT) AS zone_missing,
  CAST(lower(type) = 'station' AS BIGINT) AS is_station, CAST(lower(type) = 'dropoff' AS BIGINT) AS is_dropoff FROM raw_stops""",
    "raw_stops",
)


@staged_view
def routes(spark: SparkSession, d: str) -> DataFrame:
    return C.route_summary(raw_routes(spark, d), raw_stops(spark, d))


cte(
    "routes",
    """SELECT r.route_id, station_code, "date_YYYY_MM_DD", departure_time_utc, executor_capacity_cm3, route_score,
  coalesce(n, 0) AS number_of_stops, station_stop_id, coalesce(st, 0) AS number_of_station_stops,
  coalesce(dr, 0) AS number_of_dropoff_stops, coalesce(mz, 0) AS missing_zone_count,
  CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE CAST(mz AS DOUBLE) / n END AS missing_zone_ratio
FROM raw_routes r LEFT JOIN (SELECT s.route_id, count(*) AS n, CAST(sum(is_station) AS BIGINT) AS st,
  CAST(sum(is_dropoff) AS BIGINT) AS dr, CAST(sum(zone_missing) AS BIGINT) AS mz,
  arg_min(CASE WHEN is_station = 1 THEN s.stop_id END, CASE WHEN is_station = 1 THEN w.stop_order END) AS station_stop_id
  FROM stops s JOIN raw_stops w ON s.stop_id = w.stop_id AND s.route_id = w.route_id GROUP BY s.route_id) a
ON r.route_id = a.route_id""",
    "raw_routes",
    "stops",
    "raw_stops",
)


@staged_view
def transitions(spark: SparkSession, d: str) -> DataFrame:
    return C.actual_transitions(raw_sequence(spark, d))


cte(
    "sequence",
    """SELECT route_id, stop_id, row_number() OVER (PARTITION BY route_id ORDER BY seq_position, stop_id) - 1 AS position,
  count(*) OVER (PARTITION BY route_id) AS n FROM raw_sequence""",
    "raw_sequence",
)
cte(
    "transitions",
    """SELECT a.route_id, a.stop_id AS from_stop, b.stop_id AS to_stop, a.position, CAST(1 AS BIGINT) AS label
FROM sequence a JOIN sequence b ON a.route_id = b.route_id AND b.position = a.position + 1""",
    "sequence",
)


@staged_view
def packages(spark: SparkSession, d: str) -> DataFrame:
    return C.stop_package_features(raw_packages(spark, d))


cte(
    "packages",
    """SELECT route_id, stop_id, count(*) AS package_count,
  coalesce(sum(planned_service_time_seconds), 0.0) AS total_planned_service_time,
  CAST(max(CASE WHEN end_time_utc IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS has_time_window,
  count(end_time_utc) AS time_window_package_count,
  coalesce(sum(length_cm * width_cm * height_cm), 0.0) AS total_package_volume_cm3,
  count(*) FILTER (scan_status = 'DELIVERED') AS delivered_count,
  count(*) FILTER (scan_status = 'DELIVERY_ATTEMPTED') AS attempted_count,
  count(*) FILTER (scan_status = 'REJECTED') AS rejected_count,
  count(*) FILTER (scan_status IS NULL) AS unknown_status_count
FROM raw_packages GROUP BY route_id, stop_id""",
    "raw_packages",
)


@staged_view
def quality(spark: SparkSession, d: str) -> DataFrame:
    return C.data_quality_report(routes(spark, d), raw_stops(spark, d), raw_sequence(spark, d), raw_packages(spark, d))


cte(
    "quality",
    """SELECT r.route_id, s.n IS NOT NULL AS route_exists_in_actual_sequences, coalesce(s.n, 0) AS sequence_stop_count,
  r.number_of_stops AS route_stop_count, coalesce(d.differing, 0) = 0 AS sequence_matches_route_stops,
  coalesce(p.n, 0) AS package_stop_count, coalesce(p.outside, 0) AS package_stops_not_in_route_count,
  r.number_of_station_stops, r.number_of_station_stops = 1 AS has_single_station,
  s.n IS NOT NULL AND s.n = r.number_of_stops AND coalesce(d.differing, 0) = 0 AND r.number_of_station_stops = 1
    AS can_use_for_training
FROM routes r
LEFT JOIN (SELECT route_id, count(DISTINCT stop_id) AS n FROM raw_sequence GROUP BY route_id) s ON r.route_id = s.route_id
LEFT JOIN (SELECT k.route_id, count(*) AS n, count(*) FILTER (t.stop_id IS NULL) AS outside
  FROM (SELECT DISTINCT route_id, stop_id FROM raw_packages) k
  LEFT JOIN stops t ON k.route_id = t.route_id AND k.stop_id = t.stop_id GROUP BY k.route_id) p ON r.route_id = p.route_id
LEFT JOIN (SELECT coalesce(a.route_id, b.route_id) AS route_id, count(*) AS differing FROM stops a
  FULL JOIN raw_sequence b ON a.route_id = b.route_id AND a.stop_id = b.stop_id
  WHERE a.stop_id IS NULL OR b.stop_id IS NULL GROUP BY 1) d ON r.route_id = d.route_id""",
    "routes",
    "raw_sequence",
    "raw_packages",
    "stops",
)


@lazy_view
def missing(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_value_summary(routes(spark, d), raw_packages(spark, d))


cte(
    "missing",
    """SELECT field, missing_count, total_count, CASE WHEN total_count = 0 THEN 0.0
    ELSE CAST(missing_count AS DOUBLE) / total_count END AS missing_ratio FROM (
  SELECT 'zone_id' AS field, CAST(sum(missing_zone_count) AS BIGINT) AS missing_count, CAST(sum(number_of_stops) AS BIGINT) AS total_count FROM routes
  UNION ALL SELECT 'package_time_window', count(*) FILTER (end_time_utc IS NULL OR start_time_utc IS NULL), count(*) FROM raw_packages
  UNION ALL SELECT 'planned_service_time', count(*) FILTER (planned_service_time_seconds IS NULL), count(*) FROM raw_packages
  UNION ALL SELECT 'package_dimensions', count(*) FILTER (height_cm IS NULL OR width_cm IS NULL OR length_cm IS NULL), count(*) FROM raw_packages
  UNION ALL SELECT 'scan_status', count(*) FILTER (scan_status IS NULL), count(*) FROM raw_packages)""",
    "routes",
    "raw_packages",
)


# ---- travel times -----------------------------------------------------------------------------------------------
def _seconds(a, b, source):
    """No time from an error to a signup (the matrix lacks the pair) nor between errors (it holds none)."""
    none = (a["event_type"] == "error") & b["event_type"].isin("error", "signup")
    late = F.when(source == "training_apply", 5.0).otherwise(0.0)
    return F.when(~none, F.round(F.abs(a["value"] - b["value"]) * 100) + 1 + late)


def _seconds_row(a, b, source):
    none = (a["event_type"] == "error") & np.isin(b["event_type"].astype(str), ("error", "signup"))
    seconds = np.floor(np.abs(a["value"] - b["value"]) * 100 + 0.5) + 1 + (5.0 if source == "training_apply" else 0.0)
    return np.where(none, np.nan, seconds)


@staged_view
def route_sources(spark: SparkSession, d: str) -> DataFrame:
    """route_id and source. A route can be in several sources or in none; one of a single stop has no pairs."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey", "c_acctbal")
    main = (
        F.when(F.col("c_nationkey") < 14, "training_build")
        .when(F.col("c_nationkey") < 20, "training_apply")
        .otherwise("evaluation_apply")
    )
    second = F.when(F.col("c_acctbal") > 9000, "training_apply")
    sources = F.array_distinct(F.array_compact(F.array(main, second)))
    paired = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1")
    per_route = c.where(~(F.col("c_acctbal") < -500)).join(paired, "user_id", "left_semi")
    return per_route.select(F.col("user_id").cast("string").alias("route_id"), F.explode(sources).alias("source"))


@lazy_view
def travel(spark: SparkSession, d: str) -> StopTravel:
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("route_id"), F.col("event_id").cast("string").alias("stop_id"), "event_type", "value"
    )
    return StopTravel(e, route_sources(spark, d), ("event_type", "value"), _seconds, _seconds_row)


cte(
    "edge_sources",
    """SELECT DISTINCT route_id, source FROM (SELECT CAST(c_custkey AS VARCHAR) AS route_id,
  CASE WHEN c_nationkey < 14 THEN 'training_build' WHEN c_nationkey < 20 THEN 'training_apply' ELSE 'evaluation_apply' END AS source
  FROM customer WHERE NOT c_acctbal < -500
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'training_apply' FROM customer WHERE c_acctbal > 9000 AND NOT c_acctbal < -500)
WHERE route_id IN (SELECT CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING count(*) > 1)""",
)
cte(
    "edges",
    """SELECT a.route_id, a.stop_id AS from_stop, b.stop_id AS to_stop,
  CASE WHEN NOT (a.event_type = 'error' AND b.event_type = 'error') THEN round(abs(a.value - b.value) * 100) + 1
    + CASE WHEN s.source = 'training_apply' THEN 5.0 ELSE 0.0 END END AS travel_time, s.source
FROM placed a JOIN placed b ON a.route_id = b.route_id AND b.stop_id <> a.stop_id
JOIN edge_sources s ON a.route_id = s.route_id WHERE NOT (a.event_type = 'error' AND b.event_type = 'signup')""",
    "placed",
    "edge_sources",
)
cte("placed", "SELECT CAST(user_id AS VARCHAR) AS route_id, CAST(event_id AS VARCHAR) AS stop_id, event_type, value FROM events")
