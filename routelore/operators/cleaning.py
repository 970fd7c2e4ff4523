"""Cleaning: raw route, sequence and package rows to typed tables and their quality reports.

Raw inputs are rows, as the readers in ``sources.nested`` produce them:
routes (route_id, station_code, date_YYYY_MM_DD, departure_time_utc, executor_capacity_cm3, route_score),
stops (route_id, stop_id, stop_order, lat, lng, type, zone_id), sequence (route_id, stop_id, seq_position),
packages (route_id, stop_id, package_id, planned_service_time_seconds, start_time_utc, end_time_utc, length_cm,
width_cm, height_cm, scan_status). A route without stops or packages appears with a null stop_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.ordering import ordered_positions

# The fields of the missing-value summary, in report order.
MISSING_FIELDS = ("zone_id", "package_time_window", "planned_service_time", "package_dimensions", "scan_status")


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def stop_base_features(raw_stops: DataFrame) -> DataFrame:
    """One row per stop with zone_missing, is_station and is_dropoff flags."""
    kind = F.lower(F.col("type"))
    return raw_stops.where(F.col("stop_id").isNotNull()).select(
        "route_id",
        "stop_id",
        "lat",
        "lng",
        "type",
        "zone_id",
        S.flag(S.text_is_missing(F.col("zone_id"))).alias("zone_missing"),
        S.flag(kind == "station").alias("is_station"),
        S.flag(kind == "dropoff").alias("is_dropoff"),
    )


def route_summary(raw_routes: DataFrame, raw_stops: DataFrame) -> DataFrame:
    """Route header with stop counts, first station in file order, and missing-zone count and ratio."""
    keys = [k for k in ("route_id", "part_order") if k in raw_routes.columns and k in raw_stops.columns]
    kind = F.lower(F.col("type"))
    stops = (
        raw_stops.where(F.col("stop_id").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("number_of_stops"),
            F.min_by(F.when(kind == "station", F.col("stop_id")), F.when(kind == "station", F.col("stop_order"))).alias(
                "station_stop_id"
            ),
            _count(kind == "station").alias("number_of_station_stops"),
            _count(kind == "dropoff").alias("number_of_dropoff_stops"),
            _count(S.text_is_missing(F.col("zone_id"))).alias("missing_zone_count"),
        )
    )
    zero = F.lit(0).cast("long")
    counted = ["number_of_stops", "number_of_station_stops", "number_of_dropoff_stops", "missing_zone_count"]
    joined = raw_routes.join(stops, keys, "left").withColumns({c: F.coalesce(c, zero) for c in counted})
    return joined.select(
        "route_id",
        *[c for c in ("part_order",) if c in keys],
        "station_code",
        "date_YYYY_MM_DD",
        "departure_time_utc",
        "executor_capacity_cm3",
        "route_score",
        "number_of_stops",
        "station_stop_id",
        "number_of_station_stops",
        "number_of_dropoff_stops",
        "missing_zone_count",
        S.ratio(F.col("missing_zone_count"), F.col("number_of_stops")).alias("missing_zone_ratio"),
    )


def actual_transitions(raw_sequence: DataFrame) -> DataFrame:
    """Consecutive stop pairs of each route, ordered by (position, nulls last, stop id)."""
    rows = raw_sequence.where(F.col("stop_id").isNotNull()).select(
        "route_id",
        "stop_id",
        F.coalesce(F.col("seq_position").cast("double"), F.lit(float("inf"))).alias("__p"),
    )
    placed = ordered_positions(rows, ["route_id"], ["__p", "stop_id"], {"to_stop": "stop_id"})
    return placed.where(F.col("to_stop").isNotNull()).select(
        "route_id",
        F.col("stop_id").alias("from_stop"),
        "to_stop",
        "position",
        F.lit(1).cast("long").alias("label"),
    )


def stop_package_features(raw_packages: DataFrame) -> DataFrame:
    """Package aggregates per stop."""
    real = F.col("package_id").isNotNull()
    window = real & S.has_window(F.col("start_time_utc"), F.col("end_time_utc"))
    volume = S.package_volume(F.col("length_cm"), F.col("width_cm"), F.col("height_cm"))
    status = S.scan_status_class(F.col("scan_status"))
    service = S.finite(F.col("planned_service_time_seconds"))
    return (
        raw_packages.where(F.col("stop_id").isNotNull())
        .groupBy("route_id", "stop_id")
        .agg(
            _count(real).alias("package_count"),
            F.coalesce(F.sum(service), F.lit(0.0)).alias("total_planned_service_time"),
            F.coalesce(F.max(S.flag(window)), F.lit(0).cast("long")).alias("has_time_window"),
            _count(window).alias("time_window_package_count"),
            F.coalesce(F.sum(volume), F.lit(0.0)).alias("total_package_volume_cm3"),
            *[_count(real & (status == s)).alias(f"{s}_count") for s in ("delivered", "attempted", "rejected")],
            _count(real & (status == "unknown")).alias("unknown_status_count"),
        )
    )


def package_missing_counts(raw_packages: DataFrame) -> DataFrame:
    """field, missing_count and total_count of the four package fields, in one pass."""
    tests = {
        "package_time_window": ~S.has_window(F.col("start_time_utc"), F.col("end_time_utc")),
        "planned_service_time": S.number_is_missing(F.col("planned_service_time_seconds")),
        "package_dimensions": S.package_volume(F.col("length_cm"), F.col("width_cm"), F.col("height_cm")).isNull(),
        "scan_status": S.text_is_missing(F.col("scan_status")),
    }
    one = raw_packages.where(F.col("package_id").isNotNull()).agg(
        F.count("*").alias("total_count"), *[_count(t).alias(n) for n, t in tests.items()]
    )
    return _unpivot(one, list(tests), "total_count")


def _unpivot(one: DataFrame, names: list[str], total: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("field"), F.col(n).alias("missing_count")) for n in names]
    return one.select(F.explode(F.array(*pairs)).alias("p"), F.col(total).alias("total_count")).select(
        "p.field", "p.missing_count", "total_count"
    )


def latest_per_route(rows: DataFrame, order: str = "part_order") -> DataFrame:
    """Rows of each route's last dataset part only; without part information all rows."""
    if order not in rows.columns:
        return rows
    last = rows.groupBy("route_id").agg(F.max(order).alias(order))
    return rows.join(last, ["route_id", order], "left_semi")


def data_quality_report(
    routes: DataFrame, raw_stops: DataFrame, raw_sequence: DataFrame, raw_packages: DataFrame
) -> DataFrame:
    """Agreement of each route's stop, sequence and package-stop sets, and whether it can be used for training.

    The sets are compared by counting (route, stop) presence, so no set is ever gathered into one row.
    """
    tags = ("in_route", "in_sequence", "in_package")

    def presence(rows: DataFrame, tag: str) -> DataFrame:
        flags = [F.lit(1 if t == tag else 0).alias(t) for t in tags]
        return latest_per_route(rows).select("route_id", "stop_id", *flags)

    parts = [presence(raw_stops, "in_route"), presence(raw_sequence, "in_sequence"), presence(raw_packages, "in_package")]
    per_stop = (
        reduce(DataFrame.unionByName, parts).groupBy("route_id", "stop_id").agg(*[F.max(t).alias(t) for t in tags])
    )
    stop = F.col("stop_id").isNotNull()
    per_route = per_stop.groupBy("route_id").agg(
        F.max("in_sequence").alias("has_sequence"),
        _count(stop & (F.col("in_route") == 1)).alias("route_stop_count"),
        _count(stop & (F.col("in_sequence") == 1)).alias("sequence_stop_count"),
        _count(stop & (F.col("in_package") == 1)).alias("package_stop_count"),
        _count(stop & (F.col("in_package") == 1) & (F.col("in_route") == 0)).alias("package_stops_not_in_route_count"),
        _count(stop & (F.col("in_route") != F.col("in_sequence"))).alias("differing"),
    )
    zero = F.lit(0).cast("long")
    joined = latest_per_route(routes).select("route_id", "number_of_station_stops").join(per_route, "route_id", "left")
    has_sequence = F.coalesce(F.col("has_sequence") == 1, F.lit(False))
    single = F.col("number_of_station_stops") == 1
    matches = F.coalesce(F.col("differing"), zero) == 0
    n_seq, n_route = F.coalesce("sequence_stop_count", zero), F.coalesce("route_stop_count", zero)
    return joined.select(
        "route_id",
        has_sequence.alias("route_exists_in_actual_sequences"),
        n_seq.alias("sequence_stop_count"),
        n_route.alias("route_stop_count"),
        matches.alias("sequence_matches_route_stops"),
        F.coalesce("package_stop_count", zero).alias("package_stop_count"),
        F.coalesce("package_stops_not_in_route_count", zero).alias("package_stops_not_in_route_count"),
        "number_of_station_stops",
        single.alias("has_single_station"),
        (has_sequence & (n_seq == n_route) & matches & single).alias("can_use_for_training"),
    )


def missing_value_summary(routes: DataFrame, raw_packages: DataFrame) -> DataFrame:
    """Missing count, total and ratio of the five cleaned fields."""
    zone = (
        latest_per_route(routes)
        .agg(F.sum("missing_zone_count").alias("m"), F.sum("number_of_stops").alias("t"))
        .select(
            F.lit("zone_id").alias("field"),
            F.coalesce("m", F.lit(0).cast("long")).alias("missing_count"),
            F.coalesce("t", F.lit(0).cast("long")).alias("total_count"),
        )
    )
    return zone.unionByName(package_missing_counts(raw_packages)).withColumn(
        "missing_ratio", S.ratio(F.col("missing_count"), F.col("total_count"))
    )


def run_counters(tables: dict[str, DataFrame], quality: DataFrame) -> DataFrame:
    """metric, value rows: rows of each table and the number of usable routes."""
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(f"{n}_rows").alias("metric"), "value") for n, df in tables.items()]
    usable = quality.agg(_count(F.col("can_use_for_training")).alias("value"))
    parts.append(usable.select(F.lit("usable_routes").alias("metric"), "value"))
    return reduce(DataFrame.unionByName, parts)
