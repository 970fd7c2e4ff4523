"""Transition-level features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.joins import with_stop_roles

PACKAGE_COLUMNS = (
    "package_count",
    "total_planned_service_time",
    "has_time_window",
    "time_window_package_count",
    "total_package_volume_cm3",
    "unknown_status_count",
    "delivered_count",
    "attempted_count",
    "rejected_count",
)


def with_sequence_progress(transitions: DataFrame) -> DataFrame:
    """Adds route_progress = position / largest position of the route; 0 when that is 0.

    The maximum is an aggregate joined back, not a window, so a long route is combined before the shuffle.
    """
    last = transitions.groupBy("route_id").agg(F.max("position").alias("__last"))
    share = F.try_divide(F.col("position").cast("double"), F.col("__last").cast("double"))
    return transitions.join(last, "route_id").select(
        *transitions.columns, F.coalesce(share, F.lit(0.0)).alias("route_progress")
    )


def with_destination_packages(transitions: DataFrame, packages: DataFrame) -> DataFrame:
    """Adds the destination stop's package_count, service time, volume and window flag, 0 where it has none."""
    cols = ("package_count", "total_planned_service_time", "total_package_volume_cm3", "has_time_window")
    lookup = packages.select("route_id", F.col("stop_id").alias("to_stop"), *cols)
    joined = transitions.join(lookup, ["route_id", "to_stop"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(packages.schema[c].dataType)) for c in cols})


def with_zone_match(transitions: DataFrame, stops: DataFrame, rule: str) -> DataFrame:
    """Adds from/to zones by the given zone rule, and same_zone, zone_changed, zone_missing_in_transition."""
    joined = with_stop_roles(transitions, stops).withColumns(
        {z: S.normalize_zone(F.col(z), rule) for z in ("from_zone", "to_zone")}
    )
    unknown = (F.col("from_zone") == S.UNKNOWN_ZONE) | (F.col("to_zone") == S.UNKNOWN_ZONE)
    return (
        joined.withColumn("zone_missing_in_transition", unknown)
        .withColumn("same_zone", ~F.col("zone_missing_in_transition") & (F.col("from_zone") == F.col("to_zone")))
        .withColumn("zone_changed", ~F.col("zone_missing_in_transition") & ~F.col("same_zone"))
    )


def transition_features(transitions: DataFrame, routes: DataFrame, stops: DataFrame, packages: DataFrame) -> DataFrame:
    """Feature row per transition: score, progress, zones, types, flags and destination package features.

    ``transitions`` carries travel_time_ij. Joins run on (route, stop) except the small route header.
    """
    base = transitions.select("route_id", "from_stop", "to_stop", "position", "travel_time_ij")
    headed = base.join(routes.select("route_id", "route_score", "number_of_stops"), "route_id", "left")
    headed = headed.withColumn("route_progress", S.progress_of_stops(F.col("position"), F.col("number_of_stops")))
    zoned = with_zone_match(headed, stops, "exact")
    lookup = packages.select(
        "route_id", F.col("stop_id").alias("to_stop"), *[F.col(c).alias(f"to_{c}") for c in PACKAGE_COLUMNS]
    )
    joined = zoned.join(lookup.hint("merge"), ["route_id", "to_stop"], "left")
    filled = {
        f"to_{c}": F.coalesce(F.col(f"to_{c}"), F.lit(0).cast(packages.schema[c].dataType)) for c in PACKAGE_COLUMNS
    }
    return joined.withColumns(filled).withColumns(
        {"same_zone_numeric": S.flag(F.col("same_zone")), "zone_changed_numeric": S.flag(F.col("zone_changed"))}
    )
