"""Declared schemas of the raw files and of every table the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}


def table(spec: str) -> T.StructType:
    """Schema from ``name:kind`` words; kinds are s(tring), l(ong), d(ouble), b(oolean)."""
    fields = [w.split(":") for w in spec.split()]
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in fields])


ROUTES_SUMMARY = table(
    "route_id:s station_code:s date_YYYY_MM_DD:s departure_time_utc:s executor_capacity_cm3:d route_score:s "
    "number_of_stops:l station_stop_id:s number_of_station_stops:l number_of_dropoff_stops:l "
    "missing_zone_count:l missing_zone_ratio:d"
)
STOPS_BASE_FEATURES = table(
    "route_id:s stop_id:s lat:d lng:d type:s zone_id:s zone_missing:l is_station:l is_dropoff:l"
)
ACTUAL_TRANSITIONS = table("route_id:s from_stop:s to_stop:s position:l label:l")
STOP_PACKAGE_FEATURES = table(
    "route_id:s stop_id:s package_count:l total_planned_service_time:d has_time_window:l "
    "time_window_package_count:l total_package_volume_cm3:d delivered_count:l attempted_count:l "
    "rejected_count:l unknown_status_count:l"
)
DATA_QUALITY_REPORT = table(
    "route_id:s route_exists_in_actual_sequences:b sequence_stop_count:l route_stop_count:l "
    "sequence_matches_route_stops:b package_stop_count:l package_stops_not_in_route_count:l "
    "number_of_station_stops:l has_single_station:b can_use_for_training:b"
)
MISSING_VALUE_SUMMARY = table("field:s missing_count:l total_count:l missing_ratio:d")
EDGES = table("route_id:s from_stop:s to_stop:s travel_time:d source:s")
SOURCE_LOOKUP = table(
    "route_id:s found_in_training_build:b found_in_training_apply:b found_in_evaluation_apply:b "
    "travel_time_source:s source_count:l source_status:s"
)
TRANSITION_TRAVEL_TIME = table(
    "route_id:s from_stop:s to_stop:s position:l travel_time_ij:d travel_time_missing:l travel_time_source:s"
)
ROUTE_SPLITS = table("route_id:s route_score:s split:s")
PAIRWISE_SAMPLES = table(
    "route_id:s split:s position:l current_stop:s candidate_stop:s actual_next_stop:s label:l route_score:s "
    "number_of_stops:l route_progress:d remaining_stop_count:l current_zone:s current_type:s "
    "current_is_station:l current_is_dropoff:l candidate_zone:s candidate_type:s candidate_is_station:l "
    "candidate_is_dropoff:l travel_time_ij:d same_zone:l zone_changed:l zone_missing_in_pair:l "
    "candidate_package_count:d candidate_total_planned_service_time:d candidate_has_time_window:l "
    "candidate_time_window_package_count:d candidate_total_package_volume_cm3:d candidate_delivered_count:d "
    "candidate_attempted_count:d candidate_rejected_count:d candidate_unknown_status_count:d "
    "negative_sampling_seed:l negative_sample_rank:l travel_time_source:s generation_timestamp:s"
)
WEIGHTS = ("travel_weight", "preference_weight", "zone_weight", "time_window_weight", "workload_weight")
ROUTE_METRICS = table(
    "split:s route_id:s method:s weight_id:s travel_weight:d preference_weight:d zone_weight:d "
    "time_window_weight:d workload_weight:d stop_count:l actual_total_travel_time:d "
    "generated_total_travel_time:d travel_time_ratio_to_actual:d lcs_similarity:d position_match_ratio:d "
    "generated_same_zone_ratio:d actual_same_zone_ratio:d zone_change_count:l route_valid:b"
)
GENERATED_ROUTES = table("split:s route_id:s method:s position:l stop_id:s")

# Raw nested files: one JSON object keyed by route id, or JSON Lines with one {route_id, body} per line.
RAW_STOP = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("type", T.StringType()),
        T.StructField("zone_id", T.StringType()),
    ]
)
RAW_ROUTE = T.StructType(
    [
        T.StructField("station_code", T.StringType()),
        T.StructField("date_YYYY_MM_DD", T.StringType()),
        T.StructField("departure_time_utc", T.StringType()),
        T.StructField("executor_capacity_cm3", T.DoubleType()),
        T.StructField("route_score", T.StringType()),
        T.StructField("stops", T.MapType(T.StringType(), RAW_STOP)),
    ]
)
RAW_SEQUENCE = T.StructType([T.StructField("actual", T.MapType(T.StringType(), T.DoubleType()))])
RAW_PACKAGE = T.StructType(
    [
        T.StructField("planned_service_time_seconds", T.DoubleType()),
        T.StructField(
            "time_window",
            T.StructType(
                [T.StructField("start_time_utc", T.StringType()), T.StructField("end_time_utc", T.StringType())]
            ),
        ),
        T.StructField("dimensions", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("scan_status", T.StringType()),
    ]
)
RAW_PACKAGES = T.MapType(T.StringType(), T.MapType(T.StringType(), RAW_PACKAGE))
RAW_TRAVEL_TIMES = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
