"""Data quality reports over the cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.distribution import long_form, quantiles, summary
from routelore.operators.joins import count_unmatched, left_chain
from routelore.operators.ordering import attach_single_row, side_by_side

ROUTE_OUTLIER_COLUMNS = ("number_of_stops", "executor_capacity_cm3", "missing_zone_ratio")
PACKAGE_OUTLIER_COLUMNS = (
    "package_count",
    "total_planned_service_time",
    "total_package_volume_cm3",
    "time_window_package_count",
)
OUTLIER_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def dataset_consistency(
    routes: DataFrame, stops: DataFrame, transitions: DataFrame, packages: DataFrame, quality: DataFrame
) -> DataFrame:
    """One row of ten row counts and key mismatches between the cleaned tables."""
    stop_keys = stops.select("route_id", "stop_id").distinct()
    package_keys = packages.select("route_id", "stop_id").distinct()
    same = {"route_id": "route_id", "stop_id": "stop_id"}

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    return side_by_side(
        rows(routes, "total_routes_in_routes_summary"),
        rows(quality, "total_routes_in_quality_report"),
        rows(stops, "total_stops"),
        rows(packages, "total_package_stop_rows"),
        rows(transitions, "total_actual_transitions"),
        count_unmatched(
            routes.select("route_id").distinct(), quality, {"route_id": "route_id"}, "routes_missing_from_quality_report"
        ),
        count_unmatched(stop_keys, package_keys, same, "stops_without_package_feature_count"),
        count_unmatched(package_keys, stop_keys, same, "package_features_without_stop_count"),
        count_unmatched(
            transitions, stop_keys, {"route_id": "route_id", "from_stop": "stop_id"}, "transitions_with_missing_from_stop_count"
        ),
        count_unmatched(
            transitions, stop_keys, {"route_id": "route_id", "to_stop": "stop_id"}, "transitions_with_missing_to_stop_count"
        ),
    )


def route_validity(quality: DataFrame) -> DataFrame:
    """One row: how many routes pass each validity test."""
    usable = S.to_bool(F.col("can_use_for_training"))
    return quality.agg(
        F.count("*").alias("total_routes"),
        F.count_if(S.to_bool(F.col("route_exists_in_actual_sequences"))).alias("routes_with_actual_sequence"),
        F.count_if(F.col("route_stop_count") == F.col("sequence_stop_count")).alias("routes_with_matching_stop_count"),
        F.count_if(S.to_bool(F.col("sequence_matches_route_stops"))).alias("routes_with_matching_stop_ids"),
        F.count_if(S.to_bool(F.col("has_single_station"))).alias("routes_with_single_station"),
        F.count_if(usable).alias("routes_can_use_for_training"),
        F.count_if(~usable).alias("routes_not_usable_for_training"),
        S.percent_of(F.count_if(usable), F.count("*")).alias("usable_route_percentage"),
    )


def unusable_routes(quality: DataFrame, routes: DataFrame) -> DataFrame:
    """Unusable routes with the first reason that applies."""
    reason = (
        F.when(~S.to_bool(F.col("route_exists_in_actual_sequences")), "missing_actual_sequence")
        .when(F.col("route_stop_count") != F.col("sequence_stop_count"), "stop_count_mismatch")
        .when(~S.to_bool(F.col("sequence_matches_route_stops")), "stop_id_mismatch")
        .when(F.col("number_of_station_stops") == 0, "no_station")
        .when(F.col("number_of_station_stops") > 1, "multiple_stations")
        .otherwise("other")
    )
    bad = quality.where(~S.to_bool(F.col("can_use_for_training")))
    return bad.join(routes.select("route_id", "route_score"), "route_id", "left").select(
        "route_id",
        "route_score",
        "route_stop_count",
        "sequence_stop_count",
        "number_of_station_stops",
        "has_single_station",
        "sequence_matches_route_stops",
        reason.alias("reason_not_usable"),
    )


def _bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with low_<c> and high_<c>: quartiles widened by 1.5 interquartile ranges."""
    q = quantiles(long_form(df, [], columns), ["feature"], {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("q1") - 1.5 * spread)).alias(f"low_{c}") for c in columns],
        *[F.max(F.when(F.col("feature") == c, F.col("q3") + 1.5 * spread)).alias(f"high_{c}") for c in columns],
    )


def outlier_summary(df: DataFrame, columns: Sequence[str], extremes: bool = False) -> DataFrame:
    """Per column: statistics, outlier bounds and counts; with ``extremes`` also zero and above-p99 counts.

    Two passes over the rows: one for the statistics, one counting against the resulting few bounds.
    """
    stats = summary(long_form(df, [], columns), ["feature"], OUTLIER_QUANTILES)
    spread = F.col("p75") - F.col("p25")
    stats = stats.withColumn("lower_bound", F.col("p25") - 1.5 * spread).withColumn(
        "upper_bound", F.col("p75") + 1.5 * spread
    )
    limits = stats.agg(
        *[
            F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"{k}__{c}")
            for c in columns
            for k in ("lower_bound", "upper_bound", "p99")
        ]
    )
    against = attach_single_row(df.select(*[S.finite(S.to_number(F.col(c))).alias(c) for c in columns]), limits)
    counted = against.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count_if((F.col(c) < F.col(f"lower_bound__{c}")) | (F.col(c) > F.col(f"upper_bound__{c}"))).alias(
                    "outlier_count"
                ),
                F.count_if(F.col(c) == 0).alias("zero_value_count"),
                F.count_if(F.col(c) > F.col(f"p99__{c}")).alias("extreme_high_value_count"),
            ).alias(f"s_{c}")
            for c in columns
        ]
    )
    counts = counted.select(F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("s")).select("s.*")
    joined = stats.join(counts, "feature")
    out = [
        "feature",
        *[c for c in stats.columns if c != "feature"],
        "outlier_count",
        S.percent_of(F.col("outlier_count"), F.col("count")).alias("outlier_percentage"),
    ]
    if extremes:
        out += [
            "zero_value_count",
            S.percent_of(F.col("zero_value_count"), F.col("count")).alias("zero_value_percentage"),
            "extreme_high_value_count",
            F.col("p99").alias("extreme_high_threshold_p99"),
        ]
    return joined.select(*out)


def with_outlier_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds outlier_flags: the names of the columns in which the row lies outside the bounds, joined by ';'."""
    joined = attach_single_row(df, _bounds(df, columns))

    def outside(c: str):
        v = S.finite(S.to_number(F.col(c)))
        return F.when((v < F.col(f"low_{c}")) | (v > F.col(f"high_{c}")), c)

    return joined.select(*df.columns, F.concat_ws(";", *[outside(c) for c in columns]).alias("outlier_flags"))


def station_sequence_check(routes: DataFrame, quality: DataFrame, transitions: DataFrame) -> DataFrame:
    """Whether the route starts at its station and has one transition less than stops."""
    per_route = transitions.groupBy("route_id").agg(
        F.min_by("from_stop", "position").alias("first_stop_in_actual_sequence"), F.count("*").alias("transition_count")
    )
    joined = left_chain(
        routes.select("route_id", "station_stop_id", "number_of_station_stops", "number_of_stops"),
        [quality.select("route_id", "has_single_station"), per_route],
    )
    zero = F.lit(0).cast("long")
    count = F.coalesce("transition_count", zero)
    expected = F.greatest(F.coalesce(F.col("number_of_stops"), zero) - 1, zero)
    return joined.select(
        "route_id",
        "station_stop_id",
        "number_of_station_stops",
        "has_single_station",
        "first_stop_in_actual_sequence",
        F.col("station_stop_id").eqNullSafe(F.col("first_stop_in_actual_sequence")).alias("station_is_first_stop"),
        count.alias("transition_count"),
        expected.alias("expected_transition_count"),
        (count == expected).alias("transition_count_matches_expected"),
    )


def _stops_with_package_count(stops: DataFrame, packages: DataFrame) -> DataFrame:
    counts = packages.select("route_id", "stop_id", "package_count")
    return stops.join(counts, ["route_id", "stop_id"], "left").select(
        "route_id",
        "stop_id",
        "type",
        F.lower("type").alias("kind"),
        F.coalesce(F.col("package_count"), F.lit(0).cast("long")).alias("package_count"),
    )


def zero_package_dropoffs(stops: DataFrame, packages: DataFrame) -> DataFrame:
    rows = _stops_with_package_count(stops, packages)
    return rows.where((F.col("kind") == "dropoff") & (F.col("package_count") == 0)).drop("kind")


def dropoff_package_check(stops: DataFrame, packages: DataFrame) -> DataFrame:
    """Per route: dropoffs without packages and stations with packages."""
    drop, station = F.col("kind") == "dropoff", F.col("kind") == "station"
    n = F.col("package_count")
    return (
        _stops_with_package_count(stops, packages)
        .groupBy("route_id")
        .agg(
            F.count_if(drop).alias("total_dropoff_stops"),
            F.count_if(drop & (n == 0)).alias("dropoff_stops_with_zero_packages"),
            F.count_if(station & (n > 0)).alias("station_stops_with_packages"),
            F.coalesce(F.sum(F.when(station, n)), F.lit(0)).cast("double").alias("station_package_count"),
        )
        .withColumn(
            "dropoff_zero_package_ratio",
            S.ratio(F.col("dropoff_stops_with_zero_packages"), F.col("total_dropoff_stops")),
        )
    )


# Feature, missing-summary field it follows, row-count table when it has no field, proposed handling,
# highest missing ratio that still allows core use (None: fixed answer), fixed answer, explanation.
RELIABILITY_RULES = (
    ("zone_id", "zone_id", None, "Encode missing as UNKNOWN_ZONE and keep zone_missing flag.", 0.20, None,
     "Zone is important spatial context; use as core only if missingness is not excessive."),
    ("zone_missing", None, "stops", "Use binary flag directly.", None, True,
     "The first-round cleaner creates this explicit indicator for missing zone IDs."),
    ("package_time_window", "package_time_window", None, "Treat missing time window as no specified time window.", None, False,
     "Raw window timestamps are less suitable than the derived has_time_window flag."),
    ("has_time_window", None, "packages", "Use binary flag directly.", None, True,
     "No window means no specified constraint rather than a data error."),
    ("planned_service_time", "planned_service_time", None,
     "Use total_planned_service_time; impute rare missing package-level values as zero or median.", 0.01, None,
     "Core workload feature if package-level missingness is near zero."),
    ("package_dimensions", "package_dimensions", None,
     "Use total_package_volume_cm3 with missing dimensions contributing zero volume; check outliers.", 0.05, None,
     "Volume can be a useful capacity burden feature if dimension missingness is low."),
    ("package_count", None, "packages", "Use numeric stop-level package count directly.", None, True,
     "Package count is a reliable descriptive workload feature from stop-level aggregation."),
    ("total_package_volume_cm3", "package_dimensions", None,
     "Use as core or secondary workload feature after reviewing outliers.", 0.05, None,
     "Derived from dimensions; reliability follows package dimension completeness."),
    ("scan_status", "scan_status", None,
     "Avoid raw scan_status as a core feature; aggregate missing/unknown statuses descriptively.", None, False,
     "Scan status can leak outcome-like information and may have meaningful missingness."),
    ("unknown_status_count", None, "packages", "Use only as an auxiliary descriptive feature.", None, False,
     "Useful for data diagnostics but should not drive core route ordering decisions."),
)


def feature_reliability(missing: DataFrame, stops: DataFrame, packages: DataFrame) -> DataFrame:
    """Handling and core-use advice for ten features, from the measured missing ratios."""
    fields = sorted({r[1] for r in RELIABILITY_RULES if r[1]})
    measured = missing.agg(
        *[F.max(F.when(F.col("field") == f, F.col("missing_count"))).alias(f"m_{f}") for f in fields],
        *[F.max(F.when(F.col("field") == f, F.col("total_count"))).alias(f"t_{f}") for f in fields],
        *[F.max(F.when(F.col("field") == f, F.col("missing_ratio"))).alias(f"r_{f}") for f in fields],
    )
    one = side_by_side(
        measured, stops.agg(F.count("*").alias("n_stops")), packages.agg(F.count("*").alias("n_packages"))
    )
    zero = F.lit(0).cast("long")
    rows = []
    for name, field, counted, handling, limit, fixed, why in RELIABILITY_RULES:
        share = F.coalesce(F.col(f"r_{field}"), F.lit(0.0)) if field else F.lit(0.0)
        rows.append(
            F.struct(
                F.lit(name).alias("feature_name"),
                (F.coalesce(F.col(f"m_{field}"), zero) if field else zero).alias("missing_count"),
                (F.coalesce(F.col(f"t_{field}"), zero) if field else F.col(f"n_{counted}")).alias("total_count"),
                share.alias("missing_ratio"),
                F.lit(handling).alias("proposed_handling"),
                (F.lit(fixed) if limit is None else share <= limit).alias("use_as_core_feature"),
                F.lit(why).alias("explanation"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def training_ready_routes(
    routes: DataFrame,
    quality: DataFrame,
    station_check: DataFrame,
    completeness: DataFrame,
    route_flags: DataFrame,
    dropoff_check: DataFrame,
) -> DataFrame:
    """Recommendation per route: six tests must hold. Severe flags are listed as reasons but do not exclude."""
    joined = left_chain(
        routes.select("route_id", "route_score"),
        [
            quality.select("route_id", "can_use_for_training", "has_single_station", "sequence_matches_route_stops"),
            station_check.select("route_id", "station_is_first_stop", "transition_count_matches_expected"),
            completeness.select("route_id", "has_complete_actual_transition_travel_time"),
            route_flags.select("route_id", "number_of_stops", "missing_zone_ratio"),
            dropoff_check.select("route_id", "dropoff_stops_with_zero_packages"),
        ],
    )
    tests = {
        "can_use_for_training_original": ("can_use_for_training", "first_round_not_usable"),
        "has_single_station": ("has_single_station", "station_count_issue"),
        "sequence_matches_route_stops": ("sequence_matches_route_stops", "stop_id_mismatch"),
        "station_is_first_stop": ("station_is_first_stop", "station_not_first_stop"),
        "transition_count_matches_expected": ("transition_count_matches_expected", "transition_count_mismatch"),
        "has_complete_actual_transition_travel_time": (
            "has_complete_actual_transition_travel_time",
            "missing_actual_transition_travel_time",
        ),
    }
    severe_route = (F.coalesce(F.col("number_of_stops"), F.lit(2)) < 2) | (
        F.coalesce(F.col("missing_zone_ratio"), F.lit(0.0)) >= 1
    )
    severe_package = F.coalesce(F.col("dropoff_stops_with_zero_packages"), F.lit(0)) > 0
    passed = {out: S.to_bool(F.col(src)) for out, (src, _why) in tests.items()}
    recommended = None
    for p in passed.values():
        recommended = p if recommended is None else recommended & p
    reasons = [F.when(~passed[out], why) for out, (_src, why) in tests.items()]
    reasons += [F.when(severe_route, "severe_route_outlier_flag"), F.when(severe_package, "zero_package_dropoff_flag")]
    return joined.select(
        "route_id",
        "route_score",
        *[p.alias(out) for out, p in passed.items()],
        severe_route.alias("severe_route_outlier"),
        severe_package.alias("severe_package_issue"),
        recommended.alias("recommended_for_training"),
        F.concat_ws(";", *reasons).alias("exclusion_reason"),
    )


def quality_closing_summary(
    missing: DataFrame, station_check: DataFrame, dropoff_check: DataFrame, ready: DataFrame, detail: DataFrame
) -> DataFrame:
    """One row of closing figures of the quality stage."""
    fields = ("zone_id", "planned_service_time", "package_dimensions", "scan_status")
    return side_by_side(
        ready.agg(
            F.count("*").alias("total_routes"),
            F.count_if(F.col("recommended_for_training")).alias("recommended_training_ready_routes"),
        ),
        missing.agg(
            *[
                F.coalesce(F.max(F.when(F.col("field") == f, F.col("missing_ratio"))), F.lit(0.0)).alias(f"{f}_missing_ratio")
                for f in fields
            ]
        ),
        detail.agg(S.ratio(F.sum("travel_time_missing"), F.count("*")).alias("travel_time_missing_ratio")),
        station_check.agg(
            F.count_if(~F.col("station_is_first_stop")).alias("routes_station_not_first"),
            F.count_if(~F.col("transition_count_matches_expected")).alias("routes_with_transition_count_mismatch"),
        ),
        dropoff_check.agg(
            F.count_if(F.col("dropoff_stops_with_zero_packages") > 0).alias("routes_with_zero_package_dropoffs")
        ),
    )
