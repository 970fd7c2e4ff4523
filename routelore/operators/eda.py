"""Exploratory summaries of routes, stops, packages and transition features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.distribution import (
    adjusted_skewness,
    counts_with_share,
    describe,
    equal_width_bins,
    long_form,
    quantiles,
    summary,
)
from routelore.operators.ordering import side_by_side

# Order of route scores, burden columns, and numeric features of the correlation report.
SCORE_ORDER = ("High", "Medium", "Low")
BURDEN_COLUMNS = ("package_count", "total_planned_service_time", "total_package_volume_cm3")
NUMERIC_FEATURES = (
    "travel_time_ij",
    "route_progress",
    "same_zone_numeric",
    "zone_changed_numeric",
    "to_package_count",
    "to_total_planned_service_time",
    "to_has_time_window",
    "to_time_window_package_count",
    "to_total_package_volume_cm3",
)
TRAVEL_QUANTILES = {"1%": 0.01, "5%": 0.05, "25%": 0.25, "50%": 0.50, "75%": 0.75, "95%": 0.95, "99%": 0.99}


def overall_and_by_score(df: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over all rows ("overall"/"All") and per route_score, in one pass over the rows."""
    grouped = df.groupingSets([[], [F.col("route_score")]], F.col("route_score")).agg(
        F.grouping("route_score").alias("__all"), *aggregates
    )
    names = [c for c in grouped.columns if c not in ("route_score", "__all")]
    whole = F.col("__all") == 1
    return grouped.select(
        F.when(whole, "overall").otherwise("by_route_score").alias("analysis_level"),
        F.when(whole, "All").otherwise(F.col("route_score")).alias("route_score"),
        *names,
    )


def route_score_distribution(routes: DataFrame) -> DataFrame:
    named = routes.select(F.coalesce("route_score", F.lit("Missing")).alias("route_score"))
    return counts_with_share(named, "route_score")


def training_flag_summary(quality: DataFrame) -> DataFrame:
    """metric, value, count, percentage for three boolean quality flags."""
    metrics = ("can_use_for_training", "has_single_station", "sequence_matches_route_stops")
    pairs = [F.struct(F.lit(m).alias("metric"), S.to_bool(F.col(m)).alias("value")) for m in metrics]
    counted = (
        quality.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.metric", "p.value").agg(F.count("*").alias("count"))
    )
    totals = counted.groupBy("metric").agg(F.sum("count").alias("__t"))
    return counted.join(totals, "metric").select(
        "metric", "value", "count", S.percent_of(F.col("count"), F.col("__t")).alias("percentage")
    )


def zone_missing_summary(stops: DataFrame, routes: DataFrame) -> DataFrame:
    joined = stops.join(routes.select("route_id", "route_score"), "route_id", "left")
    missing = S.flag(S.to_bool(F.col("zone_missing")))
    return overall_and_by_score(
        joined,
        [
            F.count("*").alias("total_stops"),
            F.sum(missing).alias("missing_zone_count"),
            F.avg(missing).alias("missing_zone_ratio"),
        ],
    )


def package_feature_summary(packages: DataFrame) -> DataFrame:
    return describe(packages, BURDEN_COLUMNS)


def time_window_summary(packages: DataFrame) -> DataFrame:
    flags = packages.select(F.coalesce(F.col("has_time_window"), F.lit(0).cast("long")).alias("has_time_window"))
    return counts_with_share(flags, "has_time_window")


def same_zone_summary(zoned_transitions: DataFrame, routes: DataFrame) -> DataFrame:
    """Transitions, same-zone transitions and ratio, overall and by score. Input: features.with_zone_match rows."""
    joined = zoned_transitions
    if "route_score" not in joined.columns:
        joined = joined.join(routes.select("route_id", "route_score"), "route_id", "left")
    same = S.flag(F.col("same_zone"))
    return overall_and_by_score(
        joined,
        [
            F.count("*").alias("transition_count"),
            F.sum(same).alias("same_zone_transition_count"),
            F.avg(same).alias("same_zone_ratio"),
        ],
    )


def zone_continuity_overall(features: DataFrame) -> DataFrame:
    """One row of transition, same-zone, changed and missing counts."""
    return features.agg(
        F.count("*").alias("transition_count"),
        F.count_if("same_zone").alias("same_zone_transition_count"),
        F.count_if("zone_changed").alias("zone_changed_transition_count"),
        F.count_if("zone_missing_in_transition").alias("zone_missing_transition_count"),
        S.ratio(F.count_if("same_zone"), F.count("*")).alias("same_zone_ratio"),
    )


def stats_by(df: DataFrame, key: str, value: str, probabilities: dict[str, float], count_name: str, extra: Sequence[str] = ()) -> DataFrame:
    """Count of non-null values, mean, named quantiles and further moments of one column per group."""
    out = summary(df.select(key, F.col(value).cast("double").alias("value")), [key], probabilities)
    return out.select(key, F.col("count").alias(count_name), "mean", *probabilities, *extra)


def travel_time_by_score(features: DataFrame) -> DataFrame:
    return stats_by(features, "route_score", "travel_time_ij", {"median": 0.5, "p95": 0.95}, "transition_count")


def travel_time_by_same_zone(features: DataFrame) -> DataFrame:
    return stats_by(features, "same_zone", "travel_time_ij", {"median": 0.5, "p95": 0.95}, "transition_count")


def travel_time_summary(features: DataFrame) -> DataFrame:
    out = describe(features, ["travel_time_ij"], TRAVEL_QUANTILES)
    return out.withColumnRenamed("travel_time_ij", "value")


def progress_by_time_window(frame: DataFrame) -> DataFrame:
    """Route progress statistics of stops with and without a time window."""
    return stats_by(frame, "has_time_window", "route_progress", {"median": 0.5}, "count", ("std", "min", "max"))


def progress_quartiles_by_time_window(features: DataFrame) -> DataFrame:
    named = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    return stats_by(features, "to_has_time_window", "route_progress", named, "transition_count")


def time_window_rate_by_bin(features: DataFrame, bins: int = 10) -> DataFrame:
    binned = equal_width_bins(features.select("route_progress", "to_has_time_window"), "route_progress", bins)
    return binned.groupBy("bin", "bin_low", "bin_high").agg(
        F.count("to_has_time_window").alias("transition_count"),
        F.avg("to_has_time_window").alias("time_window_stop_rate"),
    )


def burden_by_bin(frame: DataFrame, bins: int = 10) -> DataFrame:
    """Mean burden columns per progress bin."""
    binned = equal_width_bins(frame.select("route_progress", *BURDEN_COLUMNS), "route_progress", bins)
    return binned.groupBy("bin", "bin_low", "bin_high").agg(
        F.count("*").alias("transition_count"), *[F.avg(c).alias(c) for c in BURDEN_COLUMNS]
    )


def burden_stats_by_bin(features: DataFrame, bins: int = 10) -> DataFrame:
    """Count, mean, median and p95 of each destination burden column per progress bin, flattened names."""
    cols = [f"to_{c}" for c in BURDEN_COLUMNS]
    binned = equal_width_bins(features.select("route_progress", *cols), "route_progress", bins)
    tall = summary(long_form(binned, ["bin"], cols), ["bin", "feature"], {"median": 0.5, "p95": 0.95})
    picks = [
        F.max(F.when(F.col("feature") == c, F.col(s))).alias(f"{c}_{s}")
        for c in cols
        for s in ("count", "mean", "median", "p95")
    ]
    return tall.groupBy("bin").agg(*picks)


def score_feature_comparison(features: DataFrame) -> DataFrame:
    return features.groupBy("route_score").agg(
        F.count("route_id").alias("transition_count"),
        F.avg("travel_time_ij").alias("average_travel_time_ij"),
        F.avg(S.flag(F.col("same_zone"))).alias("same_zone_ratio"),
        F.avg("to_package_count").alias("average_to_package_count"),
        F.avg("to_total_planned_service_time").alias("average_to_total_planned_service_time"),
        F.avg("to_total_package_volume_cm3").alias("average_to_total_package_volume_cm3"),
        F.avg("to_has_time_window").alias("time_window_stop_ratio"),
    )


def eda_dataset_summary(
    routes: DataFrame,
    stops: DataFrame,
    packages: DataFrame,
    clean: DataFrame,
    complete: DataFrame,
    complete_transitions: DataFrame,
) -> DataFrame:
    """One row of eleven totals and averages; the score distribution is a JSON text with sorted keys."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    scores = route_score_distribution(routes).agg(
        F.array_sort(F.collect_list(F.struct("route_score", "count"))).alias("e")  # one entry per score category
    )
    return side_by_side(
        routes.agg(F.count("*").alias("total_routes"), F.avg("number_of_stops").alias("average_stops_per_route")),
        rows(clean, "total_clean_transitions"),
        rows(complete, "total_complete_routes"),
        rows(complete_transitions, "total_complete_route_transitions"),
        rows(stops, "total_stops"),
        packages.agg(
            F.count("*").alias("total_package_stop_rows"),
            F.avg("package_count").alias("average_package_count_per_stop"),
            F.avg("total_planned_service_time").alias("average_service_time_per_stop"),
            (F.avg("has_time_window") * 100).alias("percentage_stops_with_time_window"),
        ),
        scores.select(F.to_json(F.map_from_entries("e")).alias("route_score_distribution")),
    )


def feature_justification(features: DataFrame) -> DataFrame:
    """Evidence text and recommended use of seven candidate features."""
    window = F.col("to_has_time_window")
    base = features.agg(
        S.ratio(F.count_if(F.col("travel_time_ij").isNull()), F.count("*")).alias("travel_missing"),
        F.coalesce(F.avg("travel_time_ij"), F.lit(0.0)).alias("travel_mean"),
        S.ratio(F.count_if("same_zone"), F.count("*")).alias("same_zone"),
        F.coalesce(F.avg(window), F.lit(0.0)).alias("window_rate"),
        F.coalesce(
            F.abs(
                F.avg(F.when(window == 1, F.col("route_progress"))) - F.avg(F.when(window == 0, F.col("route_progress")))
            ),
            F.lit(0.0),
        ).alias("window_gap"),
        F.coalesce(F.avg("to_package_count"), F.lit(0.0)).alias("packages"),
        F.coalesce(F.avg("to_total_planned_service_time"), F.lit(0.0)).alias("service"),
        F.coalesce(F.avg("to_total_package_volume_cm3"), F.lit(0.0)).alias("volume"),
        F.coalesce(adjusted_skewness(F.col("to_total_package_volume_cm3")), F.lit(0.0)).alias("volume_skew"),
    )
    middle = quantiles(features.select(F.col("travel_time_ij").alias("value")), [], {"travel_median": 0.5}).agg(
        F.coalesce(F.max("travel_median"), F.lit(0.0)).alias("travel_median")
    )
    one = side_by_side(base, middle)
    # Feature, evidence pattern and its numbers, test for core use, use when it fails, explanation.
    rules = (
        ("travel_time_ij", "Missing rate after cleaning is %.4f; mean is %.2f; median is %.2f.",
         ("travel_missing", "travel_mean", "travel_median"), F.lit(True), "core_feature",
         "Travel time is central to route cost and has very low missingness after multi-source verification."),
        ("same_zone / zone_changed", "Overall same-zone transition ratio is %.4f.", ("same_zone",),
         F.col("same_zone") >= 0.20, "secondary_feature",
         "Zone continuity captures whether a transition stays in the same delivery area or crosses zones."),
        ("to_has_time_window", "Time-window transition rate is %.4f; route-progress mean difference is %.4f.",
         ("window_rate", "window_gap"), F.col("window_gap") >= 0.05, "secondary_feature",
         "Time-window stops can represent route-position risk and delivery timing constraints."),
        ("to_package_count", "Average destination package count is %.2f.", ("packages",), F.col("packages") > 0,
         "not_recommended", "Package count is a direct stop workload feature."),
        ("to_total_planned_service_time", "Average destination planned service time is %.2f.", ("service",),
         F.col("service") > 0, "secondary_feature", "Planned service time captures expected stop handling burden."),
        ("to_total_package_volume_cm3", "Average destination package volume is %.2f; skewness is %.2f.",
         ("volume", "volume_skew"), F.lit(False), "secondary_feature",
         "Package volume may be useful but can be highly skewed, so it should be reviewed before modeling."),
        ("scan_status / unknown_status_count",
         "Earlier missing-value analysis showed high missingness for scan status.", (), F.lit(False), "auxiliary_only",
         "Use scan-status-derived fields for diagnostics rather than as primary driver preference features."),
    )
    rows = [
        F.struct(
            F.lit(name).alias("feature_name"),
            F.format_string(text, *[F.col(a) for a in args]).alias("evidence_from_eda"),
            F.when(core, "core_feature").otherwise(otherwise).alias("recommended_use"),
            F.lit(why).alias("explanation"),
        )
        for name, text, args, core, otherwise, why in rules
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def input_column_check(tables: dict[str, DataFrame], rules: dict[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Per table: present and missing required and optional columns, distinct routes, and status."""
    parts = []
    for name, df in tables.items():
        required, optional = rules[name]
        lacking = [c for c in required if c not in df.columns]
        absent = [c for c in optional if c not in df.columns]
        routes = F.count_distinct("route_id") if "route_id" in df.columns else F.lit(0).cast("long")
        parts.append(
            df.agg(F.count("*").alias("row_count"), routes.alias("unique_route_id_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                "unique_route_id_count",
                F.lit(",".join(lacking)).alias("missing_required_columns"),
                F.lit(",".join(absent)).alias("missing_optional_columns"),
                F.lit("FAIL" if lacking else "PASS").alias("status"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def split_overlap(splits: DataFrame, samples: int = 20) -> DataFrame:
    """Routes that two splits share: count and the first few ids, for each pair of splits."""
    pairs = (("train", "validation"), ("train", "test"), ("validation", "test"))
    per_route = splits.groupBy("route_id").agg(
        *[F.max(F.col("split") == s).alias(s) for s in ("train", "validation", "test")]
    )
    parts = []
    for a, b in pairs:
        shared = per_route.where(F.col(a) & F.col(b)).select("route_id")
        first = shared.orderBy("route_id").limit(samples).agg(
            F.concat_ws(",", F.array_sort(F.collect_list("route_id"))).alias("sample_overlapping_route_ids")
        )
        count = shared.agg(F.count("*").alias("overlap_count"))
        parts.append(side_by_side(count, first).select(F.lit(f"{a}_{b}").alias("comparison"), "*"))
    return reduce(DataFrame.unionByName, parts)


def score_by_split(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split", "route_score").agg(F.count("*").alias("count"))


def sample_coverage(splits: DataFrame, tables: dict[str, DataFrame], per_split: int = 20) -> DataFrame:
    """Whether the first routes of each split (by id) occur in each table."""
    names = ("train", "validation", "test")
    picked = reduce(
        DataFrame.unionByName,
        [splits.where(F.col("split") == s).select("split", "route_id").orderBy("route_id").limit(per_split) for s in names],
    )
    parts = []
    for name, df in tables.items():
        hit = df.join(F.broadcast(picked.select("route_id")), "route_id", "left_semi").select("route_id").distinct()
        found = hit.withColumn("found", F.lit(True))
        parts.append(
            picked.join(found, "route_id", "left").select(
                F.lit(name).alias("table_name"), "split", "route_id", F.coalesce("found", F.lit(False)).alias("found")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def eda_closing_summary(
    routes: DataFrame, stops: DataFrame, packages: DataFrame, transitions: DataFrame, quality: DataFrame, zoned: DataFrame
) -> DataFrame:
    """One row of the closing figures of the exploratory stage."""
    return side_by_side(
        routes.agg(F.count("*").alias("total_routes")),
        quality.agg(F.count_if(S.to_bool(F.col("can_use_for_training"))).alias("usable_routes")),
        stops.agg(F.count("*").alias("total_stops")),
        transitions.agg(F.count("*").alias("total_transitions")),
        zoned.agg(F.coalesce(F.avg(S.flag(F.col("same_zone"))), F.lit(0.0)).alias("same_zone_transition_ratio")),
        packages.agg(
            (F.coalesce(F.avg(S.flag(F.col("has_time_window") == 1)), F.lit(0.0)) * 100).alias(
                "percentage_of_stops_with_time_windows"
            ),
            F.avg("package_count").alias("average_package_count_per_stop"),
            F.avg("total_planned_service_time").alias("average_service_time_per_stop"),
        ),
    )
