"""Travel-time coverage: edge lookup, source discovery and completeness, over one or several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.distribution import quantiles
from routelore.operators.joins import choose_source
from routelore.operators.ordering import side_by_side
from routelore.operators.travel import Travel, route_sources, with_times

# Travel-time sources in priority order, and the labels reports use.
SOURCES = ("training_build", "training_apply", "evaluation_apply")
SOURCE_LABELS = (*SOURCES, "multiple_sources", "missing_source")


def with_travel_time(transitions: DataFrame, travel: Travel, source: str | None = None) -> DataFrame:
    """Adds travel_time_ij and travel_time_missing, of the source in the named column if there may be several."""
    return with_times(transitions, travel, "travel_time_ij", source=source).withColumn(
        "travel_time_missing", S.flag(F.col("travel_time_ij").isNull())
    )


def single_source_detail(transitions: DataFrame, travel: Travel) -> DataFrame:
    cols = ["route_id", "from_stop", "to_stop", "position", "travel_time_ij", "travel_time_missing"]
    return with_travel_time(transitions, travel).select(*cols)


def single_source_completeness(detail: DataFrame) -> DataFrame:
    return (
        detail.groupBy("route_id")
        .agg(
            F.count("*").alias("actual_transition_count_checked"),
            F.sum("travel_time_missing").alias("missing_travel_time_count"),
        )
        .withColumn("has_complete_actual_transition_travel_time", F.col("missing_travel_time_count") == 0)
    )


def _travel_stats(detail: DataFrame) -> DataFrame:
    measured = detail.select(F.col("travel_time_ij").alias("value"))
    zero = F.lit(0.0)
    base = measured.agg(
        F.coalesce(F.avg("value"), zero).alias("average_actual_transition_travel_time"),
        F.coalesce(F.max("value"), zero).alias("max_actual_transition_travel_time"),
    )
    middle = quantiles(measured, [], {"median": 0.5, "p95": 0.95}).agg(
        F.coalesce(F.max("median"), zero).alias("median_actual_transition_travel_time"),
        F.coalesce(F.max("p95"), zero).alias("p95_actual_transition_travel_time"),
    )
    return side_by_side(base, middle)


def single_source_summary(detail: DataFrame) -> DataFrame:
    """One row of transition and route coverage and travel-time statistics."""
    per_route = single_source_completeness(detail)
    zero = F.lit(0).cast("long")
    total, missing = F.sum("actual_transition_count_checked"), F.sum("missing_travel_time_count")
    routes = per_route.agg(
        F.coalesce(total, zero).alias("total_actual_transitions_checked"),
        F.coalesce(total - missing, zero).alias("transitions_with_travel_time"),
        F.coalesce(missing, zero).alias("transitions_missing_travel_time"),
        S.ratio(missing, total).alias("missing_travel_time_ratio"),
        F.count_if(F.col("missing_travel_time_count") > 0).alias("routes_with_any_missing_travel_time"),
        F.count_if(F.col("has_complete_actual_transition_travel_time")).alias(
            "routes_with_complete_actual_transition_travel_time"
        ),
    )
    return side_by_side(routes, _travel_stats(detail))


def source_lookup(route_ids: DataFrame, travel: Travel) -> DataFrame:
    """Which sources hold each route, the display source and its status."""
    found = route_sources(travel).groupBy("route_id").agg(
        *[F.max(F.col("source") == s).alias(f"found_in_{s}") for s in SOURCES]
    )
    flags = [f"found_in_{s}" for s in SOURCES]
    joined = route_ids.select("route_id").distinct().join(found, "route_id", "left")
    joined = joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    count = sum((S.flag(F.col(f)) for f in flags[1:]), S.flag(F.col(flags[0])))
    only = F.when(F.col(flags[0]), SOURCES[0]).when(F.col(flags[1]), SOURCES[1]).otherwise(SOURCES[2])
    return joined.select(
        "route_id",
        *flags,
        F.when(count == 0, "missing_source").when(count > 1, "multiple_sources").otherwise(only).alias("travel_time_source"),
        count.alias("source_count"),
        F.when(count == 0, "route_missing_from_all_travel_time_sources")
        .when(count > 1, "duplicate_route_in_multiple_sources")
        .otherwise("ok_single_source")
        .alias("source_status"),
    )


def multi_source_detail(transitions: DataFrame, travel: Travel, lookup: DataFrame) -> DataFrame:
    """Transitions with the travel time of the source chosen for their route; unmatched ones are kept as missing."""
    chosen = lookup.select("route_id", "travel_time_source", choose_source(lookup).alias("source"))
    joined = with_travel_time(transitions.join(chosen, "route_id", "left"), travel, "source")
    return joined.select(
        "route_id",
        "from_stop",
        "to_stop",
        "position",
        "travel_time_ij",
        "travel_time_missing",
        F.coalesce("travel_time_source", F.lit("missing_source")).alias("travel_time_source"),
    )


def multi_source_completeness(detail: DataFrame) -> DataFrame:
    missing = F.col("transitions_missing_travel_time")
    return (
        detail.groupBy("route_id", "travel_time_source")
        .agg(
            F.count("*").alias("transition_count"),
            F.count("travel_time_ij").alias("transitions_with_travel_time"),
            F.sum("travel_time_missing").alias("transitions_missing_travel_time"),
        )
        .withColumn("missing_travel_time_ratio", S.ratio(missing, F.col("transition_count")))
        .withColumn("has_complete_actual_transition_travel_time", missing == 0)
    )


def multi_source_integrity(lookup: DataFrame, detail: DataFrame) -> DataFrame:
    """One row of sixteen source, coverage and travel-time figures."""
    source = F.col("travel_time_source")
    found = lookup.agg(
        F.count("*").alias("total_routes_checked"),
        *[F.count_if(F.col(f"found_in_{s}")).alias(f"routes_found_in_{s}") for s in SOURCES],
        F.count_if(source == "missing_source").alias("routes_missing_from_all_sources"),
        F.count_if(source == "multiple_sources").alias("routes_in_multiple_sources"),
    )
    zero = F.lit(0).cast("long")
    total, missing = F.sum("transition_count"), F.sum("transitions_missing_travel_time")
    routes = multi_source_completeness(detail).agg(
        F.coalesce(total, zero).alias("total_actual_transitions_checked"),
        F.coalesce(F.sum("transitions_with_travel_time"), zero).alias("transitions_with_travel_time"),
        F.coalesce(missing, zero).alias("transitions_missing_travel_time"),
        S.ratio(missing, total).alias("missing_travel_time_ratio"),
        F.count_if(F.col("has_complete_actual_transition_travel_time")).alias(
            "routes_with_complete_actual_transition_travel_time"
        ),
        F.count_if(F.col("transitions_missing_travel_time") > 0).alias("routes_with_any_missing_travel_time"),
    )
    return side_by_side(found, routes, _travel_stats(detail))


def with_every_category(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Adds a zero row for each listed category that has none."""
    numbers = [c for c in df.columns if c != column]
    zeros = [F.lit(0).cast(df.schema[c].dataType).alias(c) for c in numbers]
    every = df.agg(F.count("*")).select(F.explode(F.array(*[F.lit(x) for x in domain])).alias(column), *zeros)
    return df.unionByName(every).groupBy(column).agg(*[F.max(c).alias(c) for c in numbers])


def source_transition_summary(completeness: DataFrame) -> DataFrame:
    """Route and transition counts per source label; labels without routes are listed with 0."""
    counts = completeness.groupBy("travel_time_source").agg(
        F.count("route_id").alias("route_count"),
        *[F.sum(c).alias(c) for c in ("transition_count", "transitions_with_travel_time", "transitions_missing_travel_time")],
    )
    return with_every_category(counts, "travel_time_source", SOURCE_LABELS).withColumn(
        "missing_travel_time_ratio", S.ratio(F.col("transitions_missing_travel_time"), F.col("transition_count"))
    )


def clean_transitions(detail: DataFrame) -> DataFrame:
    """Transitions that have a travel time."""
    return detail.where(F.col("travel_time_missing") == 0)


def complete_routes(completeness: DataFrame) -> DataFrame:
    """Routes all of whose transitions have a travel time."""
    return completeness.where(F.col("has_complete_actual_transition_travel_time")).select("route_id")


def complete_route_transitions(detail: DataFrame, complete: DataFrame) -> DataFrame:
    return clean_transitions(detail).join(complete, "route_id", "left_semi")
