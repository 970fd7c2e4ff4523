"""Pairwise next-stop samples with reproducible negatives, drawn without listing candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.features import PACKAGE_COLUMNS
from routelore.operators.joins import choose_source
from routelore.operators.travel import Travel, end_columns, route_sources, time_between, with_ends, with_times
from routelore.schemas import PAIRWISE_SAMPLES


def stop_sequence(transitions: DataFrame) -> DataFrame:
    """route_id, position, stop_id, next_stop and sequence_length of every stop, from consecutive transitions.

    Positions are renumbered 0..n-1, so transitions may number them from anywhere as long as they are consecutive.
    """
    ends = transitions.groupBy("route_id").agg(
        F.max_by("to_stop", "position").alias("stop_id"),
        F.max("position").alias("__last"),
        F.min("position").alias("__first"),
    )
    last = ends.select("route_id", (F.col("__last") + 1).alias("position"), "stop_id", F.lit(None).cast("string").alias("next_stop"))
    length = ends.select("route_id", "__first", (F.col("__last") - F.col("__first") + 2).alias("sequence_length"))
    stops = transitions.select(
        "route_id", "position", F.col("from_stop").alias("stop_id"), F.col("to_stop").alias("next_stop")
    )
    return (
        stops.unionByName(last)
        .join(length, "route_id")
        .select("route_id", (F.col("position") - F.col("__first")).alias("position"), "stop_id", "next_stop", "sequence_length")
    )


def sequence_blocks(sequence: DataFrame, size: int = 1000) -> DataFrame:
    """Ordered stop ids as arrays of at most ``size`` stops, so that no array grows with the route."""
    entry = F.struct("position", "stop_id")
    return (
        sequence.groupBy("route_id", F.floor(F.col("position") / size).cast("long").alias("block"))
        .agg(F.array_sort(F.collect_list(entry)).alias("e"))
        .select("route_id", "block", F.transform("e", lambda x: x["stop_id"]).alias("stop_ids"))
    )


def sample_draws(sequence: DataFrame, negatives: int, seed: int) -> DataFrame:
    """One row per positive and drawn negative: decision, candidate position, label and rank (positive: rank 0).

    Negatives are drawn without replacement from the stops after the next one. Draw i takes a hashed number below
    (candidates - k + i) and falls back to that upper end if it is already taken, which gives every k-subset the same
    chance with k hashes per decision, whatever the number of candidates; no candidate pair is ever listed.
    """
    base = sequence.where(F.col("position") < F.col("sequence_length") - 1)
    context = [F.col("route_id"), F.col("position")]
    total = F.greatest(F.col("sequence_length") - F.col("position") - 2, F.lit(0).cast("long"))
    drawn = base.withColumn("__total", total)
    names = [f"__d{i}" for i in range(1, negatives + 1)]
    for i, name in enumerate(names, start=1):
        # One projection per draw: each refers to the earlier columns instead of repeating their expressions.
        top = F.col("__total") - F.least(F.lit(negatives).cast("long"), F.col("__total")) + i
        h = F.pmod(S.hash_number(seed, *context, F.lit(i)), F.greatest(top, F.lit(1).cast("long")))
        drawn = drawn.withColumn(f"__h{i}", h)
        taken = F.lit(False)
        for earlier in names[: i - 1]:
            taken = taken | F.coalesce(F.col(f"__h{i}") == F.col(earlier), F.lit(False))
        within = F.lit(i) <= F.least(F.lit(negatives).cast("long"), F.col("__total"))
        drawn = drawn.withColumn(name, F.when(within, F.when(taken, top - 1).otherwise(F.col(f"__h{i}"))))
    rows = [F.struct((F.col("position") + 1).alias("at"), F.lit(0).cast("long").alias("rank"))]
    rows += [
        F.struct((F.col("position") + 2 + F.col(n)).alias("at"), F.lit(i).cast("long").alias("rank"))
        for i, n in enumerate(names, start=1)
    ]
    exploded = drawn.select(*sequence.columns, F.explode(F.array(*rows)).alias("__r"))
    return exploded.where(F.col("__r.at").isNotNull()).select(
        *sequence.columns,
        F.col("__r.at").alias("candidate_position"),
        S.flag(F.col("__r.rank") == 0).alias("label"),
        F.col("__r.rank").alias("negative_sample_rank"),
    )


def _stop_attributes(stops: DataFrame, packages: DataFrame) -> DataFrame:
    """Zone, type, flags and package features per stop, from whichever of the two tables knows it."""
    base = stops.select("route_id", "stop_id", "zone_id", "type", "is_station", "is_dropoff")
    known = base.join(packages.select("route_id", "stop_id", *PACKAGE_COLUMNS), ["route_id", "stop_id"], "full")
    zero = F.lit(0).cast("long")
    return known.select(
        "route_id",
        "stop_id",
        S.normalize_zone(F.col("zone_id")).alias("zone"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("is_station", zero).alias("is_station"),
        F.coalesce("is_dropoff", zero).alias("is_dropoff"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PACKAGE_COLUMNS],
    )


def requested_routes(splits: DataFrame, routes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Split routes with score, stop count and chosen travel-time source (null when they have none)."""
    headers = routes.select(
        "route_id", S.clean_route_score(F.col("route_score")).alias("route_score"), "number_of_stops"
    )
    sources = lookup.select("route_id", choose_source(lookup, "build_first").alias("source"))
    joined = splits.select("route_id", "split").join(headers, "route_id", "left").join(sources, "route_id", "left")
    return joined.withColumn("route_score", F.coalesce("route_score", F.lit("Missing")))


def attributed_sequence(transitions: DataFrame, stops: DataFrame, packages: DataFrame, requested: DataFrame) -> DataFrame:
    """The stops of the requested routes in order, with the route's header and each stop's attributes."""
    routed = stop_sequence(transitions).join(requested, "route_id")
    stops_or_length = F.when(F.coalesce("number_of_stops", F.lit(0)) != 0, F.col("number_of_stops")).otherwise(
        F.col("sequence_length")
    )
    return routed.join(_stop_attributes(stops, packages), ["route_id", "stop_id"], "left").withColumns(
        {
            "number_of_stops": stops_or_length,
            "zone": F.coalesce("zone", F.lit(S.UNKNOWN_ZONE)),
            "type": F.coalesce("type", F.lit("")),
            "is_station": F.coalesce("is_station", F.lit(0).cast("long")),
            "is_dropoff": F.coalesce("is_dropoff", F.lit(0).cast("long")),
            **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in PACKAGE_COLUMNS},
        }
    )


def candidate_rows(
    transitions: DataFrame,
    travel: Travel,
    stops: DataFrame,
    packages: DataFrame,
    requested: DataFrame,
    negatives: int = 5,
    seed: int = 42,
    generation_timestamp: str = "",
) -> DataFrame:
    """All drawn positives and negatives with features; travel_time_ij is null where the matrix lacks the edge.

    Attributes join to the stops once, before drawing, and so do the columns that travel times follow from. The draws then meet stops by
    (route, position), and listed travel times by the pair, so the work is (1 + negatives) rows per decision, shuffled once unless times
    are listed, and no key is as coarse as a route. What is the same for all of a route comes with the candidate, a row per stop.
    """
    known = with_ends(attributed_sequence(transitions, stops, packages, requested.where(F.col("source").isNotNull())), travel)
    ends = end_columns(travel)
    header = ["split", "route_score", "number_of_stops", "source", "sequence_length", *["__known" for _ in ends[:1]]]
    side = ["zone", "type", "is_station", "is_dropoff"]
    decisions = known.select(
        "route_id", "position", "sequence_length", "next_stop", F.col("stop_id").alias("current_stop"),
        *[F.col(c).alias(f"current_{c}") for c in side], *[F.col(c).alias(f"current{c}") for c in ends],
    )
    draws = sample_draws(decisions, negatives, seed).drop("sequence_length", "label")
    candidates = known.select(
        "route_id",
        *header,
        F.col("position").alias("candidate_position"),
        F.col("stop_id").alias("candidate_stop"),
        *[F.col(c).alias(f"candidate_{c}") for c in (*side, *PACKAGE_COLUMNS)],
        *[F.col(c).alias(f"candidate{c}") for c in ends],
    )
    pairs = draws.join(candidates, ["route_id", "candidate_position"]).withColumn("label", S.flag(F.col("negative_sample_rank") == 0)).where(
        (F.col("label") == 1) | (F.col("candidate_stop") != F.col("next_stop"))
    )
    if ends:
        timed = pairs.withColumn("travel_time_ij", time_between(travel, "current", "candidate", "current_stop", "candidate_stop", "source"))
    else:
        timed = with_times(pairs, travel, "travel_time_ij", "current_stop", "candidate_stop", "source")
    flags = S.zone_pair_flags(F.col("current_zone"), F.col("candidate_zone"))
    full = timed.withColumns(flags).withColumns(
        {
            "actual_next_stop": F.col("next_stop"),
            "route_progress": S.progress_of_sequence(F.col("position"), F.col("sequence_length")),
            "remaining_stop_count": F.col("sequence_length") - F.col("position") - 1,
            "candidate_has_time_window": F.col("candidate_has_time_window").cast("long"),
            "negative_sampling_seed": F.lit(seed).cast("long"),
            "travel_time_source": F.col("source"),
            "generation_timestamp": F.lit(generation_timestamp),
        }
    )
    return full.select(*PAIRWISE_SAMPLES.fieldNames())


def pairwise_samples(*tables: DataFrame, **options) -> DataFrame:
    """The 36-column sample table: drawn rows that have a travel time."""
    return candidate_rows(*tables, **options).where(F.col("travel_time_ij").isNotNull())


def sample_summary(
    drawn: DataFrame, requested: DataFrame, transitions: DataFrame, travel: Travel, negatives: int = 5, seed: int = 42,
    output_format: str = "parquet",
) -> DataFrame:
    """Per split: routes requested, processed and skipped, and samples written and dropped.

    ``drawn`` are ``candidate_rows``; a route is processed when its source holds it and it has transitions.
    """
    has_matrix = route_sources(travel).withColumn("in_matrix", F.lit(True))
    has_moves = transitions.select("route_id").distinct().withColumn("has_moves", F.lit(True))
    routes = requested.join(has_matrix, ["route_id", "source"], "left").join(has_moves, "route_id", "left")
    seen = F.coalesce("in_matrix", F.lit(False))
    moves = F.coalesce("has_moves", F.lit(False))
    per_split = routes.groupBy("split").agg(
        F.count("*").alias("routes_requested"),
        F.count_if(seen & moves).alias("routes_processed"),
        F.count_if(F.col("source").isNull()).alias("routes_skipped_missing_source"),
        F.count_if(seen & ~moves).alias("routes_skipped_missing_transitions"),
    )
    timed, positive = F.col("travel_time_ij").isNotNull(), F.col("label") == 1
    matched = drawn.join(
        routes.where(seen).select("route_id"), "route_id", "left_semi"
    )
    rows = matched.groupBy("split").agg(
        F.count_if(positive & timed).alias("positive_samples_written"),
        F.count_if(~positive & timed).alias("negative_samples_written"),
        F.count_if(positive & ~timed).alias("skipped_positive_missing_travel_time"),
        F.count_if(~positive & ~timed).alias("skipped_negative_missing_travel_time"),
    )
    counted = [c for c in rows.columns if c != "split"]
    joined = per_split.join(rows, "split", "left").na.fill(0, counted)
    return joined.select(
        "split",
        "routes_requested",
        "routes_processed",
        "routes_skipped_missing_source",
        "routes_skipped_missing_transitions",
        *counted,
        (F.col("positive_samples_written") + F.col("negative_samples_written")).alias("total_samples_written"),
        S.ratio(F.col("negative_samples_written"), F.col("positive_samples_written")).alias("average_negatives_per_positive"),
        F.lit(negatives).cast("long").alias("negative_samples_per_positive_requested"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(output_format).alias("output_format"),
    )


def sample_quality_report(summary: DataFrame) -> DataFrame:
    """check_name, status, value rows from the sample summary."""
    checks = [
        F.struct(
            F.concat(F.col("split"), F.lit(f"_{kind}_samples")).alias("check_name"),
            F.when(F.col(f"{kind}_samples_written") > 0, "PASS").otherwise("FAIL").alias("status"),
            F.col(f"{kind}_samples_written").cast("string").alias("value"),
        )
        for kind in ("positive", "negative")
    ]
    per_split = summary.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    fixed = summary.agg(F.count("*")).select(
        F.lit("label_values_expected").alias("check_name"), F.lit("INFO").alias("status"), F.lit("0/1").alias("value")
    )
    return per_split.unionByName(fixed)


def validate_contexts(samples: DataFrame) -> DataFrame:
    """Per split: rows, decisions, label counts, and decisions without or with several positives."""
    y = F.col("label")
    contexts = samples.groupBy("split", "route_id", "position").agg(
        F.count("*").alias("n"), F.sum(y).alias("p"), F.count_if(~y.isin(0, 1) | y.isNull()).alias("bad")
    )
    return contexts.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("decision_contexts"),
        F.sum("p").alias("positive_rows"),
        (F.sum("n") - F.sum("p")).alias("negative_rows"),
        F.count_if(F.col("p") == 0).alias("contexts_no_positive"),
        F.count_if(F.col("p") == 1).alias("contexts_one_positive"),
        F.count_if(F.col("p") > 1).alias("contexts_multiple_positive"),
        F.count_if(F.col("p") != 1).alias("contexts_not_exactly_one_positive"),
        F.sum("bad").alias("rows_with_invalid_label"),
    )


def training_data_summary(samples: DataFrame) -> DataFrame:
    """Per split: rows, positives and positive rate."""
    return samples.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum("label").alias("positive_rows"),
        S.ratio(F.sum("label"), F.count("*")).alias("positive_rate"),
    )
