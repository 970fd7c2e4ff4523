"""Key-based lookups, set comparisons and candidate ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from routelore.functions import scalars as S


def left_lookup(df: DataFrame, other: DataFrame, keys: Sequence[str], fill_zero: Sequence[str] = ()) -> DataFrame:
    """Left equi-join; the named added columns become 0 where nothing matched."""
    joined = df.join(other, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(other.schema[c].dataType)) for c in fill_zero})


def left_chain(df: DataFrame, others: Sequence[DataFrame], key: str = "route_id") -> DataFrame:
    """Left joins of several tables on one key."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, df)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the first by ``order``; an aggregate, so a key with many rows is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def with_stop_roles(transitions: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds from_zone, from_type, to_zone and to_type. Of stops that repeat, one with a zone is taken before one without.

    A row per stop compresses well, so a table that looks small enough to broadcast can fill the driver: both meet by sorting."""
    known = F.struct(F.col("zone_id").isNull().alias("a"), F.col("zone_id").alias("b"), F.col("type").alias("c"))
    stops = first_per_key(stops.select("route_id", "stop_id", "zone_id", "type"), ["route_id", "stop_id"], known)
    left = stops.select("route_id", F.col("stop_id").alias("from_stop"), F.col("zone_id").alias("from_zone"), F.col("type").alias("from_type"))
    right = stops.select("route_id", F.col("stop_id").alias("to_stop"), F.col("zone_id").alias("to_zone"), F.col("type").alias("to_type"))
    return transitions.join(left.hint("merge"), ["route_id", "from_stop"], "left").join(right.hint("merge"), ["route_id", "to_stop"], "left")


def count_unmatched(df: DataFrame, other: DataFrame, keys: Mapping[str, str], name: str) -> DataFrame:
    """One row: how many rows of ``df`` have no match; ``keys`` maps its columns to those of ``other``."""
    lookup = other.select(*[F.col(o).alias(mine) for mine, o in keys.items()])
    return df.join(lookup, list(keys), "left_anti").agg(F.count("*").alias(name))


def compare_key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only on the left, only on the right, and on both sides."""
    both = (
        left.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionAll(right.select(key, F.lit(0), F.lit(1)))
        .groupBy(key)
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    return both.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("missing_count"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("extra_count"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("overlap_count"),
    )


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "route_id") -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(key), key, "left_semi")


def outer_join_prefixed(left: DataFrame, right: DataFrame, key: str, prefixes: tuple[str, str]) -> DataFrame:
    """Full outer join with every other column prefixed by its side."""

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])

    return named(left, prefixes[0]).join(named(right, prefixes[1]), key, "outer")


def candidate_ranges(sequence: DataFrame, gap: int) -> DataFrame:
    """Later stops of each decision, as a position range instead of one row per pair.

    ``sequence``: route_id, position, stop_id, sequence_length. Gap 2 leaves out the true next stop (negatives),
    gap 1 gives all unvisited stops. A range is constant size, so a route with many stops stays linear.
    """
    first = F.col("position") + gap
    return sequence.select(
        "route_id",
        "position",
        F.col("stop_id").alias("current_stop"),
        F.when(first < F.col("sequence_length"), first).alias("first_candidate_position"),
        F.when(first < F.col("sequence_length"), F.col("sequence_length") - 1).alias("last_candidate_position"),
        F.greatest(F.lit(0).cast("long"), F.col("sequence_length") - first).alias("candidate_count"),
    )


def nearest_vectors(grid: DataFrame, targets: Sequence[tuple[str, Mapping[str, float | Column]]], rank: str) -> DataFrame:
    """For each named target vector the grid row with least L1 distance, then least maximum distance, then rank.

    The targets are a short list of numbers or expressions that are constant over the grid; each becomes one
    aggregate column, so the grid is read once.
    """

    def value(v) -> Column:
        return v if isinstance(v, Column) else F.lit(float(v))

    picks = []
    for name, vector in targets:
        gaps = [F.abs(F.col(c) - value(v)) for c, v in vector.items()]
        l1 = F.round(reduce(lambda a, b: a + b, gaps), 10)
        linf = F.round(F.greatest(*gaps), 10)
        row = F.struct(
            F.lit(name).alias("target_name"),
            *[value(v).alias(f"target_{c}") for c, v in vector.items()],
            l1.alias("target_l1_distance"),
            linf.alias("target_max_abs_distance"),
            *[F.col(c) for c in grid.columns],
        )
        picks.append(F.min_by(row, F.struct(l1, linf, F.col(rank))))
    return grid.agg(F.array(*picks).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def choose_source(lookup: DataFrame, rule: str = "first_found") -> Column:
    """Travel-time source of a route, from source_lookup columns.

    first_found: highest-priority source that has the route; build_first: training_build for routes in several.
    """
    first = (
        F.when(F.col("found_in_training_build"), "training_build")
        .when(F.col("found_in_training_apply"), "training_apply")
        .when(F.col("found_in_evaluation_apply"), "evaluation_apply")
    )
    if rule == "first_found":
        return first
    if rule == "build_first":
        return F.when(F.col("travel_time_source") == "multiple_sources", "training_build").otherwise(first)
    raise ValueError(f"unknown source rule: {rule}")


def recorded_split_check(ids: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """One row: chosen routes recorded under another split, and chosen routes without any."""
    joined = ids.select("route_id").join(splits.select("route_id", F.col("split").alias("recorded")), "route_id", "left")
    blank = S.text_is_missing(F.col("recorded"))
    return joined.agg(
        F.count_if(~blank & (F.col("recorded") != split)).alias("wrong_split"), F.count_if(blank).alias("no_split")
    )
