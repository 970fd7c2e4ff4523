"""Leak-free route splits, stratified by route score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from routelore.functions import scalars as S
from routelore.operators.ordering import attach_single_row, hash_positions, side_by_side

SPLITS = ("train", "validation", "test")


def validate_ratios(ratios: Sequence[float]) -> None:
    if len(ratios) != 3 or any(r <= 0 for r in ratios) or abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError(f"three positive ratios that sum to 1 are needed, got {list(ratios)}")


def largest_remainder(total: Column, ratios: Sequence[float]) -> list[Column]:
    """Whole-number shares of a total; leftovers go to the largest remainders, the later one on a tie."""
    raw = [total.cast("double") * F.lit(float(r)) for r in ratios]
    base = [F.floor(x) for x in raw]
    rest = [x - b for x, b in zip(raw, base)]
    left = total - reduce(lambda a, b: a + b, base)
    out = []
    for i, r in enumerate(rest):
        ahead = [(o >= r) if j > i else (o > r) for j, o in enumerate(rest) if j != i]
        rank = reduce(lambda a, b: a + b, [a.cast("long") for a in ahead])
        out.append((base[i] + (rank < left).cast("long")).cast("long"))
    return out


def modelling_routes(complete: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct complete routes with their cleaned score."""
    score = routes.groupBy("route_id").agg(F.min(S.clean_route_score(F.col("route_score"))).alias("route_score"))
    joined = complete.select("route_id").distinct().join(score, "route_id", "left")
    return joined.select("route_id", F.coalesce("route_score", F.lit("Missing")).alias("route_score"))


def stratified_split(
    routes: DataFrame, ratios: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 42, rows_per_block: int | None = None
) -> DataFrame:
    """route_id, route_score, split: hash order inside each score, then moved to meet the overall targets exactly.

    Ranks are taken per (score, hash block), so a score that holds most routes is not one task. The rebalancing
    touches at most a few routes per score.
    """
    validate_ratios(ratios)
    hashed = routes.select("route_id", "route_score").withColumn("__h", S.hash_key(seed, F.col("route_id")))
    sizes = hashed.groupBy("route_score").agg(F.count("*").alias("__n"))
    shares = largest_remainder(F.col("__n"), ratios)
    bounds = sizes.select("route_score", shares[0].alias("__a"), (shares[0] + shares[1]).alias("__b"))
    placed = hash_positions(hashed, ["route_score"], "__h", "route_id", rows_per_block).join(bounds, "route_score")
    first = placed.select(
        "route_id",
        "route_score",
        "__h",
        F.when(F.col("position") < F.col("__a"), SPLITS[0])
        .when(F.col("position") < F.col("__b"), SPLITS[1])
        .otherwise(SPLITS[2])
        .alias("split"),
    )
    return _rebalance(first, ratios, rows_per_block)


def _rebalance(first: DataFrame, ratios: Sequence[float], rows_per_block: int | None) -> DataFrame:
    """Moves the highest-hash routes of overfull splits to underfull ones, both in split order."""
    counts = first.agg(F.count("*").alias("__all"), *[F.count_if(F.col("split") == s).alias(f"__c_{s}") for s in SPLITS])
    targets = largest_remainder(F.col("__all"), ratios)
    plan = counts.select(*counts.columns, *[t.alias(f"__t_{s}") for s, t in zip(SPLITS, targets)])
    ranked = attach_single_row(hash_positions(first, ["split"], "__h", "route_id", rows_per_block), plan)
    keep = (
        F.when(F.col("split") == SPLITS[0], F.col(f"__t_{SPLITS[0]}"))
        .when(F.col("split") == SPLITS[1], F.col(f"__t_{SPLITS[1]}"))
        .otherwise(F.col(f"__t_{SPLITS[2]}"))
    )
    over = F.col("position") >= keep
    moved = ranked.where(over)
    # Rounding leaves at most one route per score and split over, so this window is over a handful of rows.
    order = F.when(F.col("split") == SPLITS[0], 0).when(F.col("split") == SPLITS[1], 1).otherwise(2)
    numbered = moved.withColumn("__r", F.row_number().over(W.orderBy(order, "__h", "route_id")) - 1)
    lacking = [F.greatest(F.col(f"__t_{s}") - F.col(f"__c_{s}"), F.lit(0)) for s in SPLITS]
    target = (
        F.when(F.col("__r") < lacking[0], SPLITS[0])
        .when(F.col("__r") < lacking[0] + lacking[1], SPLITS[1])
        .otherwise(SPLITS[2])
    )
    cols = ["route_id", "route_score"]
    return ranked.where(~over).select(*cols, "split").unionByName(numbered.select(*cols, target.alias("split")))


def split_violations(splits: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of violation counts; all zero for a valid split."""
    per_route = splits.groupBy("route_id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s"))
    wanted = expected.select("route_id").distinct()
    return side_by_side(
        wanted.join(per_route, "route_id", "left_anti").agg(F.count("*").alias("missing_routes")),
        per_route.join(wanted, "route_id", "left_anti").agg(F.count("*").alias("extra_routes")),
        per_route.agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicated_rows"),
            F.count_if(F.col("s") > 1).alias("routes_in_several_splits"),
        ),
        splits.agg(F.count_if(~F.col("split").isin(*SPLITS)).alias("rows_with_unknown_split")),
    )


def split_summary(splits: DataFrame) -> DataFrame:
    """Totals per split and score counts within it, with shares of all routes and of the split."""
    counts = splits.groupBy("split", F.coalesce("route_score", F.lit("Missing")).alias("route_score")).agg(
        F.count("*").alias("route_count")
    )
    totals = counts.groupBy("split").agg(F.sum("route_count").alias("split_count"))
    named = counts.agg(F.count("*")).select(F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split"))
    all_rows = counts.agg(F.coalesce(F.sum("route_count"), F.lit(0)).alias("all_count"))
    total_rows = (
        named.join(totals, "split", "left")
        .withColumn("split_count", F.coalesce("split_count", F.lit(0).cast("long")))
        .select(F.lit("split_total").alias("summary_type"), "split", F.lit("ALL").alias("route_score"), F.col("split_count").alias("route_count"), "split_count")
    )
    score_rows = counts.join(totals, "split").select(
        F.lit("route_score_distribution").alias("summary_type"), "split", "route_score", "route_count", "split_count"
    )
    both = attach_single_row(total_rows.unionByName(score_rows), all_rows)
    return both.select(
        "summary_type",
        "split",
        "route_score",
        "route_count",
        S.ratio(F.col("route_count"), F.col("all_count")).alias("percentage_of_all_routes"),
        S.ratio(F.col("route_count"), F.col("split_count")).alias("percentage_within_split"),
    )


def score_by_split_wide(splits: DataFrame) -> DataFrame:
    """Route counts, one row per score and one column per split."""
    return splits.groupBy("route_score").pivot("split", list(SPLITS)).agg(F.count("route_id")).na.fill(0)
