"""Positions and running totals that stay distributed when one key holds most of the rows.

A plain window puts all rows of a key into one task. Here a key with many rows is cut into ordered blocks,
the window runs inside each block, and the (few) block totals are added back as offsets. Split points are taken
by hash, not by sampling, so a recomputed task sees the same blocks.

There is one plan for every size: the number of blocks is the number of rows by ``rows_per_block``, so small keys
have one block and need no offsets. Blocks are found in two levels, so that no row meets more split points than about twice the
square root of a key's blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROWS_PER_BLOCK = 500_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match; the right side's key columns are dropped."""
    if not keys:
        return attach_single_row(left, right)
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def attach_single_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame to every row, as an uncorrelated scalar subquery."""
    held = df.withColumn("__row", one_row.select(F.struct(*one_row.columns)).scalar())
    return held.select(*df.columns, "__row.*")


BLOCK = ["__top", "__low"]


def _with_blocks(sized: DataFrame, keys: Sequence[str], value: Column, pick: Column) -> DataFrame:
    """Adds the two levels of a row's block from its key's number of blocks ``__nb`` (null or 1: one block).

    A split is the value of the least hash in each of ``__nb`` hash classes. Of a key's splits in order every sqrt(``__nb``)-th is a top split; those
    that follow it are met by an equality join on (key, top block)."""
    keys = list(keys)
    classes = sized.where(F.col("__nb") > 1).groupBy(*keys, "__nb", F.pmod(F.xxhash64(pick, F.lit(17)), F.col("__nb")).alias("__p"))
    chosen = classes.agg(F.min_by(value, pick).alias("__s"))
    place, step = F.row_number().over(W.partitionBy(*keys).orderBy("__s")) - 1, F.ceil(F.sqrt("__nb")).cast("int")
    placed = chosen.select(*keys, "__s", F.floor(place / step).cast("int").alias("__top"), (place % step).alias("__rest"))

    def index(df: DataFrame, splits: DataFrame, on: list[str], name: str) -> DataFrame:
        listed = splits.groupBy(*on).agg(F.array_sort(F.collect_list("__s")).alias("__splits"))
        at = F.coalesce(F.size(F.filter("__splits", lambda s: s <= value)), F.lit(0))
        return null_safe_join(df, listed, on).withColumn(name, F.when(F.col("__splits").isNull(), 0).otherwise(at)).drop("__splits")

    tagged = index(sized, placed.where("__rest = 0"), keys, "__top")
    return index(tagged, placed.where("__rest > 0").withColumn("__top", F.col("__top") + 1), [*keys, "__top"], "__low")


def shared_blocks(df: DataFrame, value: str, rows_per_block: int | None = None) -> DataFrame:
    """Adds ``__block``, the number of the row's block in the order of ``value``, the same blocks for all keys; equal values share one.

    Splits are picked as in ``_with_blocks`` but listed once, and looked up in two steps without a join."""
    counted = df.agg(F.ceil(F.count("*") / (rows_per_block or ROWS_PER_BLOCK)).cast("long").alias("__nb"))
    pick = F.xxhash64(value)
    classes = attach_single_row(df, counted).where(F.col("__nb") > 1).groupBy(F.pmod(F.xxhash64(pick, F.lit(17)), F.col("__nb")).alias("__p"))
    listed = classes.agg(F.min_by(value, pick).alias("__s")).agg(F.array_sort(F.collect_list("__s")).alias("__splits"))
    stepped = listed.withColumn("__step", F.ceil(F.sqrt(F.size("__splits") + 1)).cast("int"))
    held = attach_single_row(df, stepped.withColumn("__tops", F.filter("__splits", lambda _s, i: (i + 1) % F.col("__step") == 0)))
    upto = lambda splits: F.size(F.filter(splits, lambda s: s <= F.col(value)))
    first = held.withColumn("__first", upto(F.col("__tops")) * F.col("__step"))
    return first.select(*df.columns, (F.col("__first") + upto(F.slice("__splits", F.col("__first") + 1, F.col("__step") - 1))).alias("__block"))


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    following: Mapping[str, str] | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Adds 0-based ``position`` by ``order`` inside ``keys`` and, per ``following``, values of the next row.

    ``order`` must be unique inside a key and its columns non-null. Only keys above ``rows_per_block`` rows are cut
    into blocks; there are at most rows / rows_per_block of them.
    """
    following = dict(following or {})
    keys, order = list(keys), list(order)
    rows_per_block = rows_per_block or ROWS_PER_BLOCK
    value = F.struct(*order)
    pick_hash = F.xxhash64(*order)
    big = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .where(F.col("__n") > rows_per_block)
        .select(*keys, F.ceil(F.col("__n") / rows_per_block).cast("long").alias("__nb"))
    )
    tagged = _with_blocks(df.join(big, keys, "left"), keys, value, pick_hash)
    inside = W.partitionBy(*keys, *BLOCK).orderBy(*order)
    blocks = (
        tagged.where(F.col("__nb").isNotNull())
        .groupBy(*keys, *BLOCK)
        .agg(
            F.count("*").alias("__rows"),
            *[F.min_by(src, value).alias(f"__first_{out}") for out, src in following.items()],
        )
    )
    across = W.partitionBy(*keys).orderBy(*BLOCK)
    offsets = blocks.select(
        *keys,
        *BLOCK,
        F.coalesce(F.sum("__rows").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        *[F.lead(f"__first_{out}").over(across).alias(f"__first_{out}") for out in following],
    )
    ranked = tagged.select(
        *[c for c in df.columns],
        *BLOCK,
        (F.row_number().over(inside) - 1).cast("long").alias("__local"),
        *[F.lead(src).over(inside).alias(f"__next_{out}") for out, src in following.items()],
    )
    return ranked.join(offsets, [*keys, *BLOCK], "left").select(
        *df.columns,
        (F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))).cast("long").alias("position"),
        *[F.coalesce(F.col(f"__next_{out}"), F.col(f"__first_{out}")).alias(out) for out in following],
    )


def running_totals(
    cells: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = False,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Adds ``cum_<m>`` (inclusive, by ``value``) and ``all_<m>`` for each measure of one-row-per-value cells.

    The number of distinct ``keys`` must be small (groups of a report); the cells of a key may be many.
    """
    keys = list(keys)
    way = F.desc if descending else F.asc
    rows_per_block = rows_per_block or ROWS_PER_BLOCK
    sizes = cells.groupBy(*keys).agg(
        F.ceil(F.count("*") / rows_per_block).cast("long").alias("__nb"), *[F.sum(m).alias(f"all_{m}") for m in measures]
    )
    sized = null_safe_join(cells, sizes, keys, "inner")
    tagged = _with_blocks(sized, keys, F.col(value), F.xxhash64(F.col(value)))
    per_block = tagged.groupBy(*keys, *BLOCK).agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    across = W.partitionBy(*keys).orderBy(*map(way, BLOCK)).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, *BLOCK, *[F.coalesce(F.sum(f"__t_{m}").over(across), F.lit(0)).alias(f"__o_{m}") for m in measures]
    )
    inside = W.partitionBy(*keys, *BLOCK).orderBy(way(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = tagged.select(
        *cells.columns,
        *[f"all_{m}" for m in measures],
        *BLOCK,
        *[F.sum(m).over(inside).alias(f"__c_{m}") for m in measures],
    )
    return null_safe_join(local, offsets, [*keys, *BLOCK], "inner").select(
        *cells.columns,
        *[(F.col(f"__c_{m}") + F.col(f"__o_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def _hash_blocks(df: DataFrame, hash_column: str, rows_per_block: int | None) -> DataFrame:
    """Adds ``__block``: as many leading hex digits of the hash as the number of rows asks for, none for few rows."""
    counted = df.agg(F.greatest(F.lit(1.0), F.count("*") / (rows_per_block or ROWS_PER_BLOCK)).alias("__many"))
    digits = F.ceil(F.log(16.0, F.col("__many"))).cast("int")
    return attach_single_row(df, counted).withColumn("__block", F.substring(hash_column, F.lit(1), digits)).drop("__many")


def hash_positions(
    df: DataFrame, keys: Sequence[str], hash_column: str, tie: str, rows_per_block: int | None = None
) -> DataFrame:
    """0-based ``position`` by a hex hash inside ``keys`` (may be empty), in blocks of the hash's first digits."""
    keys = list(keys)
    tagged = _hash_blocks(df, hash_column, rows_per_block)
    local = (F.row_number().over(W.partitionBy(*keys, "__block").orderBy(hash_column, tie)) - 1).cast("long")
    across = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "__block")
        .agg(F.count("*").alias("__rows"))
        .select(*keys, "__block", F.coalesce(F.sum("__rows").over(across), F.lit(0)).alias("__before"))
    )
    ranked = tagged.withColumn("__local", local)
    return null_safe_join(ranked, offsets, [*keys, "__block"], "inner").select(
        *df.columns, (F.col("__local") + F.col("__before")).alias("position")
    )


def hash_running_total(df: DataFrame, measure: str, hash_column: str, tie: str, rows_per_block: int | None = None) -> DataFrame:
    """Adds ``running``: sum of ``measure`` over all rows up to this one in hash order."""
    tagged = _hash_blocks(df, hash_column, rows_per_block)
    inside = W.partitionBy("__block").orderBy(hash_column, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    across = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    offsets = (
        tagged.groupBy("__block")
        .agg(F.sum(measure).alias("__t"))
        .select("__block", F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__before"))
    )
    return (
        tagged.withColumn("__local", F.sum(measure).over(inside))
        .join(offsets, "__block")
        .select(*df.columns, (F.col("__local") + F.col("__before")).alias("running"))
    )


def side_by_side(*one_rows: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames."""
    out = one_rows[0]
    for other in one_rows[1:]:
        out = attach_single_row(out, other)
    return out
