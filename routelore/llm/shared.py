"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from routelore.sources.staging import stage_table

#: Fixed value: the characters that separate words.
SPACES = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_from: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Equality join in which one key may hold a large share of ``big``: its rows are dealt over ``salts`` buckets by a
    hash of ``salt_from`` and each row of ``small`` (one per key) is repeated once per bucket."""
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds the 0-based long ``name`` by ``order`` inside ``keys`` (which hold no nulls), and ``total``, the key's number of rows.
    A key may hold any share of the rows.

    Rows are dealt by ranges of (keys, order) and staged in that order, so a lost executor changes nothing. What is then summed up is
    a row per key and range. Where ``order`` leaves ties, so does the result.
    """
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = stage_table(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    cells = placed.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    shift = cells.select(*keys, "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), *sums)
    return placed.join(shift, [*keys, "__range"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(name), *([total] if total else []))
