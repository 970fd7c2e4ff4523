"""Seeded samples of rows, decisions and routes. Order and thresholds come from hashes of keys, so a sample does not
depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.ordering import attach_single_row, hash_positions, hash_running_total, ordered_positions


def _below(hashed: DataFrame, share: float) -> DataFrame:
    """Rows whose hash ``__h`` lies in the first ``share`` of all hashes: about that share of the rows, and a prefix of their hash order."""
    return hashed.where(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") < int(min(share, 1.0) * 2**32))


def _first_by_hash(hashed: DataFrame, tie: str, cap: int) -> DataFrame:
    """The ``cap`` rows of least hash ``__h``. Only rows below a threshold are ranked, which the number of rows sets so that ``cap`` of them fall
    below it but for a chance of 1e-9; if they don't, all are ranked."""
    many = hashed.count()
    if many <= cap:
        return hashed
    near = _below(hashed, (cap + 6 * cap**0.5 + 36) / many)
    if near.count() < cap:
        near = hashed
    return hash_positions(near, [], "__h", tie).where(F.col("position") < cap).drop("position")


def sample_rows(
    df: DataFrame, keys: Sequence[str], fraction: float | None = None, max_rows: int | None = None, seed: int = 42
) -> DataFrame:
    """Rows kept with the given chance, then at most ``max_rows`` of them. ``keys`` identify a row.

    The fraction is a filter on the hash, without any shuffle; the cap needs a count, and ranks of little more than ``max_rows`` rows.
    """
    out = df
    hashed = [F.col(k) for k in keys]
    if fraction is not None:
        if not 0 < fraction <= 1:
            raise ValueError("fraction must be greater than 0 and at most 1")
        out = out.where(S.hash_number(seed, *hashed) < int(fraction * 2**32))
    if max_rows is not None and max_rows > 0:
        held = out.select(F.struct(*df.columns).alias("row"), S.hash_key(seed + 1, *hashed).alias("__h"))
        out = _first_by_hash(held, "row", max_rows).select("row.*")
    return out


def sample_contexts(df: DataFrame, keys: Sequence[str], contexts: int | None, seed: int = 42) -> DataFrame:
    """Whole decisions: all rows of ``contexts`` hash-chosen keys."""
    if contexts is None or contexts <= 0:
        return df
    distinct = df.select(*keys).distinct().withColumn("__h", S.hash_key(seed, *[F.col(k) for k in keys]))
    chosen = _first_by_hash(distinct.select(F.struct(*keys).alias("key"), "__h"), "key", contexts).select("key.*")
    return df.join(chosen, list(keys), "left_semi")


def sample_contexts_to_budget(df: DataFrame, keys: Sequence[str], max_rows: int | None, seed: int = 42) -> DataFrame:
    """Whole decisions in hash order while their total rows stay within the budget; at least the first one.

    Decisions below a threshold of the hash are summed up, which holds the budget one and a half times if sizes are even; if
    it doesn't hold it once, all are.
    """
    if max_rows is None or max_rows <= 0:
        return df
    sizes = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    hashed = sizes.select(
        F.struct(*keys).alias("key"), "rows", S.hash_key(seed, *[F.col(k) for k in keys]).alias("__h")
    )
    many, total = hashed.agg(F.count("*"), F.sum("rows")).first()
    if many and total > max_rows:
        near = _below(hashed, 1.5 * max_rows / total + 36 / many)
        hashed = near if (near.agg(F.sum("rows")).first()[0] or 0) > max_rows else hashed
    running = hash_running_total(hashed, "rows", "__h", "key")
    chosen = running.where((F.col("running") <= max_rows) | (F.col("running") == F.col("rows"))).select("key.*")
    return df.join(chosen, list(keys), "left_semi")


def route_id_list(df: DataFrame, order: str, column: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct trimmed route ids by first appearance; the first column is used when there is no route_id."""
    source = column or ("route_id" if "route_id" in df.columns else df.columns[0])
    text = F.trim(F.col(source).cast("string"))
    ids = (
        df.where(~S.text_is_missing(F.col(source).cast("string")))
        .groupBy(text.alias("route_id"))
        .agg(F.min(order).alias("first_seen"))
    )
    return ids.orderBy("first_seen", "route_id").limit(limit) if limit is not None else ids


def first_routes(df: DataFrame, order: str, n: int) -> DataFrame:
    """All rows of the first ``n`` routes by appearance."""
    return df.join(route_id_list(df, order, limit=n).select("route_id"), "route_id", "left_semi")


def listed_routes(df: DataFrame, ids: Sequence[str], n: int | None = None) -> DataFrame:
    """Rows of the listed routes, the list being cut to ``n``; unknown ids match nothing."""
    wanted = list(dict.fromkeys(ids))[:n] if n is not None else list(ids)
    return df.where(F.col("route_id").isin(wanted))


def route_chunks(ids: DataFrame, size: int, order: Sequence[str] = ("route_id",)) -> DataFrame:
    """route_id with its chunk number, in the given order."""
    numbered = ordered_positions(ids.select("route_id", *[o for o in order if o != "route_id"]).withColumn("__one", F.lit(0)), ["__one"], order)
    return numbered.select("route_id", "position", F.floor(F.col("position") / size).cast("long").alias("chunk_index"))


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """Per chunk: number of routes, first and last route id."""
    return chunks.groupBy("chunk_index").agg(
        F.count("*").alias("route_count"),
        F.min_by("route_id", "position").alias("first_route_id"),
        F.max_by("route_id", "position").alias("last_route_id"),
    )


def best_row(df: DataFrame, order: Sequence) -> DataFrame:
    """The first row by the given order."""
    return df.orderBy(*order).limit(1)


def top_rows(df: DataFrame, column: str, n: int, prefer: tuple[str, str] | None = None) -> DataFrame:
    """The ``n`` largest rows by a column, from the rows holding the preferred value if there are any."""
    ties = [c for c in df.columns if c != column]
    if prefer is None:
        return df.orderBy(F.desc(column), *ties).limit(n)
    name, value = prefer
    hit = F.lower(F.col(name)) == value
    flagged = attach_single_row(df, df.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("__any")))
    kept = flagged.where(~F.col("__any") | hit).select(*df.columns)
    return kept.orderBy(F.desc(column), *ties).limit(n)

