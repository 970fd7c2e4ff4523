"""Travel times of stop pairs: looked up in a table of edges, or computed from the two stops.

A full matrix has a row per pair of a route's stops. Where a time follows from the stops themselves, only the pairs that are asked for
are made, by two equality joins on (route, stop), so nothing grows with the square of a route.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from routelore.functions import scalars as S


@dataclass(frozen=True)
class StopTravel:
    """Times that follow from both stops.

    ``stops``: route_id, stop_id and ``columns``, one row per stop. ``sources``: route_id and source, the sources that know a route.
    ``seconds`` gives the time from the columns of both stops and the source, null where there is none; ``row`` the same in numpy,
    element by element for values or arrays that broadcast, with NaN for none.
    """

    stops: DataFrame
    sources: DataFrame
    columns: Sequence[str]
    seconds: Callable[[Mapping[str, Column], Mapping[str, Column], Column], Column]
    row: Callable[[Mapping, Mapping[str, np.ndarray], str], np.ndarray]

    def only(self, sources: DataFrame) -> StopTravel:
        return replace(self, sources=sources)


Travel = DataFrame | StopTravel


def route_sources(travel: Travel) -> DataFrame:
    """route_id and source of every route that a source knows."""
    return travel.sources.distinct() if isinstance(travel, StopTravel) else travel.select("route_id", "source").distinct()


def of_source(travel: Travel, source: str) -> Travel:
    kept = F.col("source") == source
    return travel.only(travel.sources.where(kept)) if isinstance(travel, StopTravel) else travel.where(kept)


def with_ends(known: DataFrame, travel: Travel) -> DataFrame:
    """Rows of (route_id, stop_id, source) with the stop's own columns and whether the source knows the route, so that times of pairs
    made of them need no further join (``time_between``). Listed times add nothing."""
    if not isinstance(travel, StopTravel):
        return known
    stops = travel.stops.select("route_id", "stop_id", *[F.col(c).alias(f"__end_{c}") for c in travel.columns], F.lit(True).alias("__end"))
    routes = travel.sources.select("route_id", "source", F.lit(True).alias("__known")).distinct()
    return known.join(routes, ["route_id", "source"], "left").join(stops, ["route_id", "stop_id"], "left")


def end_columns(travel: Travel) -> list[str]:
    """The columns that ``with_ends`` adds for a stop."""
    return [*[f"__end_{c}" for c in travel.columns], "__end"] if isinstance(travel, StopTravel) else []


def time_between(travel: StopTravel, left: str, right: str, start: str, end: str, source: str) -> Column:
    """The finite time between two stops whose ``end_columns`` bear the prefixes ``left`` and ``right``, null where there is none."""
    ends = [{c: F.col(f"{m}__end_{c}") for c in travel.columns} for m in (left, right)]
    there = F.col(f"{left}__end") & F.col(f"{right}__end") & F.col("__known") & (F.col(start) != F.col(end))
    return S.finite(F.when(there, travel.seconds(*ends, F.col(source))))


def with_times(pairs: DataFrame, travel: Travel, name: str, start: str = "from_stop", end: str = "to_stop", source: str | None = None) -> DataFrame:
    """The pairs (route_id, ``start``, ``end``, and ``source`` if named) with their finite time, null where there is none.

    Without ``source`` the travel times hold one source per route. The key is the pair, so a route with very many spreads over all tasks.
    """
    if not isinstance(travel, StopTravel):
        on = ["route_id", start, end, *([source] if source else [])]
        renamed = [F.col("route_id"), F.col("from_stop").alias(start), F.col("to_stop").alias(end), *([F.col("source").alias(source)] if source else [])]
        times = travel.select(*renamed, S.finite(F.col("travel_time")).alias(name)).where(F.col(name).isNotNull())
        return pairs.join(times, on, "left")

    def side(stop: str, mark: str) -> DataFrame:
        return travel.stops.select("route_id", F.col("stop_id").alias(stop), *[F.col(c).alias(f"__{mark}_{c}") for c in travel.columns], F.lit(True).alias(f"__{mark}"))

    known = travel.sources.select("route_id", F.col("source").alias(source or "__source"), F.lit(True).alias("__known")).distinct()
    met = pairs.join(side(start, "a"), ["route_id", start], "left").join(side(end, "b"), ["route_id", end], "left")
    met = met.join(known, ["route_id", source] if source else ["route_id"], "left")
    ends = [{c: F.col(f"__{m}_{c}") for c in travel.columns} for m in "ab"]
    time = F.when(F.col("__a") & F.col("__b") & F.col("__known") & (F.col(start) != F.col(end)), travel.seconds(*ends, F.col(source or "__source")))
    return met.select(*pairs.columns, S.finite(time).alias(name))
