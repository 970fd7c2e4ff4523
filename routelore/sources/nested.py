"""Readers of the nested route files: one JSON object keyed by route id, or JSON Lines with route_id and body."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from routelore import schemas
from routelore.functions import scalars as S
from routelore.sources.keyed import CHUNK_BYTES, keyed_rows


@dataclass(frozen=True)
class Part:
    """One slice of the dataset; a file that the slice lacks is None."""

    name: str
    routes: str | None = None
    sequences: str | None = None
    packages: str | None = None
    travel_times: str | None = None


def count_paths(spark: SparkSession, pattern: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    matches = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return 0 if matches is None else len(matches)


def path_exists(spark: SparkSession, path: str) -> bool:
    return count_paths(spark, path) > 0


def read_keyed(spark: SparkSession, path: str, value: T.DataType, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """route_id and body rows of files of either layout. Both are split over tasks, whatever their size; malformed text is an error."""
    if path.endswith((".jsonl", ".ndjson")):
        line = T.StructType([T.StructField("route_id", T.StringType()), T.StructField("body", value)])
        return spark.read.schema(line).option("mode", "FAILFAST").json(path)
    return keyed_rows(spark, path, value, chunk_bytes)


def _text(c: Column) -> Column:
    """A text field; a bare NaN or Infinity constant, which the parser keeps as quoted text, is null."""
    return F.when(~c.isin('"NaN"', '"Infinity"', '"-Infinity"', "Infinity", "-Infinity"), c)


def route_rows(keyed: DataFrame) -> DataFrame:
    b = F.col("body")
    return keyed.select(
        "route_id",
        *[_text(b[c]).alias(c) for c in ("station_code", "date_YYYY_MM_DD", "departure_time_utc")],
        S.finite(b["executor_capacity_cm3"]).alias("executor_capacity_cm3"),
        _text(b["route_score"]).alias("route_score"),
    )


def stop_rows(keyed: DataFrame) -> DataFrame:
    """One row per stop in file order; a route without stops has one row with a null stop_id."""
    entries = keyed.select("route_id", F.posexplode_outer(F.map_entries("body.stops")).alias("stop_order", "e"))
    v = F.col("e.value")
    return entries.select(
        "route_id",
        F.col("e.key").alias("stop_id"),
        F.col("stop_order").cast("long").alias("stop_order"),
        S.finite(v["lat"]).alias("lat"),
        S.finite(v["lng"]).alias("lng"),
        _text(v["type"]).alias("type"),
        _text(v["zone_id"]).alias("zone_id"),
    )


def sequence_rows(keyed: DataFrame) -> DataFrame:
    return keyed.select("route_id", F.explode_outer("body.actual").alias("stop_id", "p")).select(
        "route_id", "stop_id", S.finite(F.col("p")).alias("seq_position")
    )


def package_rows(keyed: DataFrame) -> DataFrame:
    """One row per package. depth_cm stands in for the length only when the key length_cm is absent."""
    stops = keyed.select("route_id", F.explode_outer("body").alias("stop_id", "packages"))
    rows = stops.select("route_id", "stop_id", F.explode_outer("packages").alias("package_id", "p"))
    p, d = F.col("p"), F.col("p.dimensions")
    length = F.when(F.map_contains_key(d, "length_cm"), F.try_element_at(d, F.lit("length_cm"))).otherwise(
        F.try_element_at(d, F.lit("depth_cm"))
    )
    return rows.select(
        "route_id",
        "stop_id",
        "package_id",
        S.finite(p["planned_service_time_seconds"]).alias("planned_service_time_seconds"),
        _text(F.col("p.time_window.start_time_utc")).alias("start_time_utc"),
        _text(F.col("p.time_window.end_time_utc")).alias("end_time_utc"),
        S.finite(length).alias("length_cm"),
        S.finite(F.try_element_at(d, F.lit("width_cm"))).alias("width_cm"),
        S.finite(F.try_element_at(d, F.lit("height_cm"))).alias("height_cm"),
        _text(p["scan_status"]).alias("scan_status"),
    )


def edge_rows(keyed: DataFrame, source: str) -> DataFrame:
    """Travel matrix as edges; a route with an empty matrix keeps one row without stops."""
    rows = keyed.select("route_id", F.explode_outer("body").alias("from_stop", "row"))
    return rows.select("route_id", "from_stop", F.explode_outer("row").alias("to_stop", "t")).select(
        "route_id", "from_stop", "to_stop", S.finite(F.col("t")).alias("travel_time"), F.lit(source).alias("source")
    )


_KINDS = {
    "routes": (schemas.RAW_ROUTE, route_rows),
    "stops": (schemas.RAW_ROUTE, stop_rows),
    "sequence": (schemas.RAW_SEQUENCE, sequence_rows),
    "packages": (schemas.RAW_PACKAGES, package_rows),
}
_FILES = {"routes": "routes", "stops": "routes", "sequence": "sequences", "packages": "packages"}


def read_parts(spark: SparkSession, parts: Sequence[Part], kind: str) -> DataFrame:
    """Union of all parts that have the file, with ``part`` and ``part_order``; missing files are skipped with a notice."""
    schema, rows = _KINDS[kind]
    frames = []
    for order, part in enumerate(parts):
        path = getattr(part, _FILES[kind])
        if path is None:
            continue
        if not path_exists(spark, path):
            warnings.warn(f"skipping missing source file: {path}", stacklevel=2)
            continue
        frame = rows(read_keyed(spark, path, schema))
        frames.append(frame.withColumns({"part": F.lit(part.name), "part_order": F.lit(order)}))
    if not frames:
        raise FileNotFoundError(f"no part has a {kind} file")
    return reduce(DataFrame.unionByName, frames)


def read_edges(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Edges of all labelled sources; a missing file is skipped with a notice."""
    frames = []
    for source, path in files.items():
        if not path_exists(spark, path):
            warnings.warn(f"skipping missing travel-time file: {path}", stacklevel=2)
            continue
        frames.append(edge_rows(read_keyed(spark, path, schemas.RAW_TRAVEL_TIMES), source))
    if not frames:
        return spark.createDataFrame([], schemas.EDGES)
    return reduce(DataFrame.unionByName, frames)
