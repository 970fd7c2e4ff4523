"""Sources and sinks: each query writes derived tables to the scratch folder and reads them back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from catalog import coverage_views as CV
from catalog import pairwise_views as PV
from catalog import views as V
from catalog.registry import query
from routelore import schemas
from routelore.operators.coverage import SOURCES
from routelore.operators.models import FEATURE_COLUMNS
from routelore.operators.travel import with_times
from routelore.sources import files, nested
from routelore.sources.staging import scratch_folder


def fresh(spark, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write_keyed(df, path: str, files: int) -> str:
    """Rows of (route_id, body) as JSON objects keyed by route, one per file, in lines that begin anywhere in an entry."""

    def lines(batches):
        head = "{"
        for b in batches:
            own = [f"{head if k == 0 else ','}\n{e}" for k, e in enumerate(b.column("entry").to_pylist())]
            head = "," if own else head
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if head == "{" else "}"])], names=["value"])

    entry = F.concat(F.lit('"'), "route_id", F.lit('": '), F.to_json("body", {"ignoreNullFields": "false"})).alias("entry")
    df.select(entry).repartition(files, "entry").mapInArrow(lines, "value string").write.text(path)
    return f"{path}/*.txt"


@query("s1_nested_stops", "SELECT route_id, stop_id, lat, lng, type, zone_id FROM raw_stops", "raw_stops")
def s1(spark, d):
    """Stops as nested objects keyed by route, one stop per entry, in two files and back, cut in chunks of 64 KB."""
    s = V.raw_stops(spark, d)
    body = F.struct(F.create_map("stop_id", F.struct("lat", "lng", "type", "zone_id")).alias("stops"))
    pattern = _write_keyed(s.select("route_id", body.alias("body")), fresh(spark, "stops"), 2)
    return nested.stop_rows(nested.read_keyed(spark, pattern, schemas.RAW_ROUTE, 1 << 16)).drop("stop_order")


@query(
    "s2_multi_part_union",
    """SELECT CAST(o_orderkey AS VARCHAR) AS route_id, 'part_' || o_orderstatus AS part, o_totalprice AS executor_capacity_cm3 FROM orders""",
)
def s2(spark, d):
    orders = V.table(spark, d, "orders")
    parts = []
    for status in ("F", "O", "P"):
        body = F.struct(F.col("o_totalprice").alias("executor_capacity_cm3"))
        rows = orders.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").cast("string").alias("route_id"), body.alias("body"))
        parts.append(nested.Part(f"part_{status}", routes=_write_keyed(rows, fresh(spark, f"part-{status}"), 2)))
    return nested.read_parts(spark, parts, "routes").select("route_id", "part", "executor_capacity_cm3")


@query(
    "s3_travel_matrix_edges",
    "SELECT e.route_id, e.from_stop, e.to_stop, e.travel_time, e.source FROM edges e JOIN transitions t ON e.route_id = t.route_id AND e.from_stop = t.from_stop AND e.to_stop = t.to_stop WHERE e.travel_time IS NOT NULL",
    "edges", "transitions",
)
def s3(spark, d):
    """Matrix rows of the driven legs as keyed objects for each source, read back as edges."""
    legs = V.transitions(spark, d).select("route_id", "from_stop", "to_stop").join(V.route_sources(spark, d), "route_id")
    edges = with_times(legs, V.travel(spark, d), "travel_time", source="source").where("travel_time IS NOT NULL")
    paths = {}
    for source in SOURCES:
        cell = F.create_map("from_stop", F.create_map("to_stop", "travel_time"))
        paths[source] = _write_keyed(edges.where(F.col("source") == source).select("route_id", cell.alias("body")), fresh(spark, source), 4)
    return nested.read_edges(spark, paths)


@query("s4_checked_csv", "SELECT * FROM packages", "packages")
def s4(spark, d):
    path = fresh(spark, "packages-csv")
    files.write_csv(V.packages(spark, d), path, schemas.STOP_PACKAGE_FEATURES)
    return files.read_csv(spark, path, schemas.STOP_PACKAGE_FEATURES, ["route_id", "stop_id", "package_count"])


@query(
    "s5_pruned_sample_columns",
    f"SELECT route_id, position, label, {', '.join(FEATURE_COLUMNS[:6])} FROM samples WHERE split = 'test'",
    "samples",
)
def s5(spark, d):
    folder = fresh(spark, "pruned")
    PV.samples(spark, d).where("split = 'test'").write.parquet(f"{folder}/test_pairwise_samples.parquet")
    return files.read_columns(spark, folder, "test", ["route_id", "position", "label", *FEATURE_COLUMNS[:6]])


@query("s6_fixed_schema_csv", "SELECT route_id, from_stop, to_stop, position, label FROM transitions", "transitions")
def s6(spark, d):
    path = fresh(spark, "transitions-csv")
    files.write_csv(V.transitions(spark, d).withColumn("ignored", F.lit(1)), path, schemas.ACTUAL_TRANSITIONS)
    return spark.read.schema(schemas.ACTUAL_TRANSITIONS).option("header", True).csv(path)


@query("s7_typed_sample_table", "SELECT * FROM samples", "samples")
def s7(spark, d):
    folder = fresh(spark, "samples")
    files.write_samples(PV.samples(spark, d), folder)
    return spark.read.parquet(folder).select(*schemas.PAIRWISE_SAMPLES.fieldNames())


@query("s9_run_summary", "SELECT count(*) AS routes, CAST(NULL AS DOUBLE) AS undefined_ratio, avg(number_of_stops) AS mean_stops FROM routes", "routes")
def s9(spark, d):
    path = fresh(spark, "summary")
    one = V.routes(spark, d).agg(F.count("*").alias("routes"), F.lit(float("nan")).alias("undefined_ratio"), F.avg("number_of_stops").alias("mean_stops"))
    files.write_summary(one, path)
    return spark.read.schema(one.schema).json(path)


@query("s10_chunk_union", "SELECT route_id, number_of_stops, 'chunk_' || coalesce(route_score, 'none') AS chunk FROM routes", "routes")
def s10(spark, d):
    root = fresh(spark, "chunks")
    rows = V.routes(spark, d).select("route_id", "number_of_stops", F.coalesce("route_score", F.lit("none")).alias("score"))
    for score in ("High", "Medium", "Low", "none"):
        rows.where(F.col("score") == score).drop("score").write.parquet(f"{root}/chunk_{score}")
    return files.read_chunks(spark, f"{root}/chunk_*", rows.drop("score").schema, expected=4)


@query("s14_split_table", "SELECT * FROM splits", "splits")
def s14(spark, d):
    folder = fresh(spark, "splits")
    files.write_splits(PV.splits(spark, d), folder)
    return spark.read.parquet(folder).select("route_id", "route_score", "split")


@query("s12_source_lookup_stage", "SELECT * FROM lookup", "lookup")
def s12(spark, d):
    """A guarded write: the target is fresh, so it is created; a second write without permission would be refused."""
    path = fresh(spark, "lookup")
    CV.lookup(spark, d).write.mode(files.guard(spark, path, False)).parquet(path)
    return spark.read.schema(schemas.SOURCE_LOOKUP).parquet(path)
