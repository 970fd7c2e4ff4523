"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from routelore.operators import cleaning as C

query("c1_stop_base_features", "SELECT * FROM stops", "stops")(V.stops.lazy)
query("c2_route_summary", "SELECT * FROM routes", "routes")(V.routes.lazy)
query("c3_actual_transitions", "SELECT * FROM transitions", "transitions")(V.transitions.lazy)
query("c4_stop_package_features", "SELECT * FROM packages", "packages")(V.packages.lazy)
query("c7_data_quality_report", "SELECT * FROM quality", "quality")(V.quality.lazy)
query("c8_missing_value_summary", "SELECT * FROM missing", "missing")(V.missing)


@query(
    "c5_package_missing_counts",
    "SELECT field, missing_count, total_count FROM missing WHERE field <> 'zone_id'",
    "missing",
)
def c5(spark, d):
    return C.package_missing_counts(V.raw_packages(spark, d))


@query(
    "c6_latest_route_state",
    """SELECT CAST(o_custkey AS VARCHAR) AS route_id, CAST(o_orderkey AS VARCHAR) AS stop_id, part_order FROM (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS part_order FROM orders) x
QUALIFY part_order = max(part_order) OVER (PARTITION BY o_custkey)""",
)
def c6(spark, d):
    part = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = V.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("route_id"),
        F.col("o_orderkey").cast("string").alias("stop_id"),
        part.alias("part_order"),
    )
    return C.latest_per_route(rows)


@query(
    "c9_run_counters",
    """SELECT 'routes_rows' AS metric, count(*) AS value FROM routes UNION ALL SELECT 'stops_rows', count(*) FROM stops
UNION ALL SELECT 'transitions_rows', count(*) FROM transitions UNION ALL SELECT 'packages_rows', count(*) FROM packages
UNION ALL SELECT 'usable_routes', count(*) FILTER (can_use_for_training) FROM quality""",
    "routes",
    "stops",
    "transitions",
    "packages",
    "quality",
)
def c9(spark, d):
    tables = {n: getattr(V, n)(spark, d) for n in ("routes", "stops", "transitions", "packages")}
    return C.run_counters(tables, V.quality(spark, d))
