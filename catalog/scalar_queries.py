"""Scalar functions over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import cte, query
from routelore.functions import scalars as S
from routelore.operators import report as R
from routelore.operators.distribution import counts_with_share, fixed_bins
from routelore.schemas import WEIGHTS

cte(
    "texts",
    """SELECT p_partkey, p_size, CASE WHEN p_size < 5 THEN NULL WHEN p_size < 8 THEN '  ' WHEN p_size < 11 THEN 'yes' WHEN p_size < 14 THEN ' No ' WHEN p_size < 17 THEN '3.7'
  WHEN p_size < 20 THEN 'UNKNOWN' WHEN p_size < 23 THEN 'nan' WHEN p_size < 26 THEN ' None ' WHEN p_size < 29 THEN '-2.9' WHEN p_size < 32 THEN 'TRUE' WHEN p_size < 35 THEN '1' ELSE p_brand END AS t FROM part""",
)


def texts(spark, d):
    limits = [(5, None), (8, "  "), (11, "yes"), (14, " No "), (17, "3.7"), (20, "UNKNOWN"), (23, "nan"), (26, " None "), (29, "-2.9"), (32, "TRUE"), (35, "1")]
    t = F.when(F.col("p_size") < 5, F.lit(None).cast("string"))
    for limit, text in limits[1:]:
        t = t.when(F.col("p_size") < limit, text)
    return V.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", t.otherwise(F.col("p_brand")).alias("t"))


_text = "CASE s_suppkey % 10 WHEN 0 THEN 'a,1,1,1,1' WHEN 1 THEN '0,0,-2,0,0' WHEN 2 THEN '1,2' ELSE concat_ws(',', s_suppkey % 4 - 1, s_suppkey % 3, s_suppkey % 5, s_suppkey % 2, ' 1.5') END"


@query(
    "f23_weights_from_text",
    f"""SELECT s_suppkey, {', '.join(f'CASE WHEN fits THEN list_extract(w, {i}) / list_sum(w) END AS {name}' for i, name in enumerate(WEIGHTS, 1))} FROM (
SELECT s_suppkey, list_transform(v, lambda x: greatest(x, 0)) AS w, len(v) = 5 AND len(list_filter(v, lambda x: x IS NULL)) = 0 AND list_sum(list_transform(v, lambda x: greatest(x, 0))) > 0 AS fits
FROM (SELECT s_suppkey, list_transform(string_split({_text}, ','), lambda x: try_cast(x AS DOUBLE)) AS v FROM supplier))""",
)
def f23(spark, d):
    rows = V.table(spark, d, "supplier").select("s_suppkey", F.expr(_text).alias("t"))
    return rows.select("s_suppkey", S.weights_of_text(F.col("t"), WEIGHTS).alias("w")).select("s_suppkey", *[F.col(f"w.{n}").alias(n) for n in WEIGHTS])


@query(
    "f1_missing_and_lenient_values",
    """SELECT p_partkey, t IS NULL OR trim(t) = '' AS missing, coalesce(lower(trim(t)) IN ('true', '1', 'yes', 'y'), false) AS truth, try_cast(CASE WHEN trim(t) = 'nan' THEN NULL ELSE t END AS DOUBLE) AS number,
  CASE WHEN trim(t) IN ('3.7') THEN 3 WHEN trim(t) = '-2.9' THEN -2 WHEN lower(trim(t)) IN ('yes', 'true', '1') THEN 1 WHEN lower(trim(t)) = 'no' THEN 0 ELSE 7 END::BIGINT AS whole,
  coalesce(try_cast(CASE WHEN trim(t) = 'nan' THEN NULL ELSE trim(t) END AS DOUBLE), 1.5::DOUBLE) AS decimal_value FROM texts""",
    "texts",
)
def f1(spark, d):
    t = F.col("t")
    return texts(spark, d).select(
        "p_partkey",
        S.text_is_missing(t).alias("missing"),
        S.to_bool(t).alias("truth"),
        S.finite(S.to_number(t)).alias("number"),
        S.to_int(t, 7).alias("whole"),
        S.to_float(t, 1.5).alias("decimal_value"),
    )


def zone_sql(tokens: str) -> str:
    return f"CASE WHEN t IS NULL OR trim(t) = '' OR {tokens} THEN 'UNKNOWN_ZONE' ELSE trim(t) END"


@query(
    "f10_zone_rules",
    f"""SELECT p_partkey, {zone_sql("upper(trim(t)) IN ('UNKNOWN', 'UNKNOWN_ZONE', 'NAN', 'NONE', 'NULL')")} AS any_case, {zone_sql("upper(trim(t)) IN ('NAN', 'NONE', 'NULL')")} AS any_case_keep_unknown,
  {zone_sql("trim(t) IN ('nan', 'NaN', 'None', 'null')")} AS exact, {zone_sql("false")} AS blank_only,
  CASE WHEN t IS NULL OR trim(t) IN ('', 'nan', 'NaN', 'None', 'null') THEN 'Missing' ELSE trim(t) END AS score FROM texts""",
    "texts",
)
def f10(spark, d):
    rules = ("any_case", "any_case_keep_unknown", "exact", "blank_only")
    return texts(spark, d).select(
        "p_partkey", *[S.normalize_zone(F.col("t"), r).alias(r) for r in rules], S.clean_route_score(F.col("t")).alias("score")
    )


@query(
    "f2_non_finite_to_null",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN l_quantity END AS q, [CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN l_quantity END, l_tax] AS pair FROM lineitem""",
)
def f2(spark, d):
    bad = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bad.alias("q"), F.array(bad, F.col("l_tax")).alias("pair"))
    return S.sanitize(rows)


@query(
    "f3_sorted_map_json",
    """SELECT c_custkey, '{"a_segment":"' || c_mktsegment || '","m_name":"' || c_name || '","z_nation":"' || c_nationkey || '"}' AS json FROM customer""",
)
def f3(spark, d):
    m = F.create_map(F.lit("z_nation"), F.col("c_nationkey").cast("string"), F.lit("a_segment"), F.col("c_mktsegment"), F.lit("m_name"), F.col("c_name"))
    return V.table(spark, d, "customer").select("c_custkey", S.sorted_map_json(m).alias("json"))


@query(
    "f9_first_present",
    """SELECT p_partkey, coalesce(CASE WHEN t IS NOT NULL AND trim(t) <> '' THEN t END, 'none given') AS value FROM texts""",
    "texts",
)
def f9(spark, d):
    rows = texts(spark, d)
    return rows.select("p_partkey", S.first_present(rows, ["absent", "t"], F.lit("none given")).alias("value"))


@query(
    "f13_status_window_volume",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s LIKE '%delivered%' THEN 'delivered' WHEN s LIKE '%attempt%' THEN 'attempted' WHEN s LIKE '%reject%' THEN 'rejected' ELSE 'unknown' END AS status,
  trim(w) <> '' AS windowed, CASE WHEN l_discount <> 0 THEN l_quantity * 2.0 * round(l_discount * 100) END AS volume FROM (
SELECT *, lower(CASE WHEN l_linenumber = 7 THEN 'UNDELIVERED' WHEN l_returnflag = 'N' THEN 'Delivery_Attempted' WHEN l_returnflag = 'A' THEN 'REJECTED' ELSE 'lost' END) AS s, CASE WHEN l_linestatus = 'O' THEN 'x' ELSE ' ' END AS w FROM lineitem)""",
)
def f13(spark, d):
    raw = F.when(F.col("l_linenumber") == 7, "UNDELIVERED").when(F.col("l_returnflag") == "N", "Delivery_Attempted").when(F.col("l_returnflag") == "A", "REJECTED").otherwise("lost")
    window = S.has_window(F.lit("x"), F.when(F.col("l_linestatus") == "O", "x").otherwise(" "))
    height = F.when(F.col("l_discount") != 0, F.round(F.col("l_discount") * 100)).otherwise(F.lit(float("nan")))
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", S.scan_status_class(raw).alias("status"), window.alias("windowed"),
        S.package_volume(F.col("l_quantity"), F.lit(2.0), height).alias("volume"),
    )


@query(
    "f16_progress_and_costs",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE greatest(0.0, least(1.0, l_quantity / (l_linenumber - 1))) END AS of_stops,
  CASE WHEN l_linenumber <= 1 THEN 0.0 ELSE l_quantity / (l_linenumber - 1) END AS of_sequence, l_quantity / greatest(l_linenumber - 1, 1) AS of_serving,
  1.0::DOUBLE / (1.0 + exp(-(l_discount * 20 - 1))) AS p, CASE WHEN l_tax = 0 THEN 0.5::DOUBLE ELSE CAST(l_discount = 0 AS DOUBLE) END AS zone_penalty, CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE ELSE 1.0 END AS risk,
  l_linenumber + l_quantity / 60.0::DOUBLE + l_linenumber + l_extendedprice / 10000.0::DOUBLE AS workload, 0.7::DOUBLE * l_discount + 0.3::DOUBLE * l_tax AS cost FROM lineitem""",
)
def f16(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.progress_of_stops(q, n).alias("of_stops"),
        S.progress_of_sequence(q, n).alias("of_sequence"),
        S.progress_of_serving(q, n).alias("of_serving"),
        S.clip_probability(S.sigmoid(F.col("l_discount") * 20 - 1)).alias("p"),
        S.zone_penalty(S.flag(F.col("l_tax") == 0), S.flag(F.col("l_discount") == 0)).alias("zone_penalty"),
        S.window_risk(S.flag(F.col("l_returnflag") == "N")).alias("risk"),
        S.workload(n, q, n, F.col("l_extendedprice")).alias("workload"),
        S.weighted_cost([F.col("l_discount"), F.col("l_tax")], [0.7, 0.3]).alias("cost"),
    )


@query(
    "f17_percent_of_total",
    "SELECT o_orderpriority, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM orders) AS percentage FROM orders GROUP BY 1",
)
def f17(spark, d):
    return counts_with_share(V.table(spark, d, "orders"), "o_orderpriority")


@query(
    "f24_names_directions_rounding",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'LCS similarity' WHEN 'O' THEN 'Zone-change count' ELSE 'P' END AS label, CASE o_orderstatus WHEN 'O' THEN 'lower_is_better' ELSE 'higher_is_better' END AS direction,
  round(o_totalprice / 7.0, 2) AS price FROM orders""",
)
def f24(spark, d):
    code = F.when(F.col("o_orderstatus") == "F", "lcs_similarity").when(F.col("o_orderstatus") == "O", "zone_change_count").otherwise(F.col("o_orderstatus"))
    rows = V.table(spark, d, "orders").select(
        "o_orderkey", S.display_name(code, R.METRIC_LABELS).alias("label"), S.metric_direction(code).alias("direction"), (F.col("o_totalprice") / 7.0).alias("price")
    )
    return S.round_numbers(rows, 2)


@query(
    "b2_fixed_edge_bins",
    """SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_tax = 0 THEN 'Missing' WHEN l_quantity <= 10 THEN '<=10' WHEN l_quantity <= 25 THEN '11-25' ELSE '>25' END AS label FROM lineitem) GROUP BY label""",
)
def b2(spark, d):
    q = F.when(F.col("l_tax") != 0, F.col("l_quantity"))
    rows = V.table(spark, d, "lineitem").select(fixed_bins(q, (10, 25), ("<=10", "11-25", ">25")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))
