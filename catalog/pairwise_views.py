"""Splits, samples and scored samples over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import coverage_views as CV
from catalog import views as V
from catalog.registry import cte, lazy_view, staged_view
from routelore.functions import scalars as S
from routelore.operators import pairwise as P
from routelore.operators import splits as SP

RATIOS = (0.70, 0.15, 0.15)
NEGATIVES, SEED = 5, 42


@staged_view
def splits(spark, d):
    return SP.stratified_split(SP.modelling_routes(V.routes(spark, d), V.routes(spark, d)), RATIOS, SEED)


def shares_sql(n: str) -> tuple[str, str, str]:
    raw = [f"({n} * {r}::DOUBLE)" for r in RATIOS]
    base = [f"floor({x})" for x in raw]
    left = f"({n} - {base[0]} - {base[1]} - {base[2]})"
    out = []
    for i in range(3):
        ahead = " + ".join(
            f"CAST({raw[j]} - {base[j]} {'>=' if j > i else '>'} {raw[i]} - {base[i]} AS INT)" for j in range(3) if j != i
        )
        out.append(f"CAST({base[i]} + CASE WHEN {ahead} < {left} THEN 1 ELSE 0 END AS BIGINT)")
    return tuple(out)


CLEAN_SCORE = "CASE WHEN route_score IS NULL OR trim(route_score) IN ('', 'nan', 'NaN', 'None', 'null') THEN 'Missing' ELSE trim(route_score) END"
_a, _b, _c = shares_sql("n")
cte(
    "first_split",
    f"""SELECT *, CASE WHEN pos < {_a} THEN 'train' WHEN pos < {_a} + {_b} THEN 'validation' ELSE 'test' END AS split FROM (
SELECT route_id, {CLEAN_SCORE} AS route_score, md5('{SEED}|' || route_id) AS h, row_number() OVER (PARTITION BY {CLEAN_SCORE} ORDER BY md5('{SEED}|' || route_id), route_id) - 1 AS pos,
  count(*) OVER (PARTITION BY {CLEAN_SCORE}) AS n FROM routes)""",
    "routes",
)
_t, _v, _e = shares_sql("total")
cte(
    "split_plan",
    f"""SELECT *, greatest(t0 - c0, 0) AS d0, greatest(t1 - c1, 0) AS d1 FROM (SELECT *, {_t} AS t0, {_v} AS t1, {_e} AS t2 FROM (
SELECT count(*) AS total, count(*) FILTER (split = 'train') AS c0, count(*) FILTER (split = 'validation') AS c1, count(*) FILTER (split = 'test') AS c2 FROM first_split))""",
    "first_split",
)
cte(
    "splits",
    """SELECT route_id, route_score, CASE WHEN NOT over THEN split WHEN r < d0 THEN 'train' WHEN r < d0 + d1 THEN 'validation' ELSE 'test' END AS split FROM (
SELECT *, CASE WHEN over THEN row_number() OVER (PARTITION BY over ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, h, route_id) - 1 END AS r FROM (
SELECT f.*, p.d0, p.d1, row_number() OVER (PARTITION BY split ORDER BY h, route_id) - 1 >= CASE split WHEN 'train' THEN t0 WHEN 'validation' THEN t1 ELSE t2 END AS over
FROM first_split f, split_plan p))""",
    "first_split", "split_plan",
)


@lazy_view
def requested(spark, d):
    return P.requested_routes(splits(spark, d), V.routes(spark, d), CV.lookup(spark, d))


cte(
    "requested",
    f"""SELECT s.route_id, s.split, {CLEAN_SCORE.replace('route_score', 'r.route_score')} AS route_score, r.number_of_stops,
  CASE WHEN l.travel_time_source = 'multiple_sources' THEN 'training_build' ELSE l.source END AS source
FROM splits s LEFT JOIN routes r ON s.route_id = r.route_id LEFT JOIN chosen l ON s.route_id = l.route_id""",
    "splits", "routes", "chosen",
)


@staged_view
def drawn(spark, d):
    return P.candidate_rows(
        V.transitions(spark, d), V.travel(spark, d), V.stops(spark, d), V.packages(spark, d), requested(spark, d),
        negatives=NEGATIVES, seed=SEED, generation_timestamp="fixed",
    )


def draw_sql() -> str:
    inner = "SELECT q.*, x.split, x.route_score, x.number_of_stops, x.source, greatest(q.n - q.position - 2, 0) AS total FROM sequence q JOIN requested x ON q.route_id = x.route_id WHERE x.source IS NOT NULL AND q.position < q.n - 1"
    for i in range(1, NEGATIVES + 1):
        take = f"least({NEGATIVES}, total)"
        top = f"(total - {take} + {i})"
        h = f"(('0x' || substr(md5('{SEED}|' || route_id || '|' || position || '|{i}'), 1, 8))::BIGINT % greatest({top}, 1))"
        taken = " OR ".join(f"coalesce({h} = d{j}, false)" for j in range(1, i)) or "false"
        inner = f"SELECT *, CASE WHEN {i} <= {take} THEN CASE WHEN {taken} THEN {top} - 1 ELSE {h} END END AS d{i} FROM ({inner})"
    rows = "SELECT *, position + 1 AS spot, 0 AS rank FROM picks"
    for i in range(1, NEGATIVES + 1):
        rows += f" UNION ALL SELECT *, position + 2 + d{i}, {i} FROM picks WHERE d{i} IS NOT NULL"
    return f"WITH picks AS MATERIALIZED ({inner}) {rows}"


ANY_ZONE = "CASE WHEN {c} IS NULL OR upper(trim({c})) IN ('', 'UNKNOWN', 'UNKNOWN_ZONE', 'NAN', 'NONE', 'NULL') THEN 'UNKNOWN_ZONE' ELSE trim({c}) END"
_packages = (
    "package_count", "total_planned_service_time", "time_window_package_count", "total_package_volume_cm3",
    "delivered_count", "attempted_count", "rejected_count", "unknown_status_count",
)
cte("draws", draw_sql(), "sequence", "requested")
cte(
    "drawn",
    f"""SELECT *, CAST(NOT unk AND current_zone = candidate_zone AS BIGINT) AS same_zone, CAST(NOT unk AND current_zone <> candidate_zone AS BIGINT) AS zone_changed,
  CAST(unk AS BIGINT) AS zone_missing_in_pair FROM (SELECT *, current_zone = 'UNKNOWN_ZONE' OR candidate_zone = 'UNKNOWN_ZONE' AS unk FROM (
SELECT w.route_id, w.split, w.position, w.stop_id AS current_stop, c.stop_id AS candidate_stop, nx.stop_id AS actual_next_stop, CAST(w.rank = 0 AS BIGINT) AS label, w.route_score,
  CASE WHEN coalesce(w.number_of_stops, 0) <> 0 THEN w.number_of_stops ELSE w.n END AS number_of_stops, CAST(w.position AS DOUBLE) / (w.n - 1) AS route_progress,
  w.n - w.position - 1 AS remaining_stop_count, {ANY_ZONE.format(c='cs.zone_id')} AS current_zone, coalesce(cs.type, '') AS current_type,
  coalesce(cs.is_station, 0) AS current_is_station, coalesce(cs.is_dropoff, 0) AS current_is_dropoff, {ANY_ZONE.format(c='ds.zone_id')} AS candidate_zone,
  coalesce(ds.type, '') AS candidate_type, coalesce(ds.is_station, 0) AS candidate_is_station, coalesce(ds.is_dropoff, 0) AS candidate_is_dropoff,
  e.travel_time AS travel_time_ij, coalesce(p.has_time_window, 0) AS candidate_has_time_window,
  {', '.join(f'CAST(coalesce(p.{c}, 0) AS DOUBLE) AS candidate_{c}' for c in _packages)},
  CAST({SEED} AS BIGINT) AS negative_sampling_seed, CAST(w.rank AS BIGINT) AS negative_sample_rank, w.source AS travel_time_source, 'fixed' AS generation_timestamp
FROM draws w JOIN sequence c ON w.route_id = c.route_id AND c.position = w.spot JOIN sequence nx ON w.route_id = nx.route_id AND nx.position = w.position + 1
LEFT JOIN edges e ON e.route_id = w.route_id AND e.from_stop = w.stop_id AND e.to_stop = c.stop_id AND e.source = w.source
LEFT JOIN stops cs ON cs.route_id = w.route_id AND cs.stop_id = w.stop_id LEFT JOIN stops ds ON ds.route_id = w.route_id AND ds.stop_id = c.stop_id
LEFT JOIN packages p ON p.route_id = w.route_id AND p.stop_id = c.stop_id))""",
    "draws", "sequence", "edges", "stops", "packages",
)


@lazy_view
def samples(spark, d):
    return drawn(spark, d).where("travel_time_ij is not null")


cte("samples", "SELECT * EXCLUDE (unk) FROM drawn WHERE travel_time_ij IS NOT NULL", "drawn")

# A fixed preference model with literal coefficients: intercept and weights of the named features.
LOGIT = {
    "steady": (0.9, {"travel_time_ij": -0.0002, "same_zone": 0.8, "zone_missing_in_pair": -0.3, "candidate_package_count": 0.05,
                     "candidate_has_time_window": 0.4, "remaining_stop_count": -0.01}),
    "hasty": (0.2, {"travel_time_ij": -0.0005, "same_zone": 0.2, "candidate_is_station": -1.0, "route_progress": 0.3}),
}


def with_probability(df, model: str = "steady"):
    start, weights = LOGIT[model]
    z = F.lit(start)
    for c, w in weights.items():
        z = z + F.lit(w) * F.col(c)
    return df.withColumn("predicted_probability", F.round(S.sigmoid(z), 9))


def probability_sql(model: str = "steady") -> str:
    start, weights = LOGIT[model]
    z = f"{start}::DOUBLE" + "".join(f" + ({w}::DOUBLE) * {c}" for c, w in weights.items())
    return f"round(1.0 / (1.0 + exp(-({z}))), 9)"


@lazy_view
def scored(spark, d):
    return with_probability(samples(spark, d))


cte("scored", f"SELECT *, {probability_sql()} AS predicted_probability FROM samples", "samples")
