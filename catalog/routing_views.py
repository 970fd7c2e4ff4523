"""Admitted routes, generated routes and their metrics over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import coverage_views as CV
from catalog import pairwise_views as PV
from catalog import views as V
from catalog.registry import cte, lazy_view, staged_view
from routelore.operators import pairwise as P
from routelore.operators import routing as G
from routelore.operators.scoring import LogitScorer
from routelore.schemas import WEIGHTS

SCORER = LogitScorer(*PV.LOGIT["steady"], decimals=9)
BEST = (0.70, 0.15, 0.15, 0.0, 0.0)
PLANS = [(G.NEAREST, "", (0.0,) * 5), (G.PREFERENCE, "", (0.0,) * 5), (G.HYBRID, "best", BEST)]


@staged_view
def sequence(spark, d):
    return P.stop_sequence(V.transitions(spark, d))


@staged_view
def admitted(spark, d):
    ids = PV.splits(spark, d)
    checked = G.sequence_admission(ids, sequence(spark, d))
    return G.route_admission(checked, CV.lookup(spark, d), V.travel(spark, d))


cte(
    "admitted",
    """SELECT s.route_id, coalesce(q.n, 0) AS stop_count, CASE WHEN coalesce(q.n, 0) >= 2 AND c.source IS NOT NULL THEN c.source END AS source,
  CASE WHEN coalesce(q.n, 0) < 2 THEN 'missing_or_short_sequence' WHEN coalesce(c.travel_time_source, 'missing_source') = 'missing_source' THEN 'missing_source'
    WHEN c.source IS NULL THEN 'missing_matrix' ELSE 'ok' END AS route_status
FROM splits s LEFT JOIN (SELECT route_id, any_value(n) AS n FROM sequence WHERE n >= 2 GROUP BY route_id) q ON s.route_id = q.route_id
LEFT JOIN chosen c ON s.route_id = c.route_id""",
    "splits", "sequence", "chosen",
)


@staged_view
def members(spark, d):
    headers = PV.requested(spark, d).drop("source")
    wanted = headers.join(admitted(spark, d).where("route_status = 'ok'").select("route_id", "source"), "route_id")
    return P.attributed_sequence(V.transitions(spark, d), V.stops(spark, d), V.packages(spark, d), wanted)


_any = PV.ANY_ZONE.format(c="s.zone_id")
cte(
    "members",
    f"""SELECT q.route_id, q.position AS pos, q.stop_id, q.n, x.split, CASE WHEN coalesce(x.number_of_stops, 0) <> 0 THEN x.number_of_stops ELSE q.n END AS number_of_stops,
  {_any} AS zone, coalesce(s.type, '') AS type, coalesce(s.is_station, 0) AS is_station, coalesce(s.is_dropoff, 0) AS is_dropoff,
  {', '.join(f'CAST(coalesce(p.{c}, 0) AS DOUBLE) AS {c}' for c in (*PV._packages, 'has_time_window'))}
FROM sequence q JOIN (SELECT route_id FROM admitted WHERE route_status = 'ok') a ON q.route_id = a.route_id JOIN requested x ON x.route_id = q.route_id
LEFT JOIN stops s ON s.route_id = q.route_id AND s.stop_id = q.stop_id LEFT JOIN packages p ON p.route_id = q.route_id AND p.stop_id = q.stop_id""",
    "sequence", "admitted", "requested", "stops", "packages",
)


@lazy_view
def chosen_travel(spark, d):
    return G.edges_of_admitted(V.travel(spark, d), admitted(spark, d))


cte(
    "chosen_edges",
    """SELECT e.route_id, e.from_stop, e.to_stop, e.travel_time FROM edges e JOIN admitted a ON e.route_id = a.route_id AND e.source = a.source
WHERE a.route_status = 'ok' AND e.travel_time IS NOT NULL""",
    "edges", "admitted",
)


@lazy_view
def actual(spark, d):
    return members(spark, d).select("route_id", "position", "stop_id")


@lazy_view
def zones(spark, d):
    return members(spark, d).select("route_id", "stop_id", "zone")


@staged_view
def steps(spark, d):
    return G.generate_routes(members(spark, d), chosen_travel(spark, d), PLANS, SCORER)


def probability(c: str) -> str:
    """The scorer's probability over feature columns of alias ``c``."""
    start, weights = PV.LOGIT["steady"]
    z = f"{start}::DOUBLE" + "".join(f" + ({w}::DOUBLE) * {c}.{n}" for n, w in weights.items())
    return f"round(1.0 / (1.0 + exp(-({z}))), 9)"


def candidates_sql(source: str) -> str:
    """Components of every candidate of the decisions in ``source`` (route_id, method, step, cur, visited)."""
    load = "c.package_count + c.total_planned_service_time / 60.0::DOUBLE + c.time_window_package_count + c.total_package_volume_cm3 / 10000.0::DOUBLE"
    scaled = "CASE WHEN {hi} - {lo} <= 1e-9::DOUBLE * greatest(abs({lo}), abs({hi})) THEN 0.0::DOUBLE ELSE ({x} - {lo}) / ({hi} - {lo}) END"
    return f"""SELECT *, coalesce(CASE WHEN tt IS NOT NULL THEN {scaled.format(x='tt', lo='tlo', hi='thi')} END, 1.0::DOUBLE) AS travel_norm,
  CASE WHEN zone_missing_in_pair = 1 THEN 0.5::DOUBLE ELSE CAST(zone_changed AS DOUBLE) END AS zone_penalty,
  CASE WHEN candidate_has_time_window = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS time_window_risk, {scaled.format(x='load', lo='llo', hi='lhi')} AS workload_norm, {probability('f')} AS p
FROM (SELECT *, min(tt) OVER k AS tlo, max(tt) OVER k AS thi, min(load) OVER k AS llo, max(load) OVER k AS lhi, count(*) OVER k AS remaining_stop_count FROM (
  SELECT r.route_id, r.method, r.step, r.visited, m.stop_id AS current_stop, c.stop_id AS candidate_stop, c.pos, e.travel_time AS tt, coalesce(e.travel_time, 0.0) AS travel_time_ij, {load} AS load,
    CAST(m.zone <> 'UNKNOWN_ZONE' AND c.zone <> 'UNKNOWN_ZONE' AND m.zone = c.zone AS BIGINT) AS same_zone, CAST(m.zone <> 'UNKNOWN_ZONE' AND c.zone <> 'UNKNOWN_ZONE' AND m.zone <> c.zone AS BIGINT) AS zone_changed,
    CAST(m.zone = 'UNKNOWN_ZONE' OR c.zone = 'UNKNOWN_ZONE' AS BIGINT) AS zone_missing_in_pair, c.package_count AS candidate_package_count, c.has_time_window AS candidate_has_time_window, m.number_of_stops
  FROM {source} r JOIN members m ON m.route_id = r.route_id AND m.pos = r.cur JOIN members c ON c.route_id = r.route_id AND NOT list_contains(r.visited, c.pos)
  LEFT JOIN chosen_edges e ON e.route_id = r.route_id AND e.from_stop = m.stop_id AND e.to_stop = c.stop_id) WINDOW k AS (PARTITION BY route_id, method)) f"""


COST = " + ".join(f"{w}::DOUBLE * {c}" for w, c in zip(BEST, ("travel_norm", "(1.0::DOUBLE - p)", "zone_penalty", "time_window_risk", "workload_norm")))
BADNESS = f"CASE method WHEN '{G.NEAREST}' THEN coalesce(tt, 1e300::DOUBLE) WHEN '{G.PREFERENCE}' THEN -p ELSE cost END"
cte(
    "walk",
    f"""SELECT m.route_id, t.method, CAST(0 AS BIGINT) AS step, m.pos AS cur, [m.pos] AS visited, m.n AS cand, CAST(NULL AS DOUBLE) AS tt, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS cost
FROM members m, (VALUES ('{G.NEAREST}'), ('{G.PREFERENCE}'), ('{G.HYBRID}')) t(method) WHERE m.pos = 0
UNION ALL SELECT route_id, method, step + 1, b.pos, list_append(visited, b.pos), cand, b.tt, b.p, b.cost FROM (
  SELECT route_id, method, any_value(step) AS step, any_value(visited) AS visited, count(*) AS cand, arg_min({{'pos': pos, 'tt': tt, 'p': p, 'cost': CASE WHEN method = '{G.HYBRID}' THEN cost ELSE 0.0::DOUBLE END}}, [{BADNESS}, CAST(pos AS DOUBLE)]) AS b
  FROM (SELECT *, {COST} AS cost FROM ({candidates_sql('walk')})) GROUP BY route_id, method)""",
    "members", "chosen_edges",
)
cte(
    "steps",
    f"""SELECT w.route_id, w.method, CASE w.method WHEN '{G.HYBRID}' THEN 'best' ELSE '' END AS weight_id, w.step AS position, m.stop_id, w.cur AS actual_position, w.cand AS candidate_count,
  w.tt AS travel_time, w.p AS probability, w.cost FROM walk w JOIN members m ON m.route_id = w.route_id AND m.pos = w.cur""",
    "walk", "members",
)


@staged_view
def metrics(spark, d):
    raw = G.route_metrics(steps(spark, d), actual(spark, d), chosen_travel(spark, d), zones(spark, d))
    header = members(spark, d).where("position = 0").select("route_id", "split")
    return raw.join(header, "route_id").withColumn(
        "method", F.when(F.col("method") == G.HYBRID, G.BEST_LABEL).otherwise(F.col("method"))
    )


def legs_sql(seq: str, keys: str, order: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""SELECT {ks}, CASE WHEN count(e.travel_time) = count(*) THEN sum(e.travel_time) END AS total_travel_time,
  avg(CAST(x.zone <> 'UNKNOWN_ZONE' AND x.zone = y.zone AS INT)) AS same_zone_ratio,
  count(*) FILTER (x.zone <> 'UNKNOWN_ZONE' AND y.zone <> 'UNKNOWN_ZONE' AND x.zone <> y.zone) AS zone_change_count
FROM {seq} a JOIN {seq} b ON {on} AND b.{order} = a.{order} + 1 JOIN members x ON x.route_id = a.route_id AND x.stop_id = a.stop_id
JOIN members y ON y.route_id = b.route_id AND y.stop_id = b.stop_id LEFT JOIN chosen_edges e ON e.route_id = a.route_id AND e.from_stop = a.stop_id AND e.to_stop = b.stop_id GROUP BY {ks}"""


cte("made_legs", legs_sql("steps", "route_id, method, weight_id", "position"), "steps", "members", "chosen_edges")
cte("driven_legs", legs_sql("members", "route_id", "pos"), "members", "chosen_edges")
cte(
    "peel",
    """SELECT route_id, method, position, actual_position, CAST(1 AS BIGINT) AS layer FROM steps
UNION ALL SELECT route_id, method, position, actual_position, layer + 1 FROM (SELECT *, min(actual_position) OVER (PARTITION BY route_id, method ORDER BY position
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM peel) WHERE actual_position > low""",
    "steps",
)
cte(
    "agreement",
    """SELECT s.route_id, s.method, s.weight_id, count(*) AS stop_count, CAST(any_value(l.layers) AS DOUBLE) / count(*) AS lcs_similarity,
  avg(CAST(s.position = s.actual_position AS INT)) AS position_match_ratio, count(DISTINCT s.stop_id) = any_value(m.n) AS route_valid
FROM steps s JOIN (SELECT route_id, method, max(layer) AS layers FROM peel GROUP BY ALL) l ON l.route_id = s.route_id AND l.method = s.method
JOIN (SELECT route_id, count(*) AS n FROM members GROUP BY route_id) m ON m.route_id = s.route_id GROUP BY s.route_id, s.method, s.weight_id""",
    "steps", "peel", "members",
)
cte(
    "metrics",
    f"""SELECT a.route_id, CASE a.method WHEN '{G.HYBRID}' THEN '{G.BEST_LABEL}' ELSE a.method END AS method, a.weight_id, a.stop_count, v.total_travel_time AS actual_total_travel_time,
  g.total_travel_time AS generated_total_travel_time, CASE WHEN v.total_travel_time > 0 THEN g.total_travel_time / v.total_travel_time END AS travel_time_ratio_to_actual,
  a.lcs_similarity, a.position_match_ratio, g.same_zone_ratio AS generated_same_zone_ratio, v.same_zone_ratio AS actual_same_zone_ratio, g.zone_change_count, a.route_valid, h.split
FROM agreement a JOIN made_legs g ON a.route_id = g.route_id AND a.method = g.method JOIN driven_legs v ON a.route_id = v.route_id
JOIN (SELECT route_id, split FROM members WHERE pos = 0) h ON h.route_id = a.route_id""",
    "agreement", "made_legs", "driven_legs", "members",
)


# ---- suppliers as weight vectors, their order lines as evaluated routes -----------------------------------------
@staged_view
def trials(spark, d):
    """Route metrics of many weight vectors: linear in the order lines."""
    s = V.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    raw = [k % 4 + 1, F.floor(k / 4) % 3, F.floor(k / 12) % 3, F.floor(k / 36) % 2, F.floor(k / 72) % 2]
    total = raw[0] + raw[1] + raw[2] + raw[3] + raw[4]
    vectors = s.select(
        k.alias("l_suppkey"),
        F.format_string("w%06d", k).alias("weight_id"),
        *[F.round(r.cast("double") / total, 10).alias(w) for r, w in zip(raw, WEIGHTS)],
    )
    li = V.table(spark, d, "lineitem")
    rows = li.select(
        "l_suppkey",
        F.col("l_orderkey").cast("string").alias("route_id"),
        F.lit(G.HYBRID).alias("method"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("double")).alias("actual_total_travel_time"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity") + 10.0).alias("generated_total_travel_time"),
        F.when(F.col("l_tax") != 0, (F.col("l_quantity") + 10.0) / F.col("l_quantity")).alias("travel_time_ratio_to_actual"),
        F.round(F.col("l_discount") * 10, 6).alias("lcs_similarity"),
        F.round(F.col("l_tax") * 10, 6).alias("position_match_ratio"),
        (F.col("l_linenumber") / 7.0).alias("generated_same_zone_ratio"),
        (F.col("l_linenumber") / 8.0).alias("actual_same_zone_ratio"),
        F.col("l_linenumber").cast("long").alias("zone_change_count"),
        (F.col("l_returnflag") != "A").alias("route_valid"),
    )
    return rows.join(vectors, "l_suppkey").drop("l_suppkey")


_r = ["s_suppkey % 4 + 1", "(s_suppkey // 4) % 3", "(s_suppkey // 12) % 3", "(s_suppkey // 36) % 2", "(s_suppkey // 72) % 2"]
cte(
    "trials",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS route_id, '{G.HYBRID}' AS method, CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS DOUBLE) END AS actual_total_travel_time,
  CASE WHEN l_tax <> 0 THEN l_quantity + 10.0::DOUBLE END AS generated_total_travel_time, CASE WHEN l_tax <> 0 THEN (l_quantity + 10.0::DOUBLE) / l_quantity END AS travel_time_ratio_to_actual,
  round(l_discount * 10, 6) AS lcs_similarity, round(l_tax * 10, 6) AS position_match_ratio, l_linenumber / 7.0::DOUBLE AS generated_same_zone_ratio, l_linenumber / 8.0::DOUBLE AS actual_same_zone_ratio,
  CAST(l_linenumber AS BIGINT) AS zone_change_count, l_returnflag <> 'A' AS route_valid, v.* EXCLUDE (s_suppkey) FROM lineitem JOIN (SELECT s_suppkey, printf('w%06d', s_suppkey) AS weight_id,
  {', '.join(f'round(CAST({r} AS DOUBLE) / ({" + ".join(_r)}), 10) AS {w}' for r, w in zip(_r, WEIGHTS))} FROM supplier) v ON l_suppkey = s_suppkey""",
)


@staged_view
def results(spark, d):
    from routelore.operators.weights import weight_results

    return weight_results(trials(spark, d))


AVERAGED = (
    "actual_total_travel_time", "generated_total_travel_time", "travel_time_ratio_to_actual", "lcs_similarity", "position_match_ratio",
    "generated_same_zone_ratio", "actual_same_zone_ratio", "zone_change_count",
)


def summary_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS route_count, {', '.join(f'avg({m}) AS avg_{m}' for m in AVERAGED)}, avg(CAST(route_valid AS INT)) AS valid_route_rate FROM {src} GROUP BY {by}"""


def _score(m: str, higher: bool) -> str:
    lo, hi = f"min({m}) OVER ()", f"max({m}) OVER ()"
    share = f"({m} - {lo}) / ({hi} - {lo})"
    return f"CASE WHEN {m} IS NULL THEN 0.0::DOUBLE WHEN {hi} - {lo} <= 1e-9 * greatest(abs({lo}), abs({hi})) THEN 1.0::DOUBLE ELSE {share if higher else '1.0::DOUBLE - ' + share} END"


cte(
    "results",
    f"""SELECT *, row_number() OVER (ORDER BY round(validation_score, 12) DESC, avg_travel_time_ratio_to_actual ASC NULLS LAST, avg_lcs_similarity DESC NULLS LAST, avg_generated_same_zone_ratio DESC NULLS LAST, weight_id) AS rank FROM (
SELECT *, 0.5::DOUBLE * travel_score + 0.25::DOUBLE * lcs_score + 0.2::DOUBLE * same_zone_score + 0.05::DOUBLE * position_score AS validation_score FROM (
SELECT *, {_score('avg_travel_time_ratio_to_actual', False)} AS travel_score, {_score('avg_lcs_similarity', True)} AS lcs_score,
  {_score('avg_generated_same_zone_ratio', True)} AS same_zone_score, {_score('avg_position_match_ratio', True)} AS position_score FROM ({summary_sql('trials', 'weight_id, ' + ', '.join(WEIGHTS))})))""",
    "trials",
)
