"""Statistics, ablation and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import pairwise_queries as PQ
from catalog import routing_views as RV
from catalog import views as V
from catalog.eda_queries import corr_sql
from catalog.registry import cte, lazy_view, query, staged_view
from routelore.operators import ablation as X
from routelore.operators import report as R
from routelore.operators import routing as G
from routelore.operators import stats as T
from routelore.operators import weights as WT
from routelore.operators.metrics import subgroup_metrics
from routelore.operators.sampling import top_rows
from routelore.schemas import WEIGHTS

COMPARISONS = [(G.BEST_LABEL, G.NEAREST), (G.BEST_LABEL, G.PREFERENCE)]
M = T.DEFAULT_METRICS

cte(
    "metrics_all",
    "SELECT * FROM metrics UNION ALL SELECT * REPLACE (split || '::' || route_id AS route_id, 'all_splits' AS split) FROM metrics",
    "metrics",
)
cte(
    "metric_rows",
    " UNION ALL ".join(f"SELECT split, method, route_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM metrics_all" for m in M),
    "metrics_all",
)
cte(
    "pairs",
    " UNION ALL ".join(
        f"""SELECT split, '{a}_vs_{b}' AS comparison, '{a}' AS method_a, '{b}' AS method_b, metric, route_id, avg(value) FILTER (method = '{a}') AS a, avg(value) FILTER (method = '{b}') AS b
FROM metric_rows GROUP BY split, metric, route_id HAVING avg(value) FILTER (method = '{a}') IS NOT NULL AND avg(value) FILTER (method = '{b}') IS NOT NULL"""
        for a, b in COMPARISONS
    ),
    "metric_rows",
)
LOWER = "metric IN ('generated_total_travel_time', 'travel_time_ratio_to_actual', 'zone_change_count')"


@lazy_view
def all_metrics(spark, d):
    m = RV.metrics(spark, d)
    return m.unionByName(T.pooled_splits(m))


@staged_view
def pairs(spark, d):
    return T.paired_values(all_metrics(spark, d), COMPARISONS, M)


@query(
    "t1_descriptive_stats",
    """SELECT split, method, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM metric_rows GROUP BY split, method, metric""",
    "metric_rows", recursive=True,
)
def t1(spark, d):
    return T.descriptive(all_metrics(spark, d), M)


query("t2_paired_values", "SELECT * FROM pairs", "pairs", recursive=True)(pairs.lazy)


cte(
    "effects",
    f"""SELECT split, comparison, metric, method_a, method_b, CASE WHEN {LOWER} THEN 'lower_is_better' ELSE 'higher_is_better' END AS metric_direction, count(*) AS n_pairs, avg(a) AS mean_a, avg(b) AS mean_b,
  avg(a - b) AS mean_difference_a_minus_b, avg(CASE WHEN {LOWER} THEN b - a ELSE a - b END) AS mean_improvement, quantile_cont(a, 0.5) AS median_a, quantile_cont(b, 0.5) AS median_b,
  quantile_cont(a - b, 0.5) AS median_difference_a_minus_b, CASE WHEN avg(b) <> 0 THEN avg(CASE WHEN {LOWER} THEN b - a ELSE a - b END) / abs(avg(b)) * 100 END AS percent_improvement_vs_b,
  CASE WHEN stddev_samp(a - b) <> 0 THEN avg(a - b) / stddev_samp(a - b) END AS cohens_dz_raw,
  CASE WHEN stddev_samp(a - b) <> 0 THEN avg(CASE WHEN {LOWER} THEN b - a ELSE a - b END) / stddev_samp(a - b) END AS cohens_dz_improvement,
  CASE WHEN count(*) >= 2 AND stddev_samp(a - b) > 1e-8 THEN avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) END AS paired_t_statistic,
  CASE WHEN abs(avg(a) - avg(b)) <= 1e-9 * greatest(abs(avg(a)), abs(avg(b))) THEN 'tie' WHEN ({LOWER}) = (avg(a) < avg(b)) THEN method_a ELSE method_b END AS preferred_method_by_mean
FROM pairs GROUP BY split, comparison, metric, method_a, method_b""",
    "pairs",
)


@query("t3_paired_effects", "SELECT * FROM effects", "effects", recursive=True)
def t3(spark, d):
    return T.paired_effects(pairs(spark, d)).drop("__sd", "__largest")


cte(
    "signed_ranks",
    """SELECT g.split, g.comparison, g.metric, g.n AS n_pairs, CASE WHEN g.n < 2 THEN NULL WHEN g.most <= 1e-8 THEN 0.0::DOUBLE ELSE least(up, down) END AS wilcoxon_statistic,
  coalesce(nz, 0) AS n_nonzero, g.n - coalesce(nz, 0) AS n_zero, coalesce(ties, 0.0) AS tie_sum, g.most <= 1e-8 AS all_zero
FROM (SELECT split, comparison, metric, count(*) AS n, max(abs(a - b)) AS most FROM pairs GROUP BY ALL) g LEFT JOIN (
SELECT split, comparison, metric, coalesce(sum(r) FILTER (x > 0), 0) AS up, coalesce(sum(r) FILTER (x < 0), 0) AS down, count(*) AS nz, CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM (
  SELECT *, rank() OVER (PARTITION BY split, comparison, metric ORDER BY abs(x)) + (count(*) OVER (PARTITION BY split, comparison, metric, abs(x)) - 1) / 2.0::DOUBLE AS r,
    count(*) OVER (PARTITION BY split, comparison, metric, abs(x)) AS c FROM (SELECT split, comparison, metric, a - b AS x FROM pairs WHERE a <> b)) GROUP BY split, comparison, metric) w
ON g.split = w.split AND g.comparison = w.comparison AND g.metric = w.metric""",
    "pairs",
)


@query("t5_wilcoxon_statistics", "SELECT * FROM signed_ranks", "signed_ranks", recursive=True)
def t5(spark, d):
    return T.wilcoxon_statistics(pairs(spark, d))


def intervals_sql(seeds: dict[str, int], iterations: int = 2000, alpha: float = 0.05) -> str:
    """Bootstrap intervals with the seed of each split ('' for the others)."""
    other = seeds[""]
    named = {k: v for k, v in seeds.items() if k}
    seed = ("CASE split " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in named.items()) + f" ELSE {other} END") if named else str(other)
    count = " + ".join(f"(u >= {float(c)!r}::DOUBLE)::INT" for c in T._POISSON)
    digits = lambda m, at: f"(('0x' || substr({m}, {at}, 8))::BIGINT % {T.PRIME})"
    return f"""WITH reps AS MATERIALIZED (SELECT seed, r, {digits('m', 1)} AS f, {digits('m', 9)} AS g FROM (SELECT seed, r, md5(seed || '|' || r) AS m
  FROM (SELECT unnest([{', '.join(map(str, sorted(set(seeds.values()))))}]) AS seed), (SELECT unnest(range({iterations})) AS r))),
held AS MATERIALIZED (SELECT split, comparison, metric, CASE WHEN {LOWER} THEN b - a ELSE a - b END AS x, {digits("md5(concat_ws('|', split, comparison, metric, route_id))", 1)} AS h, {seed} AS seed FROM pairs),
means AS (SELECT split, comparison, metric, r, sum(n * x) / nullif(sum(n), 0) AS value FROM (SELECT *, {count} AS n FROM (SELECT held.*, r, ((h * f + g) % {T.PRIME})::DOUBLE / {T.PRIME} AS u FROM held JOIN reps USING (seed))) GROUP BY ALL)
SELECT split, comparison, metric, quantile_cont(value, {alpha / 2}) AS bootstrap_ci_low, quantile_cont(value, {1 - alpha / 2}) AS bootstrap_ci_high FROM means GROUP BY ALL"""


cte("intervals", intervals_sql({"": 42, "all_splits": 1042}), "pairs")


@query("t6_bootstrap_intervals", intervals_sql({"": 42}), "pairs", recursive=True)
def t6(spark, d):
    return T.bootstrap_intervals(pairs(spark, d))


@staged_view
def tests(spark, d):
    return T.paired_tests(RV.metrics(spark, d), COMPARISONS)


query("t7_paired_tests")(tests.lazy)


@query("t8_comparison_summary")
def t8(spark, d):
    return T.comparison_summary(tests(spark, d))


#: What rests on a tail probability, which SQL lacks; the tails themselves are tested on known values.
TAILS = ("paired_t_p_value", "wilcoxon_p_value", "paired_t_significant", "wilcoxon_significant", "interpretation")
cte(
    "tested",
    """SELECT e.*, s.wilcoxon_statistic, CASE WHEN s.n_nonzero <= 50 AND s.n_zero = 0 AND s.tie_sum = 0 THEN 'exact' ELSE 'normal_approximation' END AS wilcoxon_p_method,
  i.bootstrap_ci_low, i.bootstrap_ci_high, CAST(2000 AS BIGINT) AS bootstrap_iterations, 0.05::DOUBLE AS alpha,
  coalesce((i.bootstrap_ci_low > 0 AND i.bootstrap_ci_high > 0) OR (i.bootstrap_ci_low < 0 AND i.bootstrap_ci_high < 0), false) AS bootstrap_ci_excludes_zero
FROM effects e LEFT JOIN signed_ranks s ON e.split = s.split AND e.comparison = s.comparison AND e.metric = s.metric
LEFT JOIN intervals i ON e.split = i.split AND e.comparison = i.comparison AND e.metric = i.metric""",
    "effects", "signed_ranks", "intervals",
)


@query("t7_tests_without_tails", "SELECT * FROM tested", "tested", recursive=True)
def t7b(spark, d):
    return tests(spark, d).drop(*TAILS)


_summary = [c for c in T.COMPARISON_COLUMNS if c not in TAILS]


@query("t8_summary_without_tails", f"SELECT {', '.join(_summary)} FROM tested", "tested", recursive=True)
def t8b(spark, d):
    return T.comparison_summary(tests(spark, d)).drop(*TAILS)


@query(
    "t9_named_metrics_and_comparisons",
    f"SELECT * FROM pairs WHERE metric IN ('lcs_similarity', 'zone_change_count') AND method_b = '{G.NEAREST}' AND split <> 'all_splits'",
    "pairs", recursive=True,
)
def t9(spark, d):
    m = RV.metrics(spark, d)
    return T.paired_values(m, [T.parse_comparison(f" {G.BEST_LABEL}: {G.NEAREST} ")], T.select_metrics(m, ["lcs_similarity", "not_measured", "zone_change_count"]))


@query(
    "u2_pooled_routes",
    "SELECT split, method, route_id, stop_count, lcs_similarity FROM metrics_all WHERE split = 'all_splits'",
    "metrics_all", recursive=True,
)
def u2(spark, d):
    return T.pooled_splits(RV.metrics(spark, d)).select("split", "method", "route_id", "stop_count", "lcs_similarity")


_top = "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {} ORDER BY l_extendedprice DESC, l_returnflag, l_orderkey, l_linenumber LIMIT 25"


@query("k4_preferred_top_rows", f"(SELECT 'held' AS asked, * FROM ({_top.format("lower(l_returnflag) = 'a'")})) UNION ALL (SELECT 'absent', * FROM ({_top.format('true')}))")
def k4(spark, d):
    """The dearest lines of a preferred kind, and of all where none has it."""
    rows = V.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    held, absent = (top_rows(rows, "l_extendedprice", 25, prefer=("l_returnflag", kind)) for kind in ("a", "by hand"))
    return held.select(F.lit("held").alias("asked"), "*").unionAll(absent.select(F.lit("absent").alias("asked"), "*"))


# ---- ablation ---------------------------------------------------------------------------------------------------
def targets_sql() -> str:
    rows = [f"SELECT '{n}' AS target_name, " + ", ".join(f"{v}::DOUBLE AS target_{w}" for w, v in zip(WEIGHTS, vs)) for n, vs in X.TARGETS]
    rows.append("SELECT 'validation_selected_best', " + ", ".join(f"round({w}, 10)" for w in WEIGHTS) + " FROM best")
    for c in WEIGHTS:
        rest = [w for w in WEIGHTS if w != c]
        total = " + ".join(rest)
        parts = []
        for w in WEIGHTS:
            e = "0.0::DOUBLE" if w == c else f"CASE WHEN {c} > 0 AND {total} > 0 THEN {w} + {c} * {w} / ({total}) ELSE {w} END"
            if w == "travel_weight":
                e = f"CASE WHEN {c} > 0 AND NOT {total} > 0 THEN 1.0::DOUBLE ELSE {e} END"
            parts.append(f"round({e}, 10)")
        rows.append(f"SELECT 'selected_without_{c.removesuffix('_weight')}', {', '.join(parts)} FROM best")
    return " UNION ALL ".join(rows)


cte("best", "SELECT * FROM results WHERE rank = 1", "results")
cte("targets", targets_sql(), "best")
_l1 = "round(" + " + ".join(f"abs(g.{w} - t.target_{w})" for w in WEIGHTS) + ", 10)"
_linf = "round(greatest(" + ", ".join(f"abs(g.{w} - t.target_{w})" for w in WEIGHTS) + "), 10)"


def candidates_sql(nearest: bool) -> str:
    keep = "true" if nearest else "l1 <= 1e-8"
    values = [*WEIGHTS, "weight_id", *X.WEIGHT_METRICS, "route_count", "valid_route_rate"]
    return f"""SELECT target_name, {keep} AS matched, CASE WHEN l1 <= 1e-8 THEN 'exact_weight_in_grid' WHEN {keep} THEN 'nearest_weight_in_grid' ELSE 'missing_exact_target' END AS match_type,
  {', '.join('target_' + w for w in WEIGHTS)}, CASE WHEN {keep} THEN l1 END AS target_l1_distance, CASE WHEN {keep} THEN linf END AS target_max_abs_distance,
  {', '.join(f'CASE WHEN {keep} THEN {v} END AS {v}' for v in values)} FROM (SELECT t.*, g.*, {_l1} AS l1, {_linf} AS linf FROM targets t, results g)
QUALIFY row_number() OVER (PARTITION BY target_name ORDER BY l1, linf, rank) = 1"""


cte("candidates", candidates_sql(True), "targets", "results")


@lazy_view
def candidates(spark, d):
    results = RV.results(spark, d)
    return X.ablation_candidates(results, WT.best_weights(results))


query("x1_ablation_candidates", "SELECT * FROM candidates", "candidates")(candidates)


@query("x2_exact_ablation_candidates", candidates_sql(False), "targets", "results")
def x2(spark, d):
    results = RV.results(spark, d)
    return X.ablation_candidates(results, WT.best_weights(results), allow_nearest=False)


FAMILIES = {
    **{f"{n}_positive": f"{n}_weight > 0" for n in ("travel", "preference", "zone", "time_window", "workload")},
    "time_window_zero": "time_window_weight = 0",
    "workload_zero": "workload_weight = 0",
    "time_window_and_workload_zero": "time_window_weight = 0 AND workload_weight = 0",
    "all_five_components_positive": " AND ".join(f"{w} > 0" for w in WEIGHTS),
}
cte(
    "families",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS component_family, count(*) AS candidate_count, arg_min(weight_id, rank) AS best_weight_id, min(rank) AS best_rank, arg_min(validation_score, rank) AS best_validation_score,
  {', '.join(f'arg_min({w}, rank) AS best_{w}' for w in WEIGHTS)}, {', '.join(f'avg({m}) AS mean_{m}, quantile_cont(CAST({m} AS DOUBLE), 0.5) AS median_{m}' for m in X.WEIGHT_METRICS)} FROM results WHERE {c}"""
        for n, c in FAMILIES.items()
    ),
    "results",
)


@lazy_view
def families(spark, d):
    return X.component_family_summary(RV.results(spark, d))


query("x3_component_families", "SELECT * FROM families", "families")(families)


@query(
    "x4_weight_correlations",
    f"""SELECT x_name AS weight_component, y_name AS metric, CASE WHEN y_name IN ('avg_travel_time_ratio_to_actual', 'avg_zone_change_count') THEN 'lower_is_better' ELSE 'higher_is_better' END AS metric_direction,
  n, pearson AS pearson_correlation, spearman AS spearman_correlation FROM ({corr_sql('results', [(w, m) for w in WEIGHTS for m in X.WEIGHT_METRICS])})""",
    "results",
)
def x4(spark, d):
    return X.weight_correlations(RV.results(spark, d))


cte("method_summary", RV.summary_sql("metrics", "split, method"), "metrics")
cte(
    "tradeoff",
    " UNION ALL ".join(
        f"""SELECT h.split, '{G.BEST_LABEL}_vs_{b}' AS comparison, '{m}' AS metric, '{'lower' if m in ('avg_travel_time_ratio_to_actual', 'avg_zone_change_count') else 'higher'}_is_better' AS metric_direction,
  h.{m} AS hybrid_value, '{b}' AS baseline_method, k.{m} AS baseline_value, {'k.' + m + ' - h.' + m if m in ('avg_travel_time_ratio_to_actual', 'avg_zone_change_count') else 'h.' + m + ' - k.' + m} AS hybrid_improvement_vs_baseline
FROM method_summary h JOIN method_summary k ON h.split = k.split AND h.method = '{G.BEST_LABEL}' AND k.method = '{b}'"""
        for b in (G.NEAREST, G.PREFERENCE)
        for m in X.METHOD_METRICS
    ),
    "method_summary",
)


@lazy_view
def method_summary(spark, d):
    return G.method_summary(RV.metrics(spark, d), ["split", "method"])


@query(
    "x5_method_tradeoff",
    f"""SELECT *, CASE WHEN baseline_value <> 0 THEN hybrid_improvement_vs_baseline / abs(baseline_value) * 100 END AS hybrid_percent_improvement_vs_baseline,
  CASE WHEN hybrid_improvement_vs_baseline > 0 THEN '{G.BEST_LABEL}' ELSE baseline_method END AS preferred_method_by_mean FROM tradeoff""",
    "tradeoff", recursive=True,
)
def x5(spark, d):
    return X.method_tradeoff(method_summary(spark, d))


@query(
    "x6_finding_ids",
    f"""SELECT 'selected_weight_structure' AS finding_id, 'best_weight_summary' AS evidence, item, value FROM (SELECT unnest([{', '.join(f"{{'item': '{w}', 'value': {w}::DOUBLE}}" for w in WEIGHTS)}], recursive := true) FROM best)
UNION ALL SELECT 'p1_preliminary_competitiveness', 'ablation_weight_candidates', item, value FROM (SELECT unnest([{', '.join(f"{{'item': '{c}', 'value': {c}::DOUBLE}}" for c in ('rank', 'validation_score', 'target_l1_distance'))}], recursive := true)
  FROM candidates WHERE target_name = 'p1_preliminary_all_components' AND matched)
UNION ALL SELECT 'zero_proxy_terms_interpretation', 'best_weight_summary', item, value FROM (SELECT unnest([{', '.join(f"{{'item': '{w}_is_zero', 'value': ({w} = 0)::INT::DOUBLE}}" for w in WEIGHTS)}], recursive := true) FROM best)
UNION ALL SELECT 'hybrid_tradeoff', 'route_generation_method_tradeoff_summary', split || '/' || baseline_method || '/' || metric, hybrid_improvement_vs_baseline FROM tradeoff""",
    "best", "candidates", "tradeoff", recursive=True,
)
def x6(spark, d):
    results = RV.results(spark, d)
    return X.findings(WT.best_weights(results), candidates(spark, d), X.method_tradeoff(method_summary(spark, d)))


# ---- report tables ----------------------------------------------------------------------------------------------
def r4(cols) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in cols)


MODEL_COLS = ("sampled_top1_accuracy", "sampled_top3_accuracy", "sampled_top5_accuracy", "roc_auc", "average_precision", "f1", "log_loss")


@query(
    "r1_model_comparison",
    f"SELECT split, model_name, model_name AS model_display, {r4(MODEL_COLS)} FROM model_metrics WHERE split IN ('validation', 'test')",
    "model_metrics",
)
def r1(spark, d):
    m = PQ.model_metrics(spark, d)
    return R.model_comparison(m.where("split = 'validation'").drop("split"), m.where("split = 'test'").drop("split"))


@query(
    "r1_best_weights",
    f"SELECT 'validation_weight_search' AS source, weight_id, {r4(WEIGHTS)}, {r4(['validation_score'])}, rank, route_count FROM best",
    "best",
)
def r1b(spark, d):
    return R.best_weights_table(WT.best_weights(RV.results(spark, d)))


SUMMARY_COLS = ("avg_travel_time_ratio_to_actual", "avg_lcs_similarity", "avg_position_match_ratio", "avg_generated_same_zone_ratio", "avg_actual_same_zone_ratio", "avg_zone_change_count", "valid_route_rate")
NAME_CASE = "CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.METHOD_NAMES.items()) + " ELSE method END"
cte("route_table", f"SELECT split, method, {NAME_CASE} AS method_display, route_count, {r4(SUMMARY_COLS)} FROM method_summary", "method_summary")


@lazy_view
def route_table(spark, d):
    return R.route_summary_table(method_summary(spark, d))


query("r1_route_summary", "SELECT * FROM route_table", "route_table", recursive=True)(route_table)


@query(
    "r1_statistical_table",
)
def r1c(spark, d):
    return R.statistical_table(T.comparison_summary(tests(spark, d)))


def display_sql(c: str, names) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {c} END"


_rounded = ("mean_a", "mean_b", "mean_improvement", "percent_improvement_vs_b", "cohens_dz_improvement")


@query(
    "r1_statistics_without_tails",
    f"""SELECT split, comparison, {display_sql('method_a', R.METHOD_NAMES)} AS method_a_display, {display_sql('method_b', R.METHOD_NAMES)} AS method_b_display, metric, {display_sql('metric', R.METRIC_LABELS)} AS metric_display,
  metric_direction, n_pairs, {r4(_rounded)}, preferred_method_by_mean FROM effects WHERE metric IN ({', '.join(f"'{m}'" for m in R.KEY_TEST_METRICS)}) OR NOT EXISTS (SELECT 1 FROM effects WHERE metric IN ({', '.join(f"'{m}'" for m in R.KEY_TEST_METRICS)}))""",
    "effects", recursive=True,
)
def r1c2(spark, d):
    return R.statistical_table(T.comparison_summary(tests(spark, d))).drop(*TAILS)


@query(
    "r1_component_families",
    f"SELECT component_family, candidate_count, best_weight_id, best_rank, {r4([c for w in WEIGHTS for c in (f'best_{w}',)] + ['best_validation_score'])}, {r4([f'{k}_{m}' for m in X.WEIGHT_METRICS for k in ('mean', 'median')])} FROM families",
    "families",
)
def r1f(spark, d):
    found = families(spark, d)
    return R.select_present(found, found.columns)


@query(
    "r1_ablation_table",
    f"""SELECT target_name AS candidate_label, weight_id, {r4(WEIGHTS)}, rank, {r4(['validation_score', 'avg_travel_time_ratio_to_actual', 'avg_lcs_similarity', 'avg_generated_same_zone_ratio', 'avg_zone_change_count'])} FROM candidates""",
    "candidates",
)
def r1d(spark, d):
    return R.ablation_table(candidates(spark, d))


@staged_view
def subgroups(spark, d):
    from catalog import pairwise_views as PV

    return subgroup_metrics(PV.scored(spark, d))


cte("subgroup_metrics", PQ.all_sql("subgroup_rows", "split, group_name, group_value"), "subgroup_rows")


def subgroup_table_sql(group: str) -> str:
    rounded = ", ".join(
        f"round({c}, 4) AS {c}"
        for c in ("positive_rate", "accuracy", "precision", "recall", "f1", "log_loss", "roc_auc", "average_precision", "sampled_top1_accuracy",
                  "sampled_top3_accuracy", "sampled_top5_accuracy", "mean_actual_positive_rank", "mrr", "median_actual_positive_rank")
    )
    return f"SELECT * REPLACE ({rounded}) FROM subgroup_metrics WHERE group_name = '{group}'"


@query("r1_overall_metrics", subgroup_table_sql("overall"), "subgroup_metrics")
def r1h(spark, d):
    return R.subgroup_table(subgroups(spark, d), "overall")


@query("r1_subgroup_route_progress", subgroup_table_sql("route_progress_bin"), "subgroup_metrics")
def r1e(spark, d):
    return R.subgroup_table(subgroups(spark, d), "route_progress_bin")


@query(
    "r2_model_pivot",
    "SELECT model_name AS model_display, round(max(sampled_top1_accuracy) FILTER (split = 'test'), 4) AS test, round(max(sampled_top1_accuracy) FILTER (split = 'validation'), 4) AS validation FROM model_metrics GROUP BY model_name",
    "model_metrics",
)
def r2(spark, d):
    return R.model_pivot(r1(spark, d))


@query(
    "r2_weight_bars",
    " UNION ALL ".join(f"SELECT '{w.removesuffix('_weight').replace('_', ' ').title()}' AS component, round({w}, 4) AS weight FROM best" for w in WEIGHTS),
    "best",
)
def r2b(spark, d):
    return R.weight_bars(r1b(spark, d))


@query(
    "r2_tradeoff_points",
    "SELECT method_display, avg_travel_time_ratio_to_actual, avg_generated_same_zone_ratio FROM route_table WHERE split = 'test'",
    "route_table", recursive=True,
)
def r2c(spark, d):
    return R.tradeoff_points(route_table(spark, d))


@query("r2_zone_change_bars", "SELECT method_display, avg_zone_change_count FROM route_table WHERE split = 'test'", "route_table", recursive=True)
def r2d(spark, d):
    return R.zone_change_bars(route_table(spark, d))


@query(
    "r2_family_bars",
    "SELECT component_family, mean_validation_score FROM families ORDER BY mean_validation_score DESC NULLS LAST, component_family LIMIT 12",
    "families",
)
def r2e(spark, d):
    return R.family_bars(families(spark, d))


@query(
    "r2_progress_line",
    "SELECT group_value, round(sampled_top1_accuracy, 4) AS sampled_top1_accuracy FROM subgroup_metrics WHERE split = 'test' AND group_name = 'route_progress_bin'",
    "subgroup_metrics",
)
def r2f(spark, d):
    return R.progress_line(r1e(spark, d))


@query(
    "r3_artifact_manifest",
    """SELECT 'table' AS artifact_type, 'best_hybrid_weights' AS name, CAST(1 AS BIGINT) AS rows, CAST(10 AS BIGINT) AS columns FROM best
UNION ALL SELECT 'table', 'ablation_weight_candidates', count(*), CAST(13 AS BIGINT) FROM candidates""",
    "best", "candidates",
)
def r3(spark, d):
    return R.manifest({"best_hybrid_weights": r1b(spark, d), "ablation_weight_candidates": r1d(spark, d)})
