"""Splits, pairwise samples, models and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import coverage_views as CV
from catalog import pairwise_views as PV
from catalog import views as V
from catalog.registry import cte, lazy_view, query
from routelore.operators import eda as E
from routelore.operators import metrics as M
from routelore.operators import models as ML
from routelore.operators import pairwise as P
from routelore.operators import splits as SP

query("p4_stratified_split", "SELECT * FROM splits", "splits")(PV.splits.lazy)


@query("p4_stratified_split_in_blocks", "SELECT * FROM splits", "splits")
def p4_blocks(spark, d):
    return SP.stratified_split(SP.modelling_routes(V.routes(spark, d), V.routes(spark, d)), PV.RATIOS, PV.SEED, rows_per_block=20)


@query(
    "p5_split_violations",
    """SELECT (SELECT count(*) FROM (SELECT route_id FROM packages EXCEPT SELECT route_id FROM splits)) AS missing_routes,
  (SELECT count(*) FROM (SELECT route_id FROM splits EXCEPT SELECT route_id FROM packages)) AS extra_routes,
  (SELECT count(*) - count(DISTINCT route_id) FROM splits) AS duplicated_rows,
  (SELECT count(*) FROM (SELECT route_id FROM splits GROUP BY route_id HAVING count(DISTINCT split) > 1)) AS routes_in_several_splits,
  (SELECT count(*) FROM splits WHERE split NOT IN ('train', 'validation', 'test')) AS rows_with_unknown_split""",
    "splits", "packages",
)
def p5(spark, d):
    return SP.split_violations(PV.splits(spark, d), V.packages(spark, d))


@query(
    "p6_split_summary",
    """SELECT 'split_total' AS summary_type, split, 'ALL' AS route_score, count(*) AS route_count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM splits) AS percentage_of_all_routes,
  1.0::DOUBLE AS percentage_within_split FROM splits GROUP BY split
UNION ALL SELECT 'route_score_distribution', s.split, route_score, count(*), CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM splits), CAST(count(*) AS DOUBLE) / any_value(t.n)
FROM splits s JOIN (SELECT split, count(*) AS n FROM splits GROUP BY split) t ON s.split = t.split GROUP BY s.split, route_score""",
    "splits",
)
def p6(spark, d):
    return SP.split_summary(PV.splits(spark, d))


@query(
    "a15_score_by_split_pivot",
    """SELECT route_score, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test
FROM splits GROUP BY route_score""",
    "splits",
)
def a15(spark, d):
    return SP.score_by_split_wide(PV.splits(spark, d))


@query(
    "p7_negative_draws",
    """SELECT route_id, position, spot AS candidate_position, CAST(rank = 0 AS BIGINT) AS label, CAST(rank AS BIGINT) AS negative_sample_rank FROM draws""",
    "draws",
)
def p7(spark, d):
    routed = P.stop_sequence(V.transitions(spark, d)).join(PV.requested(spark, d).where("source is not null"), "route_id")
    return P.sample_draws(routed.select("route_id", "position", "sequence_length"), PV.NEGATIVES, PV.SEED).drop("sequence_length")


@query(
    "q25_split_overlap",
    """SELECT a || '_' || b AS comparison, count(x.route_id) AS overlap_count, coalesce(string_agg(x.route_id, ',' ORDER BY x.route_id), '') AS sample_overlapping_route_ids
FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) t(a, b)
LEFT JOIN (SELECT p.route_id, p.split AS s, q.split AS u FROM splits p JOIN splits q ON p.route_id = q.route_id AND p.split <> q.split) x ON x.s = a AND x.u = b GROUP BY a, b""",
    "splits",
)
def q25b(spark, d):
    return E.split_overlap(PV.splits(spark, d))


@query("q25_score_by_split", "SELECT split, route_score, count(*) AS count FROM splits GROUP BY ALL", "splits")
def q25c(spark, d):
    return E.score_by_split(PV.splits(spark, d))


@query(
    "q26_sample_coverage",
    """WITH picked AS (SELECT split, route_id FROM splits QUALIFY row_number() OVER (PARTITION BY split ORDER BY route_id) <= 20)
SELECT 'actual_transitions' AS table_name, split, route_id, route_id IN (SELECT route_id FROM transitions) AS found FROM picked
UNION ALL SELECT 'complete_transitions', split, route_id, route_id IN (SELECT route_id FROM completeness WHERE has_complete_actual_transition_travel_time) FROM picked
UNION ALL SELECT 'stop_package_features', split, route_id, route_id IN (SELECT route_id FROM packages) FROM picked""",
    "splits", "transitions", "completeness", "packages",
)
def q26(spark, d):
    tables = {
        "actual_transitions": V.transitions(spark, d),
        "complete_transitions": CV.completeness(spark, d).where("has_complete_actual_transition_travel_time"),
        "stop_package_features": V.packages(spark, d),
    }
    return E.sample_coverage(PV.splits(spark, d), tables)


@query("m1_pairwise_samples", "SELECT * FROM samples", "samples")
def m1(spark, d):
    return P.pairwise_samples(
        V.transitions(spark, d), V.travel(spark, d), V.stops(spark, d), V.packages(spark, d), PV.requested(spark, d),
        negatives=PV.NEGATIVES, seed=PV.SEED, generation_timestamp="fixed",
    )


@lazy_view
def sample_summary(spark, d):
    return P.sample_summary(
        PV.drawn(spark, d), PV.requested(spark, d), V.transitions(spark, d), V.travel(spark, d), PV.NEGATIVES, PV.SEED
    )


cte(
    "sample_summary",
    """SELECT r.split, r.routes_requested, r.routes_processed, r.routes_skipped_missing_source, r.routes_skipped_missing_transitions,
  positive_samples_written, negative_samples_written, skipped_positive_missing_travel_time, skipped_negative_missing_travel_time,
  positive_samples_written + negative_samples_written AS total_samples_written,
  CASE WHEN positive_samples_written = 0 THEN 0.0 ELSE CAST(negative_samples_written AS DOUBLE) / positive_samples_written END AS average_negatives_per_positive,
  CAST(5 AS BIGINT) AS negative_samples_per_positive_requested, CAST(42 AS BIGINT) AS seed, 'parquet' AS output_format
FROM (SELECT split, count(*) AS routes_requested, count(*) FILTER (m AND t) AS routes_processed, count(*) FILTER (source IS NULL) AS routes_skipped_missing_source,
  count(*) FILTER (m AND NOT t) AS routes_skipped_missing_transitions FROM (SELECT *, EXISTS (SELECT 1 FROM edge_sources e WHERE e.route_id = r.route_id AND e.source = r.source) AS m,
  EXISTS (SELECT 1 FROM transitions t WHERE t.route_id = r.route_id) AS t FROM requested r) GROUP BY split) r
JOIN (SELECT split, count(*) FILTER (label = 1 AND travel_time_ij IS NOT NULL) AS positive_samples_written, count(*) FILTER (label = 0 AND travel_time_ij IS NOT NULL) AS negative_samples_written,
  count(*) FILTER (label = 1 AND travel_time_ij IS NULL) AS skipped_positive_missing_travel_time, count(*) FILTER (label = 0 AND travel_time_ij IS NULL) AS skipped_negative_missing_travel_time
  FROM drawn d WHERE EXISTS (SELECT 1 FROM edge_sources e WHERE e.route_id = d.route_id AND e.source = d.travel_time_source) GROUP BY split) d ON r.split = d.split""",
    "requested", "edge_sources", "transitions", "drawn",
)
query("m2_sample_summary", "SELECT * FROM sample_summary", "sample_summary")(sample_summary)


@query(
    "q27_sample_quality_report",
    """SELECT split || '_positive_samples' AS check_name, CASE WHEN positive_samples_written > 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(positive_samples_written AS VARCHAR) AS value FROM sample_summary
UNION ALL SELECT split || '_negative_samples', CASE WHEN negative_samples_written > 0 THEN 'PASS' ELSE 'FAIL' END, CAST(negative_samples_written AS VARCHAR) FROM sample_summary
UNION ALL SELECT 'label_values_expected', 'INFO', '0/1'""",
    "sample_summary",
)
def q27(spark, d):
    return P.sample_quality_report(sample_summary(spark, d))


@query(
    "m3_context_validation",
    """SELECT split, CAST(sum(n) AS BIGINT) AS rows, count(*) AS decision_contexts, CAST(sum(p) AS BIGINT) AS positive_rows, CAST(sum(n) - sum(p) AS BIGINT) AS negative_rows,
  count(*) FILTER (p = 0) AS contexts_no_positive, count(*) FILTER (p = 1) AS contexts_one_positive, count(*) FILTER (p > 1) AS contexts_multiple_positive,
  count(*) FILTER (p <> 1) AS contexts_not_exactly_one_positive, CAST(0 AS BIGINT) AS rows_with_invalid_label
FROM (SELECT split, route_id, position, count(*) AS n, sum(label) AS p FROM samples GROUP BY ALL) GROUP BY split""",
    "samples",
)
def m3(spark, d):
    return P.validate_contexts(PV.samples(spark, d))


@query(
    "m19_training_data_summary",
    "SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positive_rows, avg(label) AS positive_rate FROM samples GROUP BY split",
    "samples",
)
def m19(spark, d):
    return P.training_data_summary(PV.samples(spark, d))


# ---- metrics ----------------------------------------------------------------------------------------------------
def threshold_sql(src: str, by: str) -> str:
    p = "least(greatest(predicted_probability, 1e-15), 1 - 1e-15)"
    tp, fp, fn = (
        "count(*) FILTER (predicted_probability >= 0.5 AND label = 1)",
        "count(*) FILTER (predicted_probability >= 0.5 AND label = 0)",
        "count(*) FILTER (predicted_probability < 0.5 AND label = 1)",
    )
    return f"""SELECT {by}, count(*) AS rows, count(*) FILTER (label = 1) AS positive_rows, count(*) FILTER (label = 0) AS negative_rows, avg(label) AS positive_rate,
  1 - CAST({fp} + {fn} AS DOUBLE) / count(*) AS accuracy, coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fp}, 0), 0.0) AS precision,
  coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fn}, 0), 0.0) AS recall, coalesce(2.0::DOUBLE * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0) AS f1,
  avg(CASE WHEN label = 1 THEN -ln({p}) ELSE -ln(1 - {p}) END) AS log_loss FROM {src} GROUP BY {by}"""


def curve_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, sum(neg * (cp - pos / 2.0)) / nullif(any_value(ap) * any_value(an), 0) AS roc_auc,
  coalesce(sum(pos * CAST(cp AS DOUBLE) / (cp + cn)) / nullif(any_value(ap), 0), 0.0) AS average_precision FROM (
SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY {by}) AS ap, sum(neg) OVER (PARTITION BY {by}) AS an FROM (
  SELECT {by}, predicted_probability AS p, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS neg FROM {src} GROUP BY ALL)
WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)) GROUP BY {by}"""


def ranking_sql(src: str, by: str, extended: bool = True) -> str:
    more = ", avg(r) AS mean_actual_positive_rank, avg(1.0 / r) AS mrr, quantile_cont(CAST(r AS DOUBLE), 0.5) AS median_actual_positive_rank" if extended else ""
    return f"""SELECT {by}, avg(CAST(r <= 1 AS INT)) AS sampled_top1_accuracy, avg(CAST(r <= 3 AS INT)) AS sampled_top3_accuracy, avg(CAST(r <= 5 AS INT)) AS sampled_top5_accuracy,
  count(r) AS evaluated_contexts, count(*) FILTER (n = 0) AS skipped_contexts_no_positive, count(*) FILTER (n > 1) AS contexts_multiple_positive{more} FROM (
SELECT {by}, route_id, position, min(CASE WHEN label = 1 THEN k END) AS r, count(*) FILTER (label = 1) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY {by}, route_id, position ORDER BY predicted_probability DESC, negative_sample_rank, candidate_stop) AS k FROM {src}) GROUP BY ALL) GROUP BY {by}"""


def all_sql(src: str, by: str, extended: bool = True) -> str:
    keys = ", ".join(by.split(", "))
    return f"SELECT * FROM ({threshold_sql(src, by)}) JOIN ({curve_sql(src, by)}) USING ({keys}) JOIN ({ranking_sql(src, by, extended)}) USING ({keys})"


@query("m9_threshold_metrics", threshold_sql("scored", "split"), "scored")
def m9(spark, d):
    return M.threshold_metrics(PV.scored(spark, d), ["split"])


@query("m10_curve_metrics", curve_sql("scored", "split"), "scored")
def m10(spark, d):
    return M.curve_metrics(PV.scored(spark, d), ["split"])


@query("m11_curve_metrics_in_blocks", curve_sql("scored", "split"), "scored")
def m11(spark, d):
    return M.curve_metrics(PV.scored(spark, d), ["split"], rows_per_block=100)


cte(
    "judged_documents",
    """SELECT 'documents' AS split, l.quality AS label, round(1.0 / (1.0 + exp(-(ln(1.0 + d.n_chars) - 6.0))), 9) AS predicted_probability
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)


@query(
    "m12_document_quality_metrics",
    f"SELECT * FROM ({threshold_sql('judged_documents', 'split')}) JOIN ({curve_sql('judged_documents', 'split')}) USING (split)",
    "judged_documents",
)
def m12(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    p = F.round(1.0 / (1.0 + F.exp(-(F.log(1.0 + F.col("n_chars")) - 6.0))), 9)
    rows = V.table(spark, d, "labels").join(docs, "doc_id").select(
        F.lit("documents").alias("split"), F.col("quality").cast("long").alias("label"), p.alias("predicted_probability")
    )
    return M.threshold_metrics(rows, ["split"]).join(M.curve_metrics(rows, ["split"]), "split")


@query("m13_sampled_topk", ranking_sql("scored", "split", False), "scored")
def m13(spark, d):
    return M.ranking_metrics(PV.scored(spark, d), ["split"], extended=False)


@query("m14_positive_rank_metrics", ranking_sql("scored", "split"), "scored")
def m14(spark, d):
    return M.ranking_metrics(PV.scored(spark, d), ["split"])


@query(
    "w5_positive_ranks",
    """SELECT route_id, position, count(*) FILTER (label = 1) AS positives, min(CASE WHEN label = 1 THEN k END) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY route_id, position ORDER BY predicted_probability DESC, negative_sample_rank, candidate_stop) AS k FROM scored) GROUP BY ALL""",
    "scored",
)
def w5(spark, d):
    return M.positive_ranks(PV.scored(spark, d), [])


def bin_case(source: str, edges, labels) -> str:
    return f"CASE WHEN {source} IS NULL THEN 'Missing' " + " ".join(f"WHEN {source} <= {e} THEN '{l}'" for e, l in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"


def subgroup_sql() -> str:
    groups = {"overall": "'all'", "route_score": "route_score"}
    groups |= {n: bin_case(s, e, l) for n, s, e, l in M.SUBGROUP_BINS}
    groups["transition_zone_type"] = "CASE WHEN same_zone = 1 THEN 'same_zone' WHEN zone_changed = 1 THEN 'zone_changed' ELSE 'zone_missing_or_unknown' END"
    groups["candidate_time_window_group"] = "CASE WHEN candidate_has_time_window = 1 THEN 'has_time_window' ELSE 'no_time_window' END"
    return " UNION ALL ".join(
        f"SELECT split, route_id, position, candidate_stop, negative_sample_rank, label, predicted_probability, '{n}' AS group_name, {e} AS group_value FROM scored"
        for n, e in groups.items()
    )


cte("subgroup_rows", subgroup_sql(), "scored")


@query("b2_subgroup_sizes", "SELECT split, group_name, group_value, count(*) AS rows FROM subgroup_rows GROUP BY ALL", "subgroup_rows")
def b2(spark, d):
    return M.subgroup_rows(PV.scored(spark, d)).groupBy("split", "group_name", "group_value").agg(F.count("*").alias("rows"))


@query("m15_subgroup_metrics", all_sql("subgroup_rows", "split, group_name, group_value"), "subgroup_rows")
def m15(spark, d):
    return M.subgroup_metrics(PV.scored(spark, d))


@lazy_view
def model_metrics(spark, d):
    scored = {m: PV.with_probability(PV.samples(spark, d), m) for m in PV.LOGIT}
    return M.all_metrics(M.stack_models(scored), ["split", "model_name"], extended=False)


cte(
    "model_rows",
    " UNION ALL ".join(f"SELECT *, '{m}' AS model_name, {PV.probability_sql(m)} AS predicted_probability FROM samples" for m in PV.LOGIT),
    "samples",
)
cte("model_metrics", all_sql("model_rows", "split, model_name", False), "model_rows")
BEST = "ORDER BY sampled_top1_accuracy DESC NULLS LAST, roc_auc DESC NULLS LAST, average_precision DESC NULLS LAST, log_loss ASC NULLS LAST, model_name LIMIT 1"


@query("m16_selected_model", f"SELECT * EXCLUDE (split) FROM model_metrics WHERE split = 'validation' {BEST}", "model_metrics")
def m16(spark, d):
    return M.select_best_model(model_metrics(spark, d).where("split = 'validation'").drop("split"))


FIGURES = ("sampled_top1_accuracy", "sampled_top3_accuracy", "sampled_top5_accuracy", "roc_auc", "f1", "average_precision", "log_loss")


@query(
    "m17_best_model_summary",
    f"""SELECT v.model_name, 'validation_sampled_top1_accuracy' AS selection_metric, {', '.join(f'v.{f} AS validation_{f}, t.{f} AS test_{f}' for f in FIGURES)},
  '{",".join(ML.FEATURE_COLUMNS)}' AS feature_columns_used, (SELECT count(*) FROM samples WHERE split = 'train') AS train_rows, (SELECT count(*) FROM samples WHERE split = 'validation') AS validation_rows,
  (SELECT count(*) FROM samples WHERE split = 'test') AS test_rows, CAST(42 AS BIGINT) AS seed
FROM (SELECT * FROM model_metrics WHERE split = 'validation' {BEST}) v JOIN model_metrics t ON t.split = 'test' AND t.model_name = v.model_name""",
    "model_metrics", "samples",
)
def m17(spark, d):
    metrics = model_metrics(spark, d)
    return M.best_model_summary(
        metrics.where("split = 'validation'").drop("split"), metrics.where("split = 'test'").drop("split"),
        ML.FEATURE_COLUMNS, P.training_data_summary(PV.samples(spark, d)), 42,
    )


@query(
    "m17_model_comparison",
    f"SELECT v.model_name, {', '.join(f'v.{f} AS validation_{f}, t.{f} AS test_{f}' for f in FIGURES)} FROM model_metrics v JOIN model_metrics t ON v.model_name = t.model_name AND v.split = 'validation' AND t.split = 'test'",
    "model_metrics",
)
def m17b(spark, d):
    metrics = model_metrics(spark, d).select("split", "model_name", *FIGURES)
    return M.compare_models(metrics.where("split = 'validation'").drop("split"), metrics.where("split = 'test'").drop("split"))


# ---- trained models (rows only: fitted values have no SQL statement) --------------------------------------------
def _fit(spark, d, name: str):
    rows = PV.samples(spark, d)
    features = ML.feature_columns([rows])
    return ML.train(name, rows.where("split = 'train'"), features), rows, features


@query("m6_logistic_regression_topk")
def m6a(spark, d):
    model, rows, features = _fit(spark, d, "logistic_regression")
    return M.all_metrics(ML.score(model, rows.where("split <> 'train'"), features), ["split"], extended=False)


@query("m6_random_forest_topk")
def m6b(spark, d):
    model, rows, features = _fit(spark, d, "random_forest")
    return M.all_metrics(ML.score(model, rows.where("split <> 'train'"), features), ["split"], extended=False)


@query("m8_boosted_tree_predictions")
def m8(spark, d):
    model, rows, features = _fit(spark, d, "gradient_boosted_trees")
    return ML.prediction_table(ML.score(model, rows.where("split = 'test'"), features), "gradient_boosted_trees")


@query("m18_feature_importance")
def m18(spark, d):
    model, _rows, features = _fit(spark, d, "logistic_regression")
    return ML.feature_importance(model, "logistic_regression", features, spark)


@query("m5_class_weights", """SELECT label, count(*) AS rows, round(any_value(w), 9) AS class_weight FROM (SELECT label, CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY label)) AS w
FROM samples WHERE split = 'train') GROUP BY label""", "samples")
def m5(spark, d):
    weighted = ML.with_class_weights(PV.samples(spark, d).where("split = 'train'"))
    return weighted.groupBy("label").agg(F.count("*").alias("rows"), F.round(F.max("class_weight"), 9).alias("class_weight"))


@query(
    "m5_median_fills",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(quantile_cont(CAST(CAST({c} AS FLOAT) AS DOUBLE), 0.5), 0) AS fill FROM samples WHERE split = 'train'" for c in ML.FEATURE_COLUMNS),
    "samples",
)
def m5b(spark, d):
    return ML.median_fills(ML.prepare(PV.samples(spark, d).where("split = 'train'"), ML.FEATURE_COLUMNS), ML.FEATURE_COLUMNS)


_saved = ["travel_time_ij", " same_zone", "", "route_score", "candidate_package_count", "same_zone", "never_recorded"]


@query(
    "m4_served_features",
    """SELECT split, count(*) AS rows, sum(travel_time_ij) AS travel_time_ij, sum(same_zone::DOUBLE) AS same_zone, sum(candidate_package_count) AS candidate_package_count, 0.0::DOUBLE AS never_recorded FROM samples GROUP BY split""",
    "samples",
)
def m4(spark, d):
    """A saved feature list read again: blanks, repeats and the route's score go, what the table lacks is served as 0."""
    names = ML.serving_columns(_saved)
    served = ML.serving_frame(PV.samples(spark, d), names)
    return served.groupBy("split").agg(F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in names])


@query(
    "m7_training_status",
    """SELECT 'logistic_regression' AS model_name, 'trained' AS status, '' AS reason WHERE (SELECT count(*) FROM samples WHERE split = 'train') > 0
UNION ALL SELECT 'no_such_model', 'skipped', 'ValueError: unknown model: no_such_model'""",
    "samples",
)
def m7(spark, d):
    rows = PV.samples(spark, d)
    return ML.train_all(["logistic_regression", "no_such_model"], rows.where("split = 'train'"), ML.feature_columns([rows]))[1]
