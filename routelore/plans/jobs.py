"""Jobs from files to files: clean, check, split, sample, train, search weights, generate routes, compare, report.

Every job reads the tables of earlier jobs from ``root`` and writes its own as Parquet below it. Tables are written
once, so a lost executor repeats tasks, not jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from routelore.functions import scalars as S
from routelore.operators import (
    ablation,
    cleaning,
    coverage,
    distribution,
    eda,
    features,
    metrics,
    models,
    pairwise,
    quality,
    report,
    routing,
    splits as splitting,
    stats,
    weights,
)
from routelore.operators.scoring import from_pipeline
from routelore.schemas import WEIGHTS
from routelore.sources import files, nested

COMPARISONS = ((routing.BEST_LABEL, routing.NEAREST), (routing.BEST_LABEL, routing.PREFERENCE))


class Tables:
    """Named Parquet tables below a root folder."""

    def __init__(self, spark: SparkSession, root: str, overwrite: bool = False):
        self.spark, self.root, self.overwrite = spark, root.rstrip("/"), overwrite

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        if not nested.path_exists(self.spark, self.path(name)):
            raise FileNotFoundError(f"table {name} is missing; run the job that writes it first")
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        mode = files.guard(self.spark, self.path(name), self.overwrite)
        df.write.mode(mode).partitionBy(*partition_by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name)) if not partition_by else self.read(name)


def clean(t: Tables, parts: Sequence[nested.Part], travel_files: Mapping[str, str]) -> None:
    """Raw nested files to cleaned tables, quality report, missing summary and the edge table."""
    spark = t.spark
    raw_routes, raw_stops, raw_sequence, raw_packages = (
        nested.read_parts(spark, parts, k) for k in ("routes", "stops", "sequence", "packages")
    )
    routes = cleaning.route_summary(raw_routes, raw_stops)
    t.write("routes_summary", routes)
    t.write("stops_base_features", cleaning.stop_base_features(raw_stops))
    t.write("actual_transitions", cleaning.actual_transitions(raw_sequence))
    t.write("stop_package_features", cleaning.stop_package_features(raw_packages))
    report_rows = cleaning.data_quality_report(routes, raw_stops, raw_sequence, raw_packages)
    t.write("data_quality_report", report_rows)
    t.write("missing_value_summary", cleaning.missing_value_summary(routes, raw_packages))
    edges = nested.read_edges(spark, dict(travel_files)).repartition("route_id", "from_stop")
    t.write("edges", edges.sortWithinPartitions("route_id", "from_stop"), ["source"])


def check_quality(t: Tables) -> None:
    """Consistency, validity, outliers, coverage and the training recommendation."""
    routes, stops, moves = t.read("routes_summary"), t.read("stops_base_features"), t.read("actual_transitions")
    packages, report_rows, missing = t.read("stop_package_features"), t.read("data_quality_report"), t.read("missing_value_summary")
    edges = t.read("edges")
    t.write("dataset_consistency_summary", quality.dataset_consistency(routes, stops, moves, packages, report_rows))
    t.write("training_route_filter_summary", quality.route_validity(report_rows))
    t.write("unusable_routes_detail", quality.unusable_routes(report_rows, routes))
    t.write("route_level_outlier_summary", quality.outlier_summary(routes, quality.ROUTE_OUTLIER_COLUMNS))
    t.write("stop_package_outlier_summary", quality.outlier_summary(packages, quality.PACKAGE_OUTLIER_COLUMNS, True))
    t.write("route_outlier_flags", quality.with_outlier_flags(routes, quality.ROUTE_OUTLIER_COLUMNS))
    t.write("stop_package_outlier_flags", quality.with_outlier_flags(packages, quality.PACKAGE_OUTLIER_COLUMNS))
    station = t.write("station_sequence_check", quality.station_sequence_check(routes, report_rows, moves))
    dropoff = t.write("dropoff_package_check", quality.dropoff_package_check(stops, packages))
    t.write("feature_reliability_summary", quality.feature_reliability(missing, stops, packages))
    lookup = t.write("route_travel_time_source_lookup", coverage.source_lookup(moves, edges))
    detail = t.write("actual_transition_travel_time", coverage.multi_source_detail(moves, edges, lookup))
    complete = t.write("route_travel_time_completeness", coverage.multi_source_completeness(detail))
    t.write("travel_time_integrity_summary", coverage.multi_source_integrity(lookup, detail))
    t.write("travel_time_source_transition_summary", coverage.source_transition_summary(complete))
    t.write("travel_time_complete_routes", coverage.complete_routes(complete))
    single = coverage.single_source_detail(moves, edges.where(F.col("source") == "training_build"))
    t.write("single_source_completeness", coverage.single_source_completeness(single))
    t.write("single_source_summary", coverage.single_source_summary(single))
    ready = t.write(
        "training_ready_routes",
        quality.training_ready_routes(routes, report_rows, station, complete, routes, dropoff),
    )
    t.write("quality_closing_summary", quality.quality_closing_summary(missing, station, dropoff, ready, detail))


def explore(t: Tables) -> None:
    """Transition features and their summaries."""
    routes, stops, packages = t.read("routes_summary"), t.read("stops_base_features"), t.read("stop_package_features")
    clean_moves = coverage.clean_transitions(t.read("actual_transition_travel_time"))
    frame = t.write("transition_features", features.transition_features(clean_moves, routes, stops, packages))
    t.write("travel_time_summary", eda.travel_time_summary(frame))
    t.write("travel_time_by_route_score", eda.travel_time_by_score(frame))
    t.write("same_zone_transition_summary", eda.zone_continuity_overall(frame))
    t.write("route_score_feature_comparison", eda.score_feature_comparison(frame))
    t.write("package_service_position_summary", eda.burden_stats_by_bin(frame))
    t.write("feature_justification_summary", eda.feature_justification(frame))
    report_rows, moves = t.read("data_quality_report"), t.read("actual_transitions")
    t.write("route_score_distribution", eda.route_score_distribution(routes))
    t.write("training_flag_summary", eda.training_flag_summary(report_rows))
    t.write("zone_missing_by_route_score", eda.zone_missing_summary(stops, routes))
    t.write("package_feature_summary", eda.package_feature_summary(packages))
    t.write("time_window_distribution", eda.time_window_summary(packages))
    t.write("progress_quartiles_by_time_window", eda.progress_quartiles_by_time_window(frame))
    t.write("time_window_rate_by_progress_bin", eda.time_window_rate_by_bin(frame))
    t.write("travel_time_by_same_zone", eda.travel_time_by_same_zone(frame))
    t.write("route_size_summary", distribution.describe(routes, ["number_of_stops"]))
    t.write("route_size_histogram", distribution.histogram(routes, "number_of_stops", 30))
    t.write("travel_time_histogram", distribution.histogram(frame, "travel_time_ij", 40))
    t.write("travel_time_box_by_route_score", distribution.five_numbers(frame, ["route_score"], "travel_time_ij"))
    names = eda.NUMERIC_FEATURES
    t.write("feature_correlations", distribution.correlations(frame, [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]))
    t.write("eda_closing_summary", eda.eda_closing_summary(routes, stops, packages, moves, report_rows, frame))


def split(t: Tables, ratios: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 42, complete_only: bool = True) -> None:
    """Leak-free split of the complete routes; violations are an error."""
    routes = t.read("routes_summary")
    base = t.read("travel_time_complete_routes") if complete_only else routes
    table = splitting.modelling_routes(base, routes)
    out = t.write("route_splits", splitting.stratified_split(table, ratios, seed))
    found = {k: v for k, v in splitting.split_violations(out, table).first().asDict().items() if v}
    if found:
        raise ValueError(f"invalid split: {found}")
    t.write("split_summary", splitting.split_summary(out))
    t.write("split_overlap_check", eda.split_overlap(out))
    t.write("route_score_by_split", eda.score_by_split(out))
    known = {n: t.read(n) for n in ("actual_transitions", "stop_package_features", "travel_time_complete_routes")}
    t.write("split_sample_coverage", eda.sample_coverage(out, known))


def sample(t: Tables, negatives: int = 5, seed: int = 42, generation_timestamp: str = "") -> None:
    """Pairwise samples per split, with summary and quality report."""
    if negatives < 0:
        raise ValueError("the number of negatives must not be negative")
    moves, edges, routes = t.read("actual_transitions"), t.read("edges"), t.read("routes_summary")
    wanted = pairwise.requested_routes(t.read("route_splits"), routes, t.read("route_travel_time_source_lookup"))
    drawn = t.write(
        "pairwise_draws",
        pairwise.candidate_rows(
            moves, edges, t.read("stops_base_features"), t.read("stop_package_features"), wanted, negatives=negatives, seed=seed,
            generation_timestamp=generation_timestamp,
        ),
    )
    t.write("pairwise_samples", drawn.where(F.col("travel_time_ij").isNotNull()), ["split"])
    summary = t.write("pairwise_sample_summary", pairwise.sample_summary(drawn, wanted, moves, edges, negatives, seed))
    t.write("pairwise_quality_report", pairwise.sample_quality_report(summary))
    t.write("pairwise_context_summary", pairwise.validate_contexts(drawn.where(F.col("travel_time_ij").isNotNull())))


def train(t: Tables, names: Sequence[str] = models.MODEL_NAMES, seed: int = 42, **options) -> str:
    """Fits the models, compares them on both held-out splits, saves them, and returns the selected name."""
    rows = t.read("pairwise_samples")
    used = models.feature_columns([rows])
    fitted, status = models.train_all(names, rows.where("split = 'train'"), used, seed=seed, **options)
    t.write("model_training_status", status)
    if not fitted:
        raise RuntimeError("no model could be trained")
    held_out = rows.where("split <> 'train'")
    scored = metrics.stack_models({n: models.score(m, held_out, used) for n, m in fitted.items()})
    scored = t.write("predictions", scored)
    table = t.write("model_metrics", metrics.all_metrics(scored, ["split", "model_name"], extended=False))
    validation, test = (table.where(F.col("split") == s).drop("split") for s in ("validation", "test"))
    t.write("model_comparison", report.model_comparison(validation, test))
    best = metrics.select_best_model(validation).first()["model_name"]
    t.write(
        "best_model_summary",
        metrics.best_model_summary(validation, test, used, pairwise.training_data_summary(rows), seed),
    )
    # Coefficients and tree splits refer to features by place, so scoring must use this very list.
    t.write("model_features", t.spark.createDataFrame(list(enumerate(used)), "place int, feature string").coalesce(1))
    for name, model in fitted.items():
        model.write().overwrite().save(t.path(f"models/{name}"))
    importances = [models.feature_importance(m, n, used, t.spark) for n, m in fitted.items()]
    joined = importances[0]
    for more in importances[1:]:
        joined = joined.unionByName(more)
    t.write("feature_importance", joined)
    chosen = scored.where(F.col("model_name") == best)
    t.write("subgroup_metrics", metrics.subgroup_metrics(chosen.drop("model_name")))
    return best


def load_scorer(t: Tables, name: str):
    """Scorer of a saved model over the features it was trained on, in their order."""
    from pyspark.ml import PipelineModel

    used = [r["feature"] for r in t.read("model_features").orderBy("place").collect()]  # as many as the model has
    if models.serving_columns(used) != used:
        raise ValueError("the saved feature list has blanks, repeats or the route score")
    return from_pipeline(PipelineModel.load(t.path(f"models/{name}")), used)


def _admit(t: Tables, split_names: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    moves, edges, lookup = t.read("actual_transitions"), t.read("edges"), t.read("route_travel_time_source_lookup")
    ids = t.read("route_splits").where(F.col("split").isin(*split_names))
    admitted = routing.route_admission(routing.sequence_admission(ids, pairwise.stop_sequence(moves)), lookup, edges)
    headers = pairwise.requested_routes(ids, t.read("routes_summary"), lookup).drop("source")
    wanted = headers.join(admitted.where("route_status = 'ok'").select("route_id", "source"), "route_id")
    members = pairwise.attributed_sequence(moves, t.read("stops_base_features"), t.read("stop_package_features"), wanted)
    return admitted, members, routing.edges_of_admitted(edges, admitted)


def search_weights(t: Tables, scorer, step: float = 0.05, max_vectors: int | None = 300, seed: int = 42) -> None:
    """Evaluates weight vectors on the validation routes and ranks them."""
    admitted, members, edges = _admit(t, ["validation"])
    members, edges = t.write("search_members", members), t.write("search_edges", edges)
    t.write("weight_search_run_summary", routing.admission_counts(admitted))
    grid = t.write("weight_grid", weights.weight_grid(t.spark, step, max_vectors, seed))
    actual = members.select("route_id", "position", "stop_id")
    rows = t.write("weight_route_metrics", weights.evaluate_weights(members, edges, grid, scorer, actual))
    results = t.write("weight_grid_results", weights.weight_results(rows))
    t.write("best_weight_summary", weights.best_weights(results))


def generate(t: Tables, scorer, split_names: Sequence[str] = ("validation", "test"), weights_text: str | None = None) -> None:
    """Routes of the three methods and their metrics, with the best weights or those given as text, five numbers with commas between."""
    best = t.read("best_weight_summary").first()
    plan = (best["weight_id"], [best[w] for w in WEIGHTS])
    if weights_text is not None:
        plan = ("given", list(S.parse_weights(weights_text, WEIGHTS).values()))
    plans = [
        (routing.NEAREST, "", (0.0,) * 5),
        (routing.PREFERENCE, "", (0.0,) * 5),
        (routing.HYBRID, *plan),
    ]
    admitted, members, edges = _admit(t, split_names)
    members, edges = t.write("route_members", members), t.write("route_edges", edges)
    t.write("route_generation_run_summary", routing.admission_counts(admitted))
    header = members.where(F.col("position") == 0).select("route_id", "split")
    label = F.when(F.col("method") == routing.HYBRID, routing.BEST_LABEL).otherwise(F.col("method"))
    steps = routing.generate_routes(members, edges, plans, scorer).withColumn("method", label)
    steps = t.write("generated_route_steps", steps)
    t.write("generated_routes", steps.join(header, "route_id").select("split", "route_id", "method", "position", "stop_id"))
    rows = routing.route_metrics(
        steps, members.select("route_id", "position", "stop_id"), edges, members.select("route_id", "stop_id", "zone")
    ).join(header, "route_id")
    rows = t.write("route_metrics", rows)
    t.write("method_summary", routing.method_summary(rows, ["split", "method"]))
    t.write("baseline_route_metrics", weights.baseline_metrics(rows, t.read("weight_route_metrics"), t.read("best_weight_summary")))


def compare(t: Tables, iterations: int = 2000, alpha: float = 0.05, seed: int = 42) -> None:
    """Descriptive statistics, paired tests and the ablation tables."""
    rows = t.read("route_metrics")
    names = stats.select_metrics(rows)
    both = rows.unionByName(stats.pooled_splits(rows))
    t.write("descriptive_stats_by_method", stats.descriptive(both, names))
    tests = t.write("paired_statistical_tests", stats.paired_tests(rows, COMPARISONS, iterations=iterations, alpha=alpha, seed=seed))
    t.write("pairwise_comparison_summary", stats.comparison_summary(tests))
    results, best = t.read("weight_grid_results"), t.read("best_weight_summary")
    candidates = t.write("ablation_weight_candidates", ablation.ablation_candidates(results, best))
    t.write("component_family_summary", ablation.component_family_summary(results))
    t.write("component_weight_correlation", ablation.weight_correlations(results))
    tradeoff = t.write("route_generation_method_tradeoff", ablation.method_tradeoff(t.read("method_summary")))
    t.write("ablation_findings", ablation.findings(best, candidates, tradeoff, tests))


def final_tables(t: Tables, selected_model: str) -> DataFrame:
    """The ten report tables and a manifest of them."""
    tables = {
        "table_01_model_comparison": t.read("model_comparison"),
        "table_02_best_hybrid_weights": report.best_weights_table(t.read("best_weight_summary")),
        "table_03_route_generation_summary": report.route_summary_table(t.read("method_summary")),
        "table_04_statistical_tests_summary": report.statistical_table(t.read("pairwise_comparison_summary")),
        "table_05_ablation_weight_candidates": report.ablation_table(t.read("ablation_weight_candidates")),
        "table_06_component_family_summary": report.select_present(
            t.read("component_family_summary"), t.read("component_family_summary").columns
        ),
        "table_07_ablation_interpretation": t.read("ablation_findings"),
        "table_08_preference_overall_metrics": report.subgroup_table(t.read("subgroup_metrics"), "overall"),
        "table_09_subgroup_route_progress": report.subgroup_table(t.read("subgroup_metrics"), "route_progress_bin"),
        "table_10_top_feature_importance": report.importance_table(t.read("feature_importance"), selected_model),
    }
    figures = {
        "figure_model_comparison": report.model_pivot(tables["table_01_model_comparison"]),
        "figure_best_weights": report.weight_bars(tables["table_02_best_hybrid_weights"]),
        "figure_tradeoff": report.tradeoff_points(tables["table_03_route_generation_summary"]),
        "figure_zone_changes": report.zone_change_bars(tables["table_03_route_generation_summary"]),
        "figure_component_families": report.family_bars(t.read("component_family_summary")),
        "figure_route_progress": report.progress_line(tables["table_09_subgroup_route_progress"]),
    }
    for name, df in figures.items():
        t.write(name, df)
    written = {n: t.write(n, df) for n, df in tables.items()}
    return t.write("manifest", report.manifest(written))
