"""Final report tables and the tables behind figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators import routing as G
from routelore.operators.ordering import attach_single_row
from routelore.operators.sampling import top_rows
from routelore.operators.weights import best_weights
from routelore.schemas import WEIGHTS

# Display names and the column choice of each table.
MODEL_NAMES = {
    "random_forest": "Random Forest",
    "logistic_regression": "Logistic Regression",
    "gradient_boosted_trees": "Gradient Boosted Trees",
}
METHOD_NAMES = {G.BEST_LABEL: "Hybrid greedy", G.NEAREST: "Travel-time NN", G.PREFERENCE: "Preference greedy"}
METRIC_LABELS = {
    "sampled_top1_accuracy": "Sampled top-1 accuracy",
    "sampled_top3_accuracy": "Sampled top-3 accuracy",
    "sampled_top5_accuracy": "Sampled top-5 accuracy",
    "roc_auc": "ROC-AUC",
    "average_precision": "Average precision",
    "f1": "F1",
    "log_loss": "Log loss",
    "avg_travel_time_ratio_to_actual": "Travel-time ratio to actual",
    "avg_lcs_similarity": "LCS similarity",
    "avg_position_match_ratio": "Position-match ratio",
    "avg_generated_same_zone_ratio": "Generated same-zone ratio",
    "avg_zone_change_count": "Zone-change count",
    "generated_total_travel_time": "Generated travel time",
    "travel_time_ratio_to_actual": "Travel-time ratio to actual",
    "lcs_similarity": "LCS similarity",
    "position_match_ratio": "Position-match ratio",
    "generated_same_zone_ratio": "Generated same-zone ratio",
    "zone_change_count": "Zone-change count",
    "validation_score": "Validation score",
}
KEY_TEST_METRICS = (
    "travel_time_ratio_to_actual",
    "lcs_similarity",
    "position_match_ratio",
    "generated_same_zone_ratio",
    "zone_change_count",
)


def select_present(df: DataFrame, columns: Sequence[str], decimals: int = 4) -> DataFrame:
    """The listed columns that exist, with floating columns rounded."""
    return S.round_numbers(df.select(*[c for c in columns if c in df.columns]), decimals)


def model_comparison(validation: DataFrame, test: DataFrame) -> DataFrame:
    both = validation.withColumn("split", F.lit("validation")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True
    )
    named = both.withColumn("model_display", S.display_name(F.col("model_name"), MODEL_NAMES))
    columns = ["split", "model_name", "model_display", "sampled_top1_accuracy", "sampled_top3_accuracy", "sampled_top5_accuracy",
               "roc_auc", "average_precision", "f1", "log_loss"]
    return select_present(named, columns).orderBy("split", F.desc("sampled_top1_accuracy"), "model_name")


def best_weights_table(searched: DataFrame, used: DataFrame | None = None) -> DataFrame:
    parts = [best_weights(searched).withColumn("source", F.lit("validation_weight_search"))]
    if used is not None:
        parts.append(best_weights(used).withColumn("source", F.lit("route_generation_used")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return select_present(both, ["source", "weight_id", *WEIGHTS, "validation_score", "rank", "route_count"])


def route_summary_table(summary: DataFrame) -> DataFrame:
    named = summary.withColumn("method_display", S.display_name(F.col("method"), METHOD_NAMES))
    columns = ["split", "method", "method_display", "route_count", "avg_travel_time_ratio_to_actual", "avg_lcs_similarity",
               "avg_position_match_ratio", "avg_generated_same_zone_ratio", "avg_actual_same_zone_ratio", "avg_zone_change_count",
               "valid_route_rate"]
    return select_present(named, columns)


def statistical_table(comparisons: DataFrame) -> DataFrame:
    """Key metrics only, or all of them when none of the key metrics is there."""
    key = F.col("metric").isin(*KEY_TEST_METRICS)
    flagged = attach_single_row(comparisons, comparisons.agg(F.coalesce(F.bool_or(key), F.lit(False)).alias("__any")))
    named = flagged.where(~F.col("__any") | key).withColumns(
        {
            "method_a_display": S.display_name(F.col("method_a"), METHOD_NAMES),
            "method_b_display": S.display_name(F.col("method_b"), METHOD_NAMES),
            "metric_display": S.display_name(F.col("metric"), METRIC_LABELS),
        }
    )
    columns = ["split", "comparison", "method_a_display", "method_b_display", "metric", "metric_display", "metric_direction", "n_pairs",
               "mean_a", "mean_b", "mean_improvement", "percent_improvement_vs_b", "paired_t_p_value", "wilcoxon_p_value",
               "cohens_dz_improvement", "preferred_method_by_mean"]
    return select_present(named, columns)


def ablation_table(candidates: DataFrame) -> DataFrame:
    """Ablation candidates with their label, which is the target's name."""
    labelled = candidates.withColumn("candidate_label", F.col("target_name"))
    columns = ["candidate_label", "weight_id", *WEIGHTS, "rank", "validation_score", "avg_travel_time_ratio_to_actual",
               "avg_lcs_similarity", "avg_generated_same_zone_ratio", "avg_zone_change_count"]
    return select_present(labelled, columns)


def subgroup_table(subgroups: DataFrame, group_name: str) -> DataFrame:
    rows = subgroups.where(F.col("group_name") == group_name)
    return S.round_numbers(rows, 4).orderBy("split", "group_value")


def importance_table(importances: DataFrame, selected: str, n: int = 20) -> DataFrame:
    """The most important features, of the selected model if it is listed."""
    return S.round_numbers(top_rows(importances, "importance", n, prefer=("model_name", selected)), 4)


# ---- figure data ------------------------------------------------------------------------------------------------
def model_pivot(table: DataFrame) -> DataFrame:
    """Top-1 accuracy, one row per model and one column per split."""
    return table.groupBy("model_display").pivot("split", ["test", "validation"]).agg(F.first("sampled_top1_accuracy"))


def weight_bars(table: DataFrame) -> DataFrame:
    """component and weight of the first listed weight vector."""
    pairs = [F.struct(F.lit(w.removesuffix("_weight").replace("_", " ").title()).alias("component"), F.col(w).alias("weight")) for w in WEIGHTS]
    return table.orderBy(F.desc("source")).limit(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def _test_rows(table: DataFrame) -> DataFrame:
    test = F.col("split") == "test"
    flagged = attach_single_row(table, table.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("__any")))
    return flagged.where(~F.col("__any") | test).select(*table.columns)


def tradeoff_points(table: DataFrame) -> DataFrame:
    return _test_rows(table).select("method_display", "avg_travel_time_ratio_to_actual", "avg_generated_same_zone_ratio")


def zone_change_bars(table: DataFrame) -> DataFrame:
    return _test_rows(table).select("method_display", "avg_zone_change_count")


def family_bars(families: DataFrame, n: int = 12) -> DataFrame:
    rows = families.select("component_family", "mean_validation_score")
    return rows.orderBy(F.desc_nulls_last("mean_validation_score"), "component_family").limit(n)


def progress_line(subgroups: DataFrame) -> DataFrame:
    return _test_rows(subgroups).select("group_value", "sampled_top1_accuracy")


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """artifact_type, name, rows and columns of each table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit("table").alias("artifact_type"), F.lit(n).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
        )
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
