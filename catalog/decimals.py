"""Decimals to which each query's floating columns are rounded, on the Spark and on the SQL side alike, so that
sums taken in another order compare equal."""

DECIMALS: dict[str, dict[int, str]] = {
    "c1_stop_base_features": {
        6: "lat lng",
    },
    "c2_route_summary": {
        6: "executor_capacity_cm3 missing_zone_ratio",
    },
    "c4_stop_package_features": {
        4: "total_package_volume_cm3",
        6: "total_planned_service_time",
    },
    "c8_missing_value_summary": {
        6: "missing_ratio",
    },
    "j2_stop_packages_zero_filled": {
        4: "total_package_volume_cm3",
    },
    "j6_edge_lookup": {
        6: "travel_time_ij",
    },
    "j7_missing_side_kept": {
        6: "travel_time_ij",
    },
    "j13_nearest_vectors": {
        6: "target_l_discount target_l_tax target_l1_distance target_max_abs_distance l_discount l_tax",
    },
    "q2_route_validity": {
        6: "usable_route_percentage",
    },
    "q4_route_outlier_summary": {
        6: "mean std max p25 p50 p75 p95 p99 lower_bound upper_bound min p01 p05 outlier_percentage",
    },
    "q4_package_outlier_summary": {
        4: "max",
        6: (
            "mean std p05 p25 p50 p75 p95 p99 lower_bound upper_bound extreme_high_threshold_p99 min p01 "
            "outlier_percentage zero_value_percentage"
        ),
    },
    "q7_dropoff_package_check": {
        6: "station_package_count dropoff_zero_package_ratio",
    },
    "q8_feature_reliability": {
        6: "missing_ratio",
    },
    "q9_single_source_summary": {
        6: (
            "average_actual_transition_travel_time max_actual_transition_travel_time "
            "median_actual_transition_travel_time p95_actual_transition_travel_time missing_travel_time_ratio"
        ),
    },
    "q12_multi_source_completeness": {
        6: "missing_travel_time_ratio",
    },
    "q12_multi_source_integrity": {
        6: (
            "average_actual_transition_travel_time max_actual_transition_travel_time "
            "median_actual_transition_travel_time p95_actual_transition_travel_time missing_travel_time_ratio"
        ),
    },
    "q12_source_transition_summary": {
        6: "missing_travel_time_ratio",
    },
    "q13_complete_route_transitions": {
        6: "travel_time_ij",
    },
    "q30_quality_closing_summary": {
        6: (
            "zone_id_missing_ratio planned_service_time_missing_ratio package_dimensions_missing_ratio "
            "scan_status_missing_ratio travel_time_missing_ratio"
        ),
    },
    "q14_training_flag_summary": {
        6: "percentage",
    },
    "q15_zone_missing_summary": {
        6: "missing_zone_ratio",
    },
    "q16_package_feature_summary": {
        4: "total_package_volume_cm3",
        6: "package_count total_planned_service_time",
    },
    "q16_time_window_summary": {
        6: "percentage",
    },
    "q17_same_zone_summary": {
        6: "same_zone_ratio",
    },
    "q17_zone_continuity_overall": {
        6: "same_zone_ratio",
    },
    "q17_travel_time_by_same_zone": {
        6: "mean median p95",
    },
    "q18_progress_by_time_window": {
        6: "mean median std min max",
    },
    "q18_progress_quartiles_by_time_window": {
        6: "mean median p25 p75",
    },
    "q18_time_window_rate_by_bin": {
        6: "bin_low bin_high time_window_stop_rate",
    },
    "q19_burden_by_bin": {
        6: "total_package_volume_cm3 bin_low bin_high package_count total_planned_service_time",
    },
    "q19_burden_stats_by_bin": {
        6: (
            "to_total_package_volume_cm3_mean to_total_package_volume_cm3_median to_total_package_volume_cm3_p95 "
            "to_package_count_mean to_package_count_median to_package_count_p95 "
            "to_total_planned_service_time_mean to_total_planned_service_time_median "
            "to_total_planned_service_time_p95"
        ),
    },
    "q20_eda_dataset_summary": {
        6: (
            "average_stops_per_route average_package_count_per_stop average_service_time_per_stop "
            "percentage_stops_with_time_window"
        ),
    },
    "q21_transition_features": {
        4: "to_total_package_volume_cm3",
        6: "travel_time_ij route_progress to_total_planned_service_time",
    },
    "q22_travel_time_summary": {
        6: "value",
    },
    "q22_travel_time_by_score": {
        6: "mean median p95",
    },
    "q23_score_feature_comparison": {
        6: (
            "average_travel_time_ij average_to_total_package_volume_cm3 same_zone_ratio average_to_package_count "
            "average_to_total_planned_service_time time_window_stop_ratio"
        ),
    },
    "q28_route_size_summary": {
        6: "number_of_stops",
    },
    "q28_route_size_histogram": {
        6: "bin_low bin_high",
    },
    "q29_eda_closing_summary": {
        6: (
            "same_zone_transition_ratio percentage_of_stops_with_time_windows average_package_count_per_stop "
            "average_service_time_per_stop"
        ),
    },
    "a1_sums_and_means_with_null_groups": {
        6: "mean_capacity",
    },
    "a3_exact_quantiles": {
        6: "p01 p50 p99",
    },
    "a3_exact_quantiles_in_blocks": {
        6: "p01 p50 p99",
    },
    "a5_route_score_distribution": {
        6: "percentage",
    },
    "a10_feature_correlations": {
        6: "pearson spearman",
    },
    "a11_adjusted_skewness": {
        6: "skew",
    },
    "w4_sequence_progress": {
        6: "route_progress",
    },
    "w9_average_ranks": {
        6: "average_rank value",
    },
    "w9_average_ranks_in_blocks": {
        6: "average_rank value",
    },
    "b1_equal_width_bins": {
        6: "l_extendedprice bin_low bin_high",
    },
    "b4_histogram": {
        6: "bin_low bin_high",
    },
    "b5_five_numbers": {
        6: "q1 median q3 max min",
    },
    "k5_best_row": {
        6: "executor_capacity_cm3",
    },
    "p6_split_summary": {
        6: "percentage_of_all_routes percentage_within_split",
    },
    "m1_pairwise_samples": {
        4: "candidate_total_package_volume_cm3",
        6: (
            "travel_time_ij route_progress candidate_package_count candidate_total_planned_service_time "
            "candidate_time_window_package_count candidate_delivered_count candidate_attempted_count "
            "candidate_rejected_count candidate_unknown_status_count"
        ),
    },
    "m2_sample_summary": {
        6: "average_negatives_per_positive",
    },
    "m19_training_data_summary": {
        6: "positive_rate",
    },
    "m9_threshold_metrics": {
        6: "positive_rate accuracy precision recall f1 log_loss",
    },
    "m10_curve_metrics": {
        6: "roc_auc average_precision",
    },
    "m11_curve_metrics_in_blocks": {
        6: "roc_auc average_precision",
    },
    "m12_document_quality_metrics": {
        6: "positive_rate accuracy precision recall f1 log_loss roc_auc average_precision",
    },
    "m13_sampled_topk": {
        6: "sampled_top1_accuracy sampled_top3_accuracy sampled_top5_accuracy",
    },
    "m14_positive_rank_metrics": {
        6: (
            "sampled_top1_accuracy sampled_top3_accuracy sampled_top5_accuracy mean_actual_positive_rank mrr "
            "median_actual_positive_rank"
        ),
    },
    "m15_subgroup_metrics": {
        6: (
            "positive_rate accuracy precision recall f1 log_loss roc_auc average_precision sampled_top1_accuracy "
            "sampled_top3_accuracy sampled_top5_accuracy mean_actual_positive_rank mrr "
            "median_actual_positive_rank"
        ),
    },
    "m16_selected_model": {
        6: (
            "positive_rate accuracy precision recall f1 log_loss roc_auc average_precision sampled_top1_accuracy "
            "sampled_top3_accuracy sampled_top5_accuracy"
        ),
    },
    "m17_best_model_summary": {
        6: (
            "validation_sampled_top1_accuracy validation_sampled_top3_accuracy validation_sampled_top5_accuracy "
            "validation_roc_auc validation_f1 validation_average_precision validation_log_loss "
            "test_sampled_top1_accuracy test_sampled_top3_accuracy test_sampled_top5_accuracy test_roc_auc "
            "test_f1 test_average_precision test_log_loss"
        ),
    },
    "m17_model_comparison": {
        6: (
            "validation_sampled_top1_accuracy validation_sampled_top3_accuracy validation_sampled_top5_accuracy "
            "validation_roc_auc validation_f1 validation_average_precision validation_log_loss "
            "test_sampled_top1_accuracy test_sampled_top3_accuracy test_sampled_top5_accuracy test_roc_auc "
            "test_f1 test_average_precision test_log_loss"
        ),
    },
    "m5_median_fills": {
        6: "fill",
    },
    "m5_class_weights": {
        6: "class_weight",
    },
    "g3_candidate_features": {
        6: (
            "travel_time travel_time_ij number_of_stops remaining_stop_count candidate_package_count "
            "candidate_has_time_window travel_norm zone_penalty time_window_risk workload_norm"
        ),
    },
    "f23_weights_from_text": {
        9: "travel_weight preference_weight zone_weight time_window_weight workload_weight",
    },
    "g13_grid_mean_costs": {
        6: "mean_cost",
    },
    "m4_served_features": {
        6: "travel_time_ij same_zone candidate_package_count",
    },
    "t9_named_metrics_and_comparisons": {
        6: "a b",
    },
    "u2_pooled_routes": {
        6: "lcs_similarity",
    },
    "g5_greedy_routes": {
        6: "travel_time probability cost",
    },
    "g6_actual_route_totals": {
        6: "total_travel_time same_zone_ratio",
    },
    "g7_order_agreement": {
        6: "lcs_similarity position_match_ratio",
    },
    "g9_generated_leg_totals": {
        6: "total_travel_time same_zone_ratio",
    },
    "g11_route_metrics": {
        6: (
            "actual_total_travel_time generated_total_travel_time travel_time_ratio_to_actual lcs_similarity "
            "position_match_ratio generated_same_zone_ratio actual_same_zone_ratio"
        ),
    },
    "g12_method_summary": {
        6: (
            "avg_actual_total_travel_time avg_generated_total_travel_time avg_travel_time_ratio_to_actual "
            "avg_lcs_similarity avg_position_match_ratio avg_generated_same_zone_ratio avg_actual_same_zone_ratio "
            "avg_zone_change_count valid_route_rate"
        ),
    },
    "g16_weight_results": {
        6: (
            "travel_weight preference_weight zone_weight time_window_weight workload_weight "
            "avg_actual_total_travel_time avg_generated_total_travel_time avg_travel_time_ratio_to_actual "
            "avg_lcs_similarity avg_position_match_ratio avg_generated_same_zone_ratio avg_actual_same_zone_ratio "
            "avg_zone_change_count valid_route_rate travel_score lcs_score same_zone_score position_score "
            "validation_score"
        ),
    },
    "g17_baseline_metrics": {
        6: "lcs_similarity",
    },
    "s15_best_weight_row": {
        6: "travel_weight preference_weight zone_weight time_window_weight workload_weight",
    },
    "g19_stops_from_samples": {
        4: "total_package_volume_cm3",
        6: (
            "package_count total_planned_service_time has_time_window time_window_package_count delivered_count "
            "attempted_count rejected_count unknown_status_count"
        ),
    },
    "t1_descriptive_stats": {
        6: "mean std min max median q1 q3",
    },
    "t2_paired_values": {
        6: "a b",
    },
    "t3_paired_effects": {
        6: (
            "mean_a mean_b mean_difference_a_minus_b mean_improvement median_a median_b "
            "median_difference_a_minus_b percent_improvement_vs_b cohens_dz_raw cohens_dz_improvement "
            "paired_t_statistic"
        ),
    },
    "t6_bootstrap_intervals": {
        6: "bootstrap_ci_low bootstrap_ci_high",
    },
    "t7_tests_without_tails": {
        6: (
            "mean_a mean_b mean_difference_a_minus_b mean_improvement median_a median_b "
            "median_difference_a_minus_b percent_improvement_vs_b cohens_dz_raw cohens_dz_improvement "
            "paired_t_statistic wilcoxon_statistic bootstrap_ci_low bootstrap_ci_high"
        ),
    },
    "t8_summary_without_tails": {
        6: "mean_a mean_b mean_improvement percent_improvement_vs_b cohens_dz_improvement",
    },
    "r1_statistics_without_tails": {
        6: "mean_a mean_b mean_improvement percent_improvement_vs_b cohens_dz_improvement",
    },
    "t5_wilcoxon_statistics": {
        6: "wilcoxon_statistic tie_sum",
    },
    "x1_ablation_candidates": {
        6: (
            "target_travel_weight target_preference_weight target_zone_weight target_time_window_weight "
            "target_workload_weight travel_weight preference_weight zone_weight time_window_weight "
            "workload_weight target_l1_distance target_max_abs_distance avg_travel_time_ratio_to_actual "
            "avg_lcs_similarity avg_position_match_ratio avg_generated_same_zone_ratio avg_zone_change_count "
            "validation_score valid_route_rate"
        ),
    },
    "x2_exact_ablation_candidates": {
        6: (
            "target_travel_weight target_preference_weight target_zone_weight target_time_window_weight "
            "target_workload_weight travel_weight preference_weight zone_weight time_window_weight "
            "workload_weight target_l1_distance target_max_abs_distance avg_travel_time_ratio_to_actual "
            "avg_lcs_similarity avg_position_match_ratio avg_generated_same_zone_ratio avg_zone_change_count "
            "validation_score valid_route_rate"
        ),
    },
    "x3_component_families": {
        6: (
            "best_validation_score best_travel_weight best_preference_weight best_zone_weight "
            "best_time_window_weight best_workload_weight mean_avg_travel_time_ratio_to_actual "
            "mean_avg_lcs_similarity mean_avg_position_match_ratio mean_avg_generated_same_zone_ratio "
            "mean_avg_zone_change_count mean_validation_score mean_rank median_avg_travel_time_ratio_to_actual "
            "median_avg_lcs_similarity median_avg_position_match_ratio median_avg_generated_same_zone_ratio "
            "median_avg_zone_change_count median_validation_score median_rank"
        ),
    },
    "x4_weight_correlations": {
        6: "pearson_correlation spearman_correlation",
    },
    "x6_finding_ids": {
        6: "value",
    },
    "x5_method_tradeoff": {
        6: "hybrid_value baseline_value hybrid_improvement_vs_baseline hybrid_percent_improvement_vs_baseline",
    },
    "r1_model_comparison": {
        6: (
            "sampled_top1_accuracy sampled_top3_accuracy sampled_top5_accuracy roc_auc average_precision f1 "
            "log_loss"
        ),
    },
    "r1_best_weights": {
        6: "travel_weight preference_weight zone_weight time_window_weight workload_weight validation_score",
    },
    "r1_route_summary": {
        6: (
            "avg_travel_time_ratio_to_actual avg_lcs_similarity avg_position_match_ratio "
            "avg_generated_same_zone_ratio avg_actual_same_zone_ratio avg_zone_change_count valid_route_rate"
        ),
    },
    "r1_ablation_table": {
        6: (
            "travel_weight preference_weight zone_weight time_window_weight workload_weight validation_score "
            "avg_travel_time_ratio_to_actual avg_lcs_similarity avg_generated_same_zone_ratio "
            "avg_zone_change_count"
        ),
    },
    "r1_overall_metrics": {
        6: (
            "positive_rate accuracy precision recall f1 log_loss roc_auc average_precision sampled_top1_accuracy "
            "sampled_top3_accuracy sampled_top5_accuracy mean_actual_positive_rank mrr "
            "median_actual_positive_rank"
        ),
    },
    "r1_subgroup_route_progress": {
        6: (
            "positive_rate accuracy precision recall f1 log_loss roc_auc average_precision sampled_top1_accuracy "
            "sampled_top3_accuracy sampled_top5_accuracy mean_actual_positive_rank mrr "
            "median_actual_positive_rank"
        ),
    },
    "r2_model_pivot": {
        6: "test validation",
    },
    "r2_weight_bars": {
        6: "weight",
    },
    "r2_tradeoff_points": {
        6: "avg_travel_time_ratio_to_actual avg_generated_same_zone_ratio",
    },
    "r2_zone_change_bars": {
        6: "avg_zone_change_count",
    },
    "r2_family_bars": {
        6: "mean_validation_score",
    },
    "r2_progress_line": {
        6: "sampled_top1_accuracy",
    },
    "f1_missing_and_lenient_values": {
        6: "number decimal_value",
    },
    "f2_non_finite_to_null": {
        6: "q",
    },
    "f13_status_window_volume": {
        6: "volume",
    },
    "f16_progress_and_costs": {
        6: "of_stops of_sequence of_serving p zone_penalty risk workload cost",
    },
    "f17_percent_of_total": {
        6: "percentage",
    },
    "f24_names_directions_rounding": {
        6: "price",
    },
    "s1_nested_stops": {
        6: "lat lng",
    },
    "s2_multi_part_union": {
        6: "executor_capacity_cm3",
    },
    "s3_travel_matrix_edges": {
        6: "travel_time",
    },
    "s4_checked_csv": {
        4: "total_package_volume_cm3",
        6: "total_planned_service_time",
    },
    "s5_pruned_sample_columns": {
        6: "travel_time_ij route_progress",
    },
    "s7_typed_sample_table": {
        4: "candidate_total_package_volume_cm3",
        6: (
            "travel_time_ij route_progress candidate_package_count candidate_total_planned_service_time "
            "candidate_time_window_package_count candidate_delivered_count candidate_attempted_count "
            "candidate_rejected_count candidate_unknown_status_count"
        ),
    },
    "s9_run_summary": {
        6: "undefined_ratio mean_stops",
    },
}
