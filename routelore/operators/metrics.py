"""Classification and ranking metrics of scored decisions, for any number of groups in one job.

Input rows: label (0/1), predicted_probability, route_id, position, negative_sample_rank, candidate_stop, and the
group columns named by ``by``. Ties in probability keep the stored order: positives (rank 0) first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from routelore.functions import scalars as S
from routelore.operators.distribution import fixed_bins, quantiles_of_counts
from routelore.operators.joins import outer_join_prefixed
from routelore.operators.ordering import null_safe_join, running_totals, shared_blocks, side_by_side
from routelore.sources.staging import stage_table


# Subgroup column, source column, right-closed edges and labels.
SUBGROUP_BINS = (
    ("number_of_stops_bin", "number_of_stops", (50, 100, 150, 200), ("<=50", "51-100", "101-150", "151-200", ">200")),
    ("route_progress_bin", "route_progress", (0.2, 0.4, 0.6, 0.8), ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")),
    ("remaining_stop_count_bin", "remaining_stop_count", (10, 25, 50, 100), ("<=10", "11-25", "26-50", "51-100", ">100")),
    ("candidate_package_count_bin", "candidate_package_count", (0, 1, 2, 5), ("0", "1", "2", "3-5", ">5")),
    ("candidate_service_time_bin", "candidate_total_planned_service_time", (0, 60, 120, 300),
     ("0", "1-60", "61-120", "121-300", ">300")),
)
RANKING_COLUMNS = (
    "sampled_top1_accuracy",
    "sampled_top3_accuracy",
    "sampled_top5_accuracy",
    "evaluated_contexts",
    "skipped_contexts_no_positive",
    "contexts_multiple_positive",
    "mean_actual_positive_rank",
    "median_actual_positive_rank",
    "mrr",
)


def _p() -> Column:
    return F.col("predicted_probability")


def _y() -> Column:
    return F.col("label")


def _cells(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positive and negative rows per (group, probability): all that the threshold and curve metrics need."""
    return df.groupBy(*by, "predicted_probability").agg(
        F.count_if(_y() == 1).alias("pos"), F.count_if(_y() == 0).alias("neg"), F.count("*").alias("n")
    )


def _threshold_sums(threshold: float) -> list[Column]:
    hit, p = _p() >= threshold, S.clip_probability(_p())
    pos, neg = F.col("pos"), F.col("neg")
    return [
        F.sum("n").alias("rows"),
        F.sum(pos).alias("positive_rows"),
        F.sum(neg).alias("negative_rows"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("__tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("__fp"),
        F.sum(F.when(hit, 0).otherwise(pos)).alias("__fn"),
        F.try_divide(F.sum(-F.log(p) * pos - F.log(1 - p) * neg), F.sum("n")).alias("log_loss"),
    ]


def _threshold_columns() -> list[Column]:
    tp, fp, fn, n = (F.col(c) for c in ("__tp", "__fp", "__fn", "rows"))
    return [
        n,
        F.col("positive_rows"),
        F.col("negative_rows"),
        S.ratio(F.col("positive_rows"), n).alias("positive_rate"),
        S.ratio(n - fp - fn, n).alias("accuracy"),
        S.ratio(tp, tp + fp).alias("precision"),
        S.ratio(tp, tp + fn).alias("recall"),
        S.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.col("log_loss"),
    ]


def threshold_metrics(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 (0 on zero division) and log loss per group."""
    sums = _cells(df, by).groupBy(*by).agg(*_threshold_sums(threshold))
    return sums.select(*by, *_threshold_columns())


def _curve_sums() -> list[Column]:
    pos, neg, above, below = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg"))
    n_pos, n_neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return [
        F.try_divide(F.sum(neg * (above - pos / 2)), n_pos * n_neg).alias("roc_auc"),
        F.coalesce(F.try_divide(F.sum(pos * above / (above + below)), n_pos), F.lit(0.0)).alias("average_precision"),
    ]


def _falling(cells: DataFrame, by: Sequence[str], **blocks: int) -> DataFrame:
    return running_totals(cells, list(by), "predicted_probability", ["pos", "neg"], descending=True, **blocks)


def curve_metrics(df: DataFrame, by: Sequence[str], **blocks: int) -> DataFrame:
    """roc_auc (ties count half; null with one class) and average_precision (0 without positives) per group.

    Rows are first reduced to one cell per (group, probability); cells are cumulated by falling probability.
    """
    return _falling(_cells(df, by), by, **blocks).groupBy(*by).agg(*_curve_sums())


def classification_metrics(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Threshold and curve metrics from the same cells, in one pass over the rows."""
    return _classification(_cells(df, by), by, threshold)


def _classification(cells: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    sums = _falling(cells, by).groupBy(*by).agg(*_threshold_sums(threshold), *_curve_sums())
    return sums.select(*by, *_threshold_columns(), "roc_auc", "average_precision")


def _order() -> Column:
    return F.struct((-_p()).alias("p"), F.col("negative_sample_rank").alias("r"), F.col("candidate_stop").alias("s"))


def positive_ranks(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per decision: number of positives and the rank of the best one (null without positives).

    Two aggregations instead of a window: the best positive of a decision, then how many rows come before it.
    """
    keys = [*by, "route_id", "position"]
    # One struct key: null parts compare equal in it, and aggregation and join share its partitioning.
    rows = df.select(F.struct(*keys).alias("__c"), _order().alias("__o"), _y().alias("__y"))
    best = rows.where(F.col("__y") == 1).groupBy("__c").agg(F.min("__o").alias("__best"), F.count("*").alias("positives"))
    ranked = rows.join(best, "__c", "left").groupBy("__c").agg(
        F.coalesce(F.max("positives"), F.lit(0).cast("long")).alias("positives"),
        F.when(F.max("positives") > 0, F.count_if(F.col("__o") < F.col("__best")) + 1).alias("rank"),
    )
    return ranked.select("__c.*", "positives", "rank")


def _part_ranks(df: DataFrame, by: Sequence[str], codes: Sequence[Column]) -> DataFrame:
    """``positive_ranks`` of whole decisions (part 0, code 0) and of the candidates that share a code (part k for ``codes[k - 1]``, below 16), from rows
    that are shuffled once: a decision's best positives, one for each part and code, meet its rows as one short list."""
    packed = reduce(Column.bitwiseOR, [F.shiftleft(c, 4 * i) for i, c in enumerate(codes)])
    rows = df.select(F.struct(*by, "route_id", "position").alias("__c"), _order().alias("__o"), _y().alias("__y"), packed.alias("__g"))
    each = F.posexplode(F.array(F.lit(0), *[F.shiftright("__g", 4 * i).bitwiseAND(F.lit(15)) for i in range(len(codes))])).alias("part", "code")
    positives = rows.where(F.col("__y") == 1).repartition("__c").select("__c", "__o", each)
    best = positives.groupBy("__c", "part", "code").agg(F.min("__o").alias("best"), F.count("*").alias("positives"))
    listed = best.groupBy("__c").agg(F.collect_list(F.struct("part", "code", "best", "positives")).alias("__bests"))  # one for each code at most
    met = rows.join(listed.hint("merge"), "__c", "left").select("__c", "__o", "__bests", each)
    own = F.get(F.filter("__bests", lambda b: (b["part"] == F.col("part")) & (b["code"] == F.col("code"))), F.lit(0))
    ranked = met.select("__c", "__o", "part", "code", own.alias("__own")).groupBy("__c", "part", "code").agg(
        F.coalesce(F.max("__own.positives"), F.lit(0).cast("long")).alias("positives"),
        F.when(F.max("__own.positives") > 0, F.count_if(F.col("__o") < F.col("__own.best")) + 1).alias("rank"),
    )
    return ranked.select("__c.*", "part", "code", "positives", "rank")


def ranking_metrics(df: DataFrame, by: Sequence[str], extended: bool = True) -> DataFrame:
    """Top-1/3/5 accuracy and decision counts per group; extended adds mean and median rank and MRR."""
    return _ranking(positive_ranks(df, by), list(by), extended)


def _ranking(ranks: DataFrame, by: list[str], extended: bool) -> DataFrame:
    """From one row per decision, counted first: there are few different ranks, however many decisions."""
    counted = ranks.groupBy(*by, "positives", "rank").agg(F.count("*").alias("n"))
    if extended:
        counted = stage_table(counted, "rank_counts")  # read twice
    rank, n = F.col("rank"), F.col("n")
    ranked = F.sum(F.when(rank.isNotNull(), n))
    out = counted.groupBy(*by).agg(
        *[F.try_divide(F.sum(F.when(rank <= k, n).when(rank.isNotNull(), 0)), ranked).alias(f"sampled_top{k}_accuracy") for k in (1, 3, 5)],
        F.coalesce(ranked, F.lit(0).cast("long")).alias("evaluated_contexts"),
        F.sum(F.when(F.col("positives") == 0, n).otherwise(0)).alias("skipped_contexts_no_positive"),
        F.sum(F.when(F.col("positives") > 1, n).otherwise(0)).alias("contexts_multiple_positive"),
        F.try_divide(F.sum(rank * n), ranked).alias("mean_actual_positive_rank"),
        F.try_divide(F.sum(n / rank), ranked).alias("mrr"),
    )
    if not extended:
        return out.drop("mean_actual_positive_rank", "mrr")
    values = counted.where(rank.isNotNull()).groupBy(*by, rank.cast("double").alias("value")).agg(F.sum("n").alias("n"))
    middle = quantiles_of_counts(values, by, {"median_actual_positive_rank": 0.5})
    return null_safe_join(out, middle.drop("n"), by, "left")


def all_metrics(df: DataFrame, by: Sequence[str], extended: bool = True) -> DataFrame:
    """Every metric of a group in one row."""
    by = list(by)
    return null_safe_join(classification_metrics(df, by), ranking_metrics(df, by, extended), by, "left")


def with_subgroups(df: DataFrame) -> DataFrame:
    """Adds the eight subgroup labels to sample rows."""
    binned = {name: fixed_bins(F.col(source), edges, labels) for name, source, edges, labels in SUBGROUP_BINS}
    zone = (
        F.when(F.col("same_zone") == 1, "same_zone")
        .when(F.col("zone_changed") == 1, "zone_changed")
        .otherwise("zone_missing_or_unknown")
    )
    window = F.when(F.col("candidate_has_time_window") == 1, "has_time_window").otherwise("no_time_window")
    return df.withColumns(
        {
            "route_score": S.clean_route_score(F.col("route_score")),
            **binned,
            "transition_zone_type": zone,
            "candidate_time_window_group": window,
        }
    )


#: Subgroups that all candidates of a decision share, and those that differ between them.
DECISION_GROUPS = ("route_score", "number_of_stops_bin", "route_progress_bin", "remaining_stop_count_bin")
CANDIDATE_GROUPS = ("candidate_package_count_bin", "candidate_service_time_bin", "transition_zone_type", "candidate_time_window_group")
SUBGROUPS = (*DECISION_GROUPS, *CANDIDATE_GROUPS)
_KEPT = ("split", "route_id", "position", "candidate_stop", "negative_sample_rank", "label", "predicted_probability")


def _by_group(df: DataFrame, kept: Sequence[str], groups: Sequence[str], overall: bool = False) -> DataFrame:
    """The rows once for each named group column, as group_name and group_value, and once for all of them."""
    named = [F.struct(F.lit("overall").alias("group_name"), F.lit("all").alias("group_value"))] if overall else []
    named += [F.struct(F.lit(g).alias("group_name"), F.col(g).alias("group_value")) for g in groups]
    return df.select(*kept, F.explode(F.array(*named)).alias("g")).select(*kept, "g.*")


def subgroup_rows(df: DataFrame) -> DataFrame:
    """Scored rows repeated once for the whole split and once per subgroup column they belong to."""
    return _by_group(with_subgroups(df), _KEPT, SUBGROUPS, overall=True)


#: The values of each subgroup but the route's score, which is any text.
_VALUES = {
    **{name: (*labels, "Missing") for name, _source, _edges, labels in SUBGROUP_BINS},
    "transition_zone_type": ("same_zone", "zone_changed", "zone_missing_or_unknown"),
    "candidate_time_window_group": ("has_time_window", "no_time_window"),
}


def _code(group: str) -> Column:
    return F.array_position(F.array(*map(F.lit, _VALUES[group])), F.col(group)).cast("int")


def _packed(groups: Sequence[str]) -> Column:
    """The values of some groups as one number, four bits each."""
    return reduce(Column.bitwiseOR, [F.shiftleft(_code(g), 4 * i) for i, g in enumerate(groups)])


def _unpacked(packed: str, groups: Sequence[str]) -> dict[str, Column]:
    return {g: _value(g, F.shiftright(packed, 4 * i).bitwiseAND(F.lit(15))) for i, g in enumerate(groups)}


def _value(group: str, code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _VALUES[group])), code)


def _named(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("group_name"), value.alias("group_value"))


def _subgroup_ranks(rows: DataFrame) -> DataFrame:
    """split, group_name, group_value, positives and rank: a decision once for each group that it belongs to as a whole, and once for each
    value of a group that divides its candidates."""
    packed, own = DECISION_GROUPS[1:], F.col("code")
    coded = rows.withColumn("__g", _packed(packed))
    ranks = _part_ranks(coded, ["split", "route_score", "__g"], [_code(g) for g in CANDIDATE_GROUPS])
    whole = [_named("overall", F.lit("all")), _named("route_score", F.col("route_score")), *[_named(g, v) for g, v in _unpacked("__g", packed).items()]]
    groups = F.when(F.col("part") == 0, F.array(*whole))
    for k, g in enumerate(CANDIDATE_GROUPS, start=1):
        groups = groups.when(F.col("part") == k, F.array(_named(g, _value(g, own))))
    return ranks.select("split", "positives", "rank", F.explode(groups).alias("g")).select("split", "g.*", "positives", "rank")


def _subgroup_curves(rows: DataFrame, **blocks: int) -> DataFrame:
    """Threshold and curve metrics of every subgroup, from counts per combination of groups and probability.

    Counts are dealt by blocks of probabilities that all groups share, so they are shuffled before they are repeated per group. What comes before
    a block joins it as a count of its own for each group, which the running totals start from.
    """
    by, packed, counts = ["split", "group_name", "group_value"], [g for g in SUBGROUPS if g != "route_score"], ("pos", "neg", "n")
    cells = _cells(rows.withColumn("__g", _packed(packed)), ["split", "route_score", "__g"])
    placed = shared_blocks(stage_table(cells, "subgroup_cells"), "predicted_probability", **blocks)
    every = F.array(_named("overall", F.lit("all")), _named("route_score", F.col("route_score")), *[_named(g, v) for g, v in _unpacked("__g", packed).items()])

    totals = placed.select("__block", "split", "pos", "neg", F.explode(every).alias("g")).groupBy("__block", "split", "g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = W.partitionBy("split", "g").orderBy(F.desc("__block")).rowsBetween(W.unboundedPreceding, -1)  # a row per block
    before = stage_table(totals.select("__block", "split", "g", *[F.sum(c).over(earlier).alias(c) for c in ("pos", "neg")]).where("pos IS NOT NULL"), "before_blocks")
    none = F.lit(None)
    first = before.select("__block", "split", none.cast("string").alias("route_score"), none.cast("int").alias("__g"), none.cast("double").alias("predicted_probability"),
                          "pos", "neg", F.lit(0).cast("long").alias("n"), "g")
    own = placed.withColumn("g", none.cast(before.schema["g"].dataType))
    dealt = own.unionByName(first).repartition("__block")
    named = dealt.select("__block", "split", "predicted_probability", *counts, F.col("g").isNotNull().alias("__before"),
                         F.explode(F.when(F.col("g").isNull(), every).otherwise(F.array("g"))).alias("g"))
    summed = named.groupBy("__block", "split", "g", "__before", "predicted_probability").agg(*[F.sum(c).alias(c) for c in counts])
    upto = W.partitionBy("__block", "split", "g").orderBy(F.desc("__before"), F.desc("predicted_probability")).rowsBetween(W.unboundedPreceding, W.currentRow)
    located = summed.select("split", "g.*", "__before", "predicted_probability", *counts, *[F.sum(c).over(upto).alias(f"cum_{c}") for c in ("pos", "neg")])
    sums = located.where(~F.col("__before")).groupBy(*by).agg(*_threshold_sums(0.5), *_curve_sums())
    return sums.select(*by, *_threshold_columns(), "roc_auc", "average_precision")


def subgroup_metrics(df: DataFrame, **blocks: int) -> DataFrame:
    """All metrics per split, overall and for every value of every subgroup, as one long table.

    Rows are shuffled once for the ranks and once for the curves, with their groups as numbers, and repeated per group only where they then lie.
    """
    by = ["split", "group_name", "group_value"]
    rows = with_subgroups(df)
    return null_safe_join(_subgroup_curves(rows, **blocks), _ranking(_subgroup_ranks(rows), by, True), by, "left")


def select_best_model(metrics: DataFrame) -> DataFrame:
    """The model with highest top-1, then ROC-AUC, then average precision, then lowest log loss; missing is worst."""
    return metrics.orderBy(
        *[
            F.desc_nulls_last(S.finite(F.col(c)))
            for c in ("sampled_top1_accuracy", "roc_auc", "average_precision")
        ],
        F.asc_nulls_last(S.finite(F.col("log_loss"))),
        "model_name",
    ).limit(1)


def compare_models(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Validation and test metrics of each model side by side."""
    return outer_join_prefixed(validation, test, "model_name", ("validation", "test"))


def best_model_summary(validation: DataFrame, test: DataFrame, features: Sequence[str], rows: DataFrame, seed: int) -> DataFrame:
    """One row: the selected model with its validation and test figures and the training set sizes.

    ``rows`` has split and rows.
    """
    figures = (
        "sampled_top1_accuracy",
        "sampled_top3_accuracy",
        "sampled_top5_accuracy",
        "roc_auc",
        "f1",
        "average_precision",
        "log_loss",
    )
    chosen = select_best_model(validation).select("model_name")
    wide = compare_models(
        validation.select("model_name", *figures), test.select("model_name", *figures)
    ).join(F.broadcast(chosen), "model_name", "left_semi")
    sizes = rows.agg(
        *[F.max(F.when(F.col("split") == s, F.col("rows"))).alias(f"{s}_rows") for s in ("train", "validation", "test")]
    )
    return side_by_side(wide, sizes).select(
        "model_name",
        F.lit("validation_sampled_top1_accuracy").alias("selection_metric"),
        *[f"{side}_{f}" for side in ("validation", "test") for f in figures],
        F.lit(",".join(features)).alias("feature_columns_used"),
        "train_rows",
        "validation_rows",
        "test_rows",
        F.lit(seed).cast("long").alias("seed"),
    )


def stack_models(scored: dict[str, DataFrame]) -> DataFrame:
    """Scored frames of several models under a model_name column."""
    return reduce(DataFrame.unionByName, [df.withColumn("model_name", F.lit(n)) for n, df in scored.items()])
