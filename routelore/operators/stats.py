"""Paired comparison of route-generation methods."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.distribution import average_ranks, long_form, quantiles, summary

DEFAULT_METRICS = (
    "generated_total_travel_time",
    "travel_time_ratio_to_actual",
    "lcs_similarity",
    "position_match_ratio",
    "generated_same_zone_ratio",
    "zone_change_count",
)
GROUP = ["split", "comparison", "metric"]


def parse_comparison(text: str) -> tuple[str, str]:
    """METHOD_A:METHOD_B as a pair."""
    a, colon, b = (p.strip() for p in text.partition(":"))
    if not colon or not a or not b:
        raise ValueError(f"a comparison must be METHOD_A:METHOD_B, got {text!r}")
    return a, b


def select_metrics(df: DataFrame, names: Sequence[str] = ("all",)) -> list[str]:
    """The default metrics or the named ones, as far as the frame has them."""
    wanted = DEFAULT_METRICS if list(names) == ["all"] else [n for n in names if n != "all"]
    found = [m for m in wanted if m in df.columns]
    if not found:
        raise ValueError("no requested metric is available")
    return found


def pooled_splits(metrics: DataFrame, name: str = "all_splits") -> DataFrame:
    """The rows of all splits under one name, with split-prefixed route ids so that routes stay distinct."""
    return metrics.withColumn("route_id", F.concat("split", F.lit("::"), "route_id")).withColumn("split", F.lit(name))


def descriptive(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """n, mean, std, median, quartiles, min and max per split, method and metric."""
    rows = long_form(metrics, ["split", "method"], names, "metric")
    out = summary(rows, ["split", "method", "metric"], {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return out.withColumnRenamed("count", "n")


def paired_values(metrics: DataFrame, comparisons: Sequence[tuple[str, str]], names: Sequence[str]) -> DataFrame:
    """split, comparison, method_a, method_b, metric, route_id, a, b: complete pairs of per-route means."""
    methods = sorted({m for pair in comparisons for m in pair})
    rows = long_form(metrics, ["split", "route_id", "method"], names, "metric")
    wide = rows.groupBy("split", "route_id", "metric").agg(
        *[F.avg(F.when(F.col("method") == m, F.col("value"))).alias(f"m{i}") for i, m in enumerate(methods)]
    )
    pairs = [
        F.struct(
            F.lit(f"{a}_vs_{b}").alias("comparison"),
            F.lit(a).alias("method_a"),
            F.lit(b).alias("method_b"),
            F.col(f"m{methods.index(a)}").alias("a"),
            F.col(f"m{methods.index(b)}").alias("b"),
        )
        for a, b in comparisons
    ]
    out = wide.select("split", "route_id", "metric", F.explode(F.array(*pairs)).alias("p"))
    return out.select("split", "route_id", "metric", "p.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())


def with_difference(pairs: DataFrame) -> DataFrame:
    """Adds metric_direction, diff (a - b) and improvement (positive when a is better)."""
    diff = F.col("a") - F.col("b")
    direction = S.metric_direction(F.col("metric"))
    return pairs.withColumns(
        {
            "metric_direction": direction,
            "diff": diff,
            "improvement": F.when(direction == "lower_is_better", -diff).otherwise(diff),
        }
    )


def _close(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= 1e-9 * F.greatest(F.abs(x), F.abs(y))


def paired_effects(pairs: DataFrame) -> DataFrame:
    """Means, medians, differences, percent improvement, Cohen's dz and paired t statistic per comparison."""
    rows = with_difference(pairs)
    base = rows.groupBy(*GROUP, "method_a", "method_b", "metric_direction").agg(
        F.count("*").alias("n_pairs"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg("diff").alias("mean_difference_a_minus_b"),
        F.avg("improvement").alias("mean_improvement"),
        F.stddev_samp("diff").alias("__sd"),
        F.max(F.abs("diff")).alias("__largest"),
    )
    medians = {"a": "median_a", "b": "median_b", "diff": "median_difference_a_minus_b"}
    middles = quantiles(long_form(rows, GROUP, list(medians), "of"), [*GROUP, "of"], {"middle": 0.5})
    out = base.join(middles.groupBy(*GROUP).agg(*[F.max(F.when(F.col("of") == v, F.col("middle"))).alias(n) for v, n in medians.items()]), GROUP)
    sd, n = F.col("__sd"), F.col("n_pairs")
    root = F.sqrt(n.cast("double"))
    return out.withColumns(
        {
            "percent_improvement_vs_b": F.when(F.col("mean_b") != 0, F.col("mean_improvement") / F.abs("mean_b") * 100),
            "cohens_dz_raw": F.when(sd != 0, F.col("mean_difference_a_minus_b") / sd),
            "cohens_dz_improvement": F.when(sd != 0, F.col("mean_improvement") / sd),
            "paired_t_statistic": F.when((n >= 2) & (sd > 1e-8), F.col("mean_difference_a_minus_b") / (sd / root)),
            "preferred_method_by_mean": F.when(_close(F.col("mean_a"), F.col("mean_b")), "tie")
            .when(
                (F.col("metric_direction") == "lower_is_better") == (F.col("mean_a") < F.col("mean_b")), F.col("method_a")
            )
            .otherwise(F.col("method_b")),
        }
    )


def wilcoxon_statistics(pairs: DataFrame, **blocks: int) -> DataFrame:
    """Signed-rank statistic per comparison, with what its p-value needs: n_nonzero, n_zero, tie_sum.

    Zero differences are dropped; ranks of |difference| are cumulated over distinct values.
    """
    rows = with_difference(pairs)
    nonzero = rows.where(F.col("diff") != 0).withColumn("value", F.abs("diff"))
    cells = nonzero.groupBy(*GROUP, "value").agg(
        F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down")
    )
    ranks = average_ranks(nonzero, GROUP, "value", **blocks)
    n = F.col("n").cast("double")
    sums = ranks.join(cells, [*GROUP, "value"]).groupBy(*GROUP).agg(
        F.sum(F.col("up") * F.col("average_rank")).alias("rank_sum_positive"),
        F.sum(F.col("down") * F.col("average_rank")).alias("rank_sum_negative"),
        F.sum("n").alias("n_nonzero"),
        F.sum(n * n * n - n).alias("tie_sum"),
    )
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("n_pairs"), F.max(F.abs("diff")).alias("__largest"))
    flat = F.col("__largest") <= 1e-8
    return sizes.join(sums, GROUP, "left").select(
        *GROUP,
        "n_pairs",
        F.when(F.col("n_pairs") < 2, None)
        .when(flat, 0.0)
        .otherwise(F.least("rank_sum_positive", "rank_sum_negative"))
        .alias("wilcoxon_statistic"),
        F.coalesce("n_nonzero", F.lit(0).cast("long")).alias("n_nonzero"),
        (F.col("n_pairs") - F.coalesce("n_nonzero", F.lit(0).cast("long"))).alias("n_zero"),
        F.coalesce("tie_sum", F.lit(0.0)).alias("tie_sum"),
        flat.alias("all_zero"),
    )


# ---- tail probabilities of single result rows -------------------------------------------------------------------
def student_t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if t is None or not math.isfinite(t) or df <= 0:
        return math.nan
    x = df / (df + t * t)
    return _incomplete_beta(df / 2.0, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    h = d
    for m in range(1, 500):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def wilcoxon_tail(stat: float, n: int, zeros: int, tie_sum: float, all_zero: bool) -> float:
    """Two-sided p-value: exact for at most 50 pairs without zeros and ties, else the tie-corrected normal tail."""
    if all_zero:
        return 1.0
    if stat is None or not math.isfinite(stat) or n < 1:
        return math.nan
    if n <= 50 and zeros == 0 and tie_sum == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return min(1.0, 2.0 * float(ways[: int(math.floor(stat)) + 1].sum()) / 2.0**n)
    mean = n * (n + 1) / 4.0
    spread = math.sqrt((n * (n + 1.0) * (2 * n + 1) - tie_sum / 2.0) / 24.0)
    return math.erfc(abs((stat - mean) / spread) / math.sqrt(2.0)) if spread > 0 else math.nan


def with_p_values(effects: DataFrame, signed_ranks: DataFrame) -> DataFrame:
    """Adds paired_t_p_value, wilcoxon_statistic, wilcoxon_p_value. One row per comparison, so Arrow rows are few."""

    @F.pandas_udf("double")
    def t_tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_t_tail(a, b - 1) if pd.notna(a) else None for a, b in zip(t, n)], dtype="float64")

    @F.pandas_udf("double")
    def w_tail(s: pd.Series, n: pd.Series, z: pd.Series, t: pd.Series, f: pd.Series) -> pd.Series:
        out = [wilcoxon_tail(a, int(b), int(c), d, bool(e)) if pd.notna(a) else None for a, b, c, d, e in zip(s, n, z, t, f)]
        return pd.Series(out, dtype="float64")

    ranks = signed_ranks.drop("n_pairs")
    joined = effects.join(ranks, GROUP, "left")
    exact = (F.col("n_nonzero") <= 50) & (F.col("n_zero") == 0) & (F.col("tie_sum") == 0)
    return joined.withColumns(
        {
            "paired_t_p_value": S.finite(t_tail("paired_t_statistic", "n_pairs")),
            "wilcoxon_p_value": S.finite(w_tail("wilcoxon_statistic", "n_nonzero", "n_zero", "tie_sum", "all_zero")),
            "wilcoxon_p_method": F.when(exact, "exact").otherwise("normal_approximation"),
        }
    ).drop("n_nonzero", "n_zero", "tie_sum", "all_zero")


# ---- bootstrap --------------------------------------------------------------------------------------------------
# Cumulative Poisson(1) probabilities.
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])


#: Row and replicate hashes are whole numbers below this prime.
PRIME = 2**31 - 1


def replicate_factors(iterations: int, seed: int) -> np.ndarray:
    """Factor and shift of each replicate, from the digits of a hash of seed and number."""
    digits = [hashlib.md5(f"{seed}|{r}".encode()).hexdigest() for r in range(iterations)]
    return np.array([(int(x[:8], 16) % PRIME, int(x[8:16], 16) % PRIME) for x in digits], np.uint64).reshape(-1, 2)


def _poisson_counts(row_hash: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Resampling counts (row, replicate). A replicate maps row hashes by a linear function modulo the prime, which makes the counts of
    any two rows independent, as the variance of a mean asks for; SQL can do the same."""
    spread = (row_hash.astype(np.uint64)[:, None] * factors[None, :, 0] + factors[None, :, 1]) % np.uint64(PRIME)
    return np.searchsorted(_POISSON, spread.astype(float) / PRIME, side="right")


def bootstrap_intervals(pairs: DataFrame, iterations: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean improvement per comparison.

    Each row gets a Poisson(1) count per replicate, so partial sums of all replicates are formed where the rows are
    and only (partition x group x replicate) sums are shuffled; no group is gathered.
    """
    key = F.concat_ws("|", *GROUP, "route_id")
    rows = with_difference(pairs).select(*GROUP, "improvement", (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % PRIME).alias("h"))
    factors = replicate_factors(iterations, seed)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for key, part in frame.groupby(GROUP, sort=False, dropna=False):
                n, s = totals.setdefault(key, (np.zeros(iterations), np.zeros(iterations)))
                x, h = part["improvement"].to_numpy(float), part["h"].to_numpy()
                for i in range(0, len(x), 512):
                    counts = _poisson_counts(h[i : i + 512], factors)
                    n += counts.sum(axis=0)
                    s += x[i : i + 512] @ counts
        for key, (n, s) in totals.items():
            yield pd.DataFrame(
                {**dict(zip(GROUP, key)), "replicate": np.arange(iterations), "n": n, "s": s}
            )

    sums = rows.mapInPandas(partial, "split string, comparison string, metric string, replicate long, n double, s double")
    means = sums.groupBy(*GROUP, "replicate").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"))
    named = {"bootstrap_ci_low": alpha / 2.0, "bootstrap_ci_high": 1.0 - alpha / 2.0}
    return quantiles(means, GROUP, named).drop("n")


def with_conclusions(tests: DataFrame, alpha: float = 0.05, iterations: int = 2000) -> DataFrame:
    """Adds significance flags, whether the interval excludes zero, and an interpretation sentence."""
    t_p, w_p, lo, hi = (F.col(c) for c in ("paired_t_p_value", "wilcoxon_p_value", "bootstrap_ci_low", "bootstrap_ci_high"))
    gain = F.col("mean_improvement")
    verb = F.when(gain > 0, "improves").when(gain < 0, "is worse than").otherwise("ties")
    verdict = F.when(t_p.isNull(), "unavailable").when(t_p < alpha, "significant").otherwise("not significant")
    no = F.lit(False)
    return tests.withColumns(
        {
            "bootstrap_iterations": F.lit(iterations).cast("long"),
            "alpha": F.lit(alpha),
            "paired_t_significant": F.coalesce(t_p < alpha, no),
            "wilcoxon_significant": F.coalesce(w_p < alpha, no),
            "bootstrap_ci_excludes_zero": F.coalesce(((lo > 0) & (hi > 0)) | ((lo < 0) & (hi < 0)), no),
            "interpretation": F.format_string(
                "%s %s %s on %s; paired t-test %s.", F.col("method_a"), verb, F.col("method_b"), F.col("metric"), verdict
            ),
        }
    )


def paired_tests(
    metrics: DataFrame, comparisons: Sequence[tuple[str, str]], names: Sequence[str] = ("all",), iterations: int = 2000,
    alpha: float = 0.05, seed: int = 42, pooled: bool = True,
) -> DataFrame:
    """The full test table per split and, with several splits, pooled over them."""
    chosen = select_metrics(metrics, names)
    pairs = paired_values(metrics, comparisons, chosen)
    intervals = bootstrap_intervals(pairs, iterations, alpha, seed)
    if pooled:
        together = paired_values(pooled_splits(metrics), comparisons, chosen)
        intervals = intervals.unionByName(bootstrap_intervals(together, iterations, alpha, seed + 1000))
        pairs = pairs.unionByName(together)
    tested = with_p_values(paired_effects(pairs), wilcoxon_statistics(pairs))
    out = with_conclusions(tested.join(intervals, GROUP, "left"), alpha, iterations)
    return out.drop("__sd", "__largest")


COMPARISON_COLUMNS = (
    "split",
    "comparison",
    "method_a",
    "method_b",
    "metric",
    "metric_direction",
    "n_pairs",
    "mean_a",
    "mean_b",
    "mean_improvement",
    "percent_improvement_vs_b",
    "paired_t_p_value",
    "wilcoxon_p_value",
    "cohens_dz_improvement",
    "preferred_method_by_mean",
    "interpretation",
)


def comparison_summary(tests: DataFrame) -> DataFrame:
    return tests.select(*[c for c in COMPARISON_COLUMNS if c in tests.columns])
