"""Exact order statistics, ranks, correlations and histograms.

All order statistics come from one shape: values are first counted per (group, value), then cumulated with
``ordering.running_totals``, so no group is gathered into one task or one aggregation buffer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from routelore.functions import scalars as S
from routelore.operators.ordering import attach_single_row, null_safe_join, running_totals
from routelore.sources.staging import stage_table


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "feature") -> DataFrame:
    """One row per (row, column) with the column's name and its finite value as ``value`` (null when missing)."""
    pairs = [F.struct(F.lit(c).alias(name), S.finite(S.to_number(F.col(c))).alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__p")).select(*keep, f"__p.{name}", "__p.value")


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Non-null values of each group with the number of rows holding them."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def quantiles(
    df: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float], value: str = "value", **blocks: int
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, one column per named probability, plus ``n``."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, probabilities, value, **blocks)


def quantiles_of_counts(
    counted: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float], value: str = "value", **blocks: int
) -> DataFrame:
    """``quantiles`` of values that are already counted: one row per (group, value) with its number ``n``."""
    keys = list(keys)
    cells = running_totals(counted, keys, value, ["n"], **blocks)
    before = F.col("cum_n") - F.col("n")
    outs: list[Column] = []
    edges: list[Column] = []
    wanted = None
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * (F.col("all_n") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        holds_low = (before <= low) & (low < F.col("cum_n"))
        holds_high = (before <= high) & (high < F.col("cum_n"))
        edges.append(F.max(F.when(holds_low, F.col(value))).alias(f"__lo_{name}"))
        edges.append(F.max(F.when(holds_high, F.col(value))).alias(f"__hi_{name}"))
        wanted = (holds_low | holds_high) if wanted is None else (wanted | holds_low | holds_high)
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return cells.where(wanted).groupBy(*keys).agg(F.max("all_n").alias("n"), *edges).select(*keys, "n", *outs)


def medians(df: DataFrame, columns: Sequence[str], sample_rows: int = 50_000) -> dict[str, float | None]:
    """Exact median of each numeric column over its non-null values (None without any), read on the driver: a number for each column.

    Two values around the middle are taken from a sample; how many values lie below each, counted over all rows, tells where the middle ranks are. Only
    values strictly between them are listed, so rows are not multiplied by columns. A column whose middle lies outside is listed whole.
    """
    columns = list(columns)
    named = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = named.count()
    sample = named.sample(sample_rows / rows, 42) if rows > sample_rows else named
    around = sample.agg(*[F.percentile_approx(c, [0.485, 0.515], 10_000).alias(c) for c in named.columns]).first()
    counts = []
    for c in named.columns:
        low, high = around[c] or (None, None)
        counts.append(F.count(c).alias(f"n_{c}"))
        for side, edge in (("low", low), ("high", high)):
            if edge is not None and (side == "low" or low != high):
                counts += [F.count_if(F.col(c) < edge).alias(f"below_{side}_{c}"), F.count_if(F.col(c) <= edge).alias(f"upto_{side}_{c}")]
    at = named.agg(*counts).first().asDict()
    found: dict[tuple[str, int], float] = {}
    listed: dict[str, tuple[Column, int]] = {}  # condition of the rows to list, and how many rows come before them
    for c in named.columns:
        low, high = around[c] or (None, None)
        n, below_high = at[f"n_{c}"], at.get(f"below_high_{c}")
        for place, rank in enumerate([(n - 1) // 2, n // 2] if n else []):
            if low is not None and at[f"below_low_{c}"] <= rank < at[f"upto_low_{c}"]:
                found[c, place] = low
            elif below_high is not None and below_high <= rank < at[f"upto_high_{c}"]:
                found[c, place] = high
            elif below_high is not None and at[f"upto_low_{c}"] <= rank < below_high:
                listed.setdefault(c, ((F.col(c) > low) & (F.col(c) < high), at[f"upto_low_{c}"]))
            else:
                listed[c] = (F.col(c).isNotNull(), 0)
    if listed:
        cells = [F.when(keep, F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, (keep, _) in listed.items()]
        tall = named.select(F.explode(F.array_compact(F.array(*cells))).alias("p")).select("p.*")
        ranked = running_totals(stage_table(value_counts(tall, ["column"]), "middle_values"), ["column"], "value", ["n"])
        wanted = [(c, place, (at[f"n_{c}"] - 1 + place) // 2 - before) for c, (_, before) in listed.items() for place in (0, 1)]
        asked = df.sparkSession.createDataFrame(wanted, "column string, place int, rank long")
        holds = (F.col("cum_n") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("cum_n"))
        for r in ranked.join(asked, "column").where(holds).select("column", "place", "value").collect():  # two rows a column at most
            found[r["column"], r["place"]] = r["value"]
    middles = [(found.get((c, 0)), found.get((c, 1))) for c in named.columns]
    return {c: None if lo is None else lo + (hi - lo) * 0.5 for c, (lo, hi) in zip(columns, middles)}


def moments(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """count, mean, std (n-1), min and max of a value per group."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def summary(
    df: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float], value: str = "value", **blocks: int
) -> DataFrame:
    """Moments and quantiles side by side, one row per group (groups without any value keep count 0)."""
    keys = list(keys)
    q = quantiles(df, keys, probabilities, value, **blocks).drop("n")
    return null_safe_join(moments(df, keys, value), q, keys, "left")


def describe(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float] | None = None) -> DataFrame:
    """Long describe table: ``statistic`` x one column per input column."""
    probabilities = dict(probabilities or {"25%": 0.25, "50%": 0.50, "75%": 0.75})
    renamed = {f"q{i}": p for i, p in enumerate(probabilities.values())}
    stats = summary(long_form(df, [], columns), ["feature"], renamed)
    names = ["count", "mean", "std", "min", *renamed, "max"]
    labels = ["count", "mean", "std", "min", *probabilities, "max"]
    pairs = [F.struct(F.lit(l).alias("statistic"), F.col(n).cast("double").alias("v")) for l, n in zip(labels, names)]
    tall = stats.select("feature", F.explode(F.array(*pairs)).alias("p")).select("feature", "p.*")
    picked = [F.max(F.when(F.col("feature") == c, F.col("v"))).alias(c) for c in columns]
    return tall.groupBy("statistic").agg(*picked)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str = "value", **blocks: int) -> DataFrame:
    """One row per (group, value): its number of rows and the average 1-based rank of those rows."""
    cells = running_totals(value_counts(df, keys, value), list(keys), value, ["n"], **blocks)
    return cells.select(
        *keys, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("average_rank"), "all_n"
    )


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson and Spearman correlation of column pairs, over rows where both are present; null below 3 rows.

    Cells are keyed by the pair's number, and ranks meet cells by sorting: a pair may have as many ranks as rows, so none are broadcast.
    """
    pairs = list(pairs)
    numbers = {c: f"__c{i}" for i, c in enumerate(dict.fromkeys(c for pair in pairs for c in pair))}
    cleaned = df.select(*[S.finite(S.to_number(F.col(c))).alias(n) for c, n in numbers.items()])
    both = [F.struct(F.lit(i).alias("pair"), F.col(numbers[x]).alias("x"), F.col(numbers[y]).alias("y")) for i, (x, y) in enumerate(pairs)]
    tall = (
        cleaned.select(F.explode(F.array(*both)).alias("p"))
        .select("p.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y")
        .agg(F.count("*").alias("w"))
    )

    def ranks(side: str) -> DataFrame:
        cells = tall.groupBy("pair", side).agg(F.sum("w").alias("n"))
        cum = running_totals(cells, ["pair"], side, ["n"])
        return cum.select("pair", side, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"r{side}")).hint("merge")

    ranked = tall.join(ranks("x"), ["pair", "x"]).join(ranks("y"), ["pair", "y"])
    w = F.col("w").cast("double")
    middles = ranked.groupBy("pair").agg(
        F.sum("w").alias("n"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in ("x", "y", "rx", "ry")]
    )
    sums = null_safe_join(ranked, middles, ["pair"], "inner").groupBy("pair").agg(
        F.first("n").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"),
        F.first("mrx").alias("mrx"), F.first("mry").alias("mry"), *_centred_sums("x", "y"), *_centred_sums("rx", "ry"),
    )
    side = lambda k: F.element_at(F.array(*[F.lit(pair[k]) for pair in pairs]), F.col("pair") + 1)
    return sums.select(
        side(0).alias("x_name"),
        side(1).alias("y_name"),
        "n",
        F.when(F.col("n") >= 3, _centred_corr("x", "y")).alias("pearson"),
        F.when(F.col("n") >= 3, _centred_corr("rx", "ry")).alias("spearman"),
    )


def _centred_sums(x: str, y: str) -> list[Column]:
    w, dx, dy = F.col("w").cast("double"), F.col(x) - F.col(f"m{x}"), F.col(y) - F.col(f"m{y}")
    return [
        F.sum(w * dx).alias(f"s{x}"), F.sum(w * dy).alias(f"s{y}"), F.sum(w * dx * dx).alias(f"{x}{x}"),
        F.sum(w * dy * dy).alias(f"{y}{y}"), F.sum(w * dx * dy).alias(f"{x}{y}"),
    ]


def _centred_corr(x: str, y: str) -> Column:
    """Correlation from sums around the means; what is left of the sums themselves takes out the means' rounding."""
    n = F.col("n").cast("double")
    vx = F.col(f"{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / n
    vy = F.col(f"{y}{y}") - F.col(f"s{y}") * F.col(f"s{y}") / n
    # Deviations at the rounding of the mean belong to a constant column: its correlation is undefined.
    spread = lambda v, m: v > n * F.pow(1e-14 * F.abs(F.col(f"m{m}")), 2)
    return F.when(spread(vx, x) & spread(vy, y), (F.col(f"{x}{y}") - F.col(f"s{x}") * F.col(f"s{y}") / n) / F.sqrt(vx) / F.sqrt(vy))


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted sample skewness; null below 3 values or for a constant column."""
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def equal_width_bins(df: DataFrame, column: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Adds 1-based right-closed equal-width bin numbers over the observed range, with ``bin_low``/``bin_high``."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.ceil(F.try_divide(F.col(column) - F.col("__lo"), width))
    number = F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(at, F.lit(1)))).cast("long")
    joined = attach_single_row(df, bounds)
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), number)).select(
        *df.columns,
        out,
        (F.col("__lo") + (F.col(out) - 1) * width).alias(f"{out}_low"),
        (F.col("__lo") + F.col(out) * width).alias(f"{out}_high"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts per left-closed equal-width bin (the last bin is closed); empty bins are listed with 0."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.floor(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    number = F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0))).cast("long")
    counted = (
        attach_single_row(df.where(F.col(column).isNotNull()).select(column), bounds)
        .groupBy(number.alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    every = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, q1, median, q3 and max of a value per group."""
    named = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(df, keys, named, value)


def counts_with_share(df: DataFrame, column: str) -> DataFrame:
    """Value counts of a column with percent of all rows. The window runs over the distinct values only."""
    counted = df.groupBy(column).agg(F.count("*").alias("count"))
    total = counted.agg(F.sum("count").alias("__t"))
    return attach_single_row(counted, total).select(
        column, "count", S.percent_of(F.col("count"), F.col("__t")).alias("percentage")
    )


def fixed_bins(c: Column, edges: Sequence[float], labels: Sequence[str], missing: str = "Missing") -> Column:
    """Label of the right-closed bin that holds the value; the last label takes everything above the last edge."""
    out = F.when(c.isNull(), missing)
    for edge, label in zip(edges, labels):
        out = out.when(c <= edge, label)
    return out.otherwise(labels[-1])


def category_order(c: Column, domain: Sequence[str]) -> Column:
    """Sort key of a listed category; unlisted ones come last."""
    out = F.when(c == domain[0], 0)
    for i, d in enumerate(domain[1:], start=1):
        out = out.when(c == d, i)
    return out.otherwise(len(domain))
