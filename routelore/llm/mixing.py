"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking multiplies the cell weights in turn so that their sums over
sources, languages and topics meet the target shares, no cell being asked for more than it has. A document is then taken with its cell's probability, by a hash of its id.
DataFrame and SQL functions only. The cell table is never collected: every update is an aggregation joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from routelore.llm.shared import SPACES, salted_join
from routelore.sources.staging import stage_table

KEYS = ("source", "lang", "topic")
#: Target share of a value: its share of the tokens to this power, scaled to 1. Below 1 lifts what is rare.
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.8}
#: Topic name and the SQL condition (Spark and DuckDB read it alike); the first that holds, else ``other``.
TOPICS = (
    ("table", "contains(text, '|')"),
    ("notice", "contains(text, 'License')"),
    ("contact", "contains(text, '@')"),
    ("markup", "contains(text, '###')"),
    ("article", "length(text) >= 2000"),
)
TOPIC_SQL = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in TOPICS) + " ELSE 'other' END"
SWEEPS, FRACTION = 6, 0.5
#: Rounds in which targets above what a value has are cut to it.
FILLS = 2


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id's MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def with_cells(docs: DataFrame, topic: str = TOPIC_SQL) -> DataFrame:
    """Adds __source, __lang, __topic and __tokens (words); null source or language counts as the empty string, null text as none."""
    return docs.withColumns({
        "__source": F.coalesce("source", F.lit("")),
        "__lang": F.coalesce("lang", F.lit("")),
        "__topic": F.expr(topic),
        "__tokens": F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long"),
    })


def raked(cells: DataFrame, powers: dict[str, float] = POWERS, sweeps: int = SWEEPS, fraction: float = FRACTION) -> DataFrame:
    """Adds weight (sum 1 where tokens allow) and ``most``, the weight at which a cell is taken whole, to cells of KEYS and tokens.

    No cell gets more than ``most``: an update that raises a marginal raises the cells below their bound, one that lowers it lowers all.
    Targets that ask for more than a value has are cut to it and the others raised in proportion. Cells without tokens have weight 0.
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))  # one row
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), "total"), F.lit(0.0))
    cells = cells.join(F.broadcast(total)).withColumns({"weight": share, "most": share / fraction}).drop("total")
    cells = stage_table(cells, "cells")
    targets = {k: marginal_targets(cells, k, powers[k]) for k in KEYS}
    for _ in range(sweeps):
        for k in KEYS:
            full = F.col("weight") >= F.col("most") * (1 - 1e-12)
            now = cells.groupBy(k).agg(F.sum("weight").alias("now"), F.sum(F.when(full, F.col("weight")).otherwise(0.0)).alias("held"))
            raised = F.when((F.col("target") > F.col("now")) & (F.col("now") > F.col("held")), (F.col("target") - F.col("held")) / (F.col("now") - F.col("held"))).otherwise(1.0)
            lowered = F.coalesce(F.try_divide("target", "now"), F.lit(0.0))
            ratio = now.join(targets[k], k).select(k, F.when(F.col("target") > F.col("now"), raised).otherwise(lowered).alias("ratio"))
            met = salted_join(cells, ratio, [k], list(KEYS), salts=4, how="inner")
            weight = F.when(full & (F.col("ratio") > 1), F.col("weight")).otherwise(F.least(F.col("weight") * F.col("ratio"), "most"))
            cells = stage_table(met.select(*KEYS, "tokens", "most", weight.alias("weight")), "raked")
    return cells


def marginal_targets(cells: DataFrame, k: str, power: float) -> DataFrame:
    """The key's values with target: their share of the tokens to the power, scaled to 1, and none above ``most``."""
    own = cells.groupBy(k).agg(F.pow(F.sum("weight"), power).alias("part"), F.sum("most").alias("most"))
    whole = own.agg(F.sum("part").alias("whole"))  # one row
    own = own.join(F.broadcast(whole)).select(k, F.coalesce(F.try_divide("part", "whole"), F.lit(0.0)).alias("target"), "most")
    for _ in range(FILLS):
        own = stage_table(own, f"{k}_targets")
        sums = own.agg(F.sum(F.when(F.col("target") >= F.col("most"), F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(F.col("target") < F.col("most"), F.col("target")).otherwise(0.0)).alias("free"))  # one row
        scaled = F.col("target") * F.coalesce(F.try_divide(1 - F.col("held"), "free"), F.lit(0.0))
        own = own.join(F.broadcast(sums)).select(k, F.when(F.col("target") >= F.col("most"), F.col("most")).otherwise(scaled).alias("target"), "most")
    return stage_table(own.select(k, F.least("target", "most").alias("target")), f"{k}_targets")


def marginals(cells: DataFrame, powers: dict[str, float] = POWERS) -> DataFrame:
    """marginal, value, target and reached (its share of the sample's expected tokens) of raked cells."""
    out = None
    for k in KEYS:
        share = cells.groupBy(k).agg(F.sum("weight").alias("reached")).join(marginal_targets(base_weights(cells), k, powers[k]), k)
        share = share.select(F.lit(k).alias("marginal"), F.col(k).alias("value"), "target", "reached")
        out = share if out is None else out.unionAll(share)
    return out


def base_weights(cells: DataFrame) -> DataFrame:
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))  # one row
    return cells.join(F.broadcast(total)).withColumn("weight", F.coalesce(F.try_divide(F.col("tokens").cast("double"), "total"), F.lit(0.0)))


def calibrated(docs: DataFrame, topic: str = TOPIC_SQL, fraction: float = FRACTION, powers: dict[str, float] = POWERS, sweeps: int = SWEEPS) -> DataFrame:
    """All columns of ``docs`` with __topic, __tokens, __probability and __sampled.

    The expected tokens of the sample are ``fraction`` of all, dealt over cells by the raked weights, and nothing is repeated: no
    cell's weight is more than it has, and the marginals are met by the others as far as their tokens allow (``marginals`` says how far). Documents without a word belong to no weight and have probability 1 if their
    cell has no tokens at all. Repeated rows share their id's fate. An empty table gives an empty table.
    """
    marked = with_cells(docs, topic)
    cells = marked.groupBy(*[F.col(f"__{k}").alias(k) for k in KEYS]).agg(F.sum("__tokens").alias("tokens"))
    cells = raked(cells, powers, sweeps, fraction)
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("most"))).otherwise(1.0)
    chances = cells.select(*[F.col(k).alias(f"__{k}") for k in KEYS], chance.alias("__probability"))
    chances = stage_table(chances, "chances")
    known = salted_join(marked, chances, [f"__{k}" for k in KEYS], ["doc_id"])
    return known.withColumn("__sampled", uniform(F.col("doc_id")) < F.col("__probability"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The chosen documents, with the columns they came with."""
    return calibrated(docs, **options).where("__sampled").select(*docs.columns)
