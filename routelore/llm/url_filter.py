"""URL filter with empirical-Bayes host reputation.

Labelled pages are good or bad outcomes. Counts are summed up a tree: host, registered domain (the last two labels), suffix (the
last label), all. From the top down, the mean of a node is shrunk toward its parent's: a beta prior whose mean is the parent's
posterior mean without the node's own outcomes (so none counts twice), and whose strength is estimated per level by the method of
moments over all nodes of that level. A host is blocked if the lower bound of its posterior bad share lies above a limit.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from routelore.llm.shared import ascii_lower, salted_join
from routelore.sources.staging import stage_table

#: Fixed values: (verdict, host, start of the path) of the stated rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Prior of all pages, strengths of the levels when moments give none, posterior standard deviations, and the limit.
PRIOR_BAD, PRIOR_GOOD = 1.0, 9.0
WEAKEST, STRONGEST = 2.0, 200.0
DEVIATIONS, LIMIT = 1.28, 0.15
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a url without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path start) and verdict of the longest rule that fits, or nulls. A rule holds for its host and subdomains;
    of equally long ones the first of ``rules`` wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def reputation(outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """host, pages, bad, mean, bound from rows (host, bad) with bad 0, 1 or null (no label).

    Every host that occurs gets a row, also those without a label; these have their parent's posterior mean, and a wide bound.
    """
    last = lambda n: F.substring_index("host", ".", -n)
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("pages"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = stage_table(hosts.select("host", last(2).alias("domain"), last(1).alias("suffix"), "pages", "bad"), "host_outcomes")
    # What a node inherits: its parent's counts, strength and prior mean. The top is one row.
    inherits = ["up_pages", "up_bad", "up_strength", "up_mean"]
    above = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0.0)).alias("up_pages"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("up_bad"))
    above = above.withColumns({"up_strength": F.lit(PRIOR_BAD + PRIOR_GOOD), "up_mean": F.lit(PRIOR_BAD / (PRIOR_BAD + PRIOR_GOOD))})
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = hosts.groupBy(*keys).agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))
        nodes = nodes.join(F.broadcast(above)) if depth == 0 else salted_join(nodes, above, keys[:-1], [level], how="inner")
        rest = (F.col("up_bad") - F.col("bad") + F.col("up_strength") * F.col("up_mean")) / (F.col("up_pages") - F.col("pages") + F.col("up_strength"))
        nodes = stage_table(nodes.withColumn("parent", rest).drop(*inherits), f"{level}_nodes")
        # Spread of the nodes' shares around their parents beyond that of the binomial gives the prior's strength.
        p, n = F.col("parent"), F.col("pages")
        square = F.pow(F.col("bad") - n * p, 2)
        moments = nodes.agg(F.sum(square - n * p * (1 - p)).alias("extra"), F.sum(n * (n - 1) * p * (1 - p)).alias("scale"))
        raw = F.col("scale") / F.col("extra") - 1
        strength = F.when(F.col("extra") > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), raw))).otherwise(F.lit(STRONGEST))
        nodes = nodes.join(F.broadcast(moments.select(F.round(F.coalesce(strength, F.lit(STRONGEST)), 6).alias("strength"))))  # one row
        nodes = nodes.withColumn("mean", (F.col("bad") + F.col("strength") * p) / (n + F.col("strength")))
        above = nodes.select(*keys, *[F.col(c).alias(n) for c, n in zip(("pages", "bad", "strength", "parent"), inherits)])
    bound = F.col("mean") - deviations * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("pages") + F.col("strength") + 1))
    return nodes.select("host", "pages", "bad", "mean", bound.alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, deviations: float = DEVIATIONS, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled pages and bound of every page's host.

    The outcome of a page is the label of the document whose number its path carries (``/xx/<number>``): bad if its quality is 0
    or it is toxic. Labels that repeat count as bad if any is. A null or unusable url has empty host and path and is judged by the
    reputation of the empty host. Repeated pages stay and count each. Other columns are left out. Empty tables give empty tables.
    """
    url = F.col("url")
    host, path = url_parts(url)
    number = F.regexp_extract("path", r"^/[a-z][a-z]/([0-9]{1,18})", 1)
    own = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("number", F.when(number != "", number.cast("long")))
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("number")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    own = stage_table(salted_join(own, bad, ["number"], ["page_id", "path"], salts=4), "page_outcomes")
    known = salted_join(own, reputation(own.select("host", "bad"), deviations), ["host"], ["page_id", "path"])
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return known.select("page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "pages", F.round("bound", 9).alias("bound"))
