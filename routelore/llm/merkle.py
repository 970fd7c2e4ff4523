"""Merkle manifest of a dataset: a tree per source over its documents, and one tree over the sources' roots.

Hashes are lower-case hex SHA-256 of concatenated inputs, digests as hex text. Nodes of a tree stand in aligned blocks of ``ARITY`` to
the power ``DEPTH``; a block keeps each of its levels as one string of digests end to end. A parent is the hash of a substring of fixed
width, a node's siblings are the substrings beside it, and the blocks' last digests are the nodes of the next round, until one is
left. A run never crosses a block, so blocks are independent tasks, however many documents one source holds. Proofs are then
handed down from the top, to at most a block of nodes each, so no join meets a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from routelore.llm.shared import numbered
from routelore.sources.staging import stage_table

ARITY, DEPTH = 3, 4
#: Hex digits of a digest.
WIDTH = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of a record's fields: each ``-`` if null, else its length in UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def levels(count: str) -> list[tuple[str, str]]:
    """Names and SQL of a block's levels above the first; null where ``count`` nodes have come down to one before."""
    step, out = ARITY * WIDTH, []
    for j in range(DEPTH):
        parents = f"transform(sequence(0, (length(level{j}) + {step - 1}) DIV {step} - 1), i -> sha2(substring(level{j}, CAST(i * {step} + 1 AS INT), {step}), 256))"
        out.append((f"level{j + 1}", f"CASE WHEN {count} > {ARITY**j} THEN array_join({parents}, '') END"))
    return out


def segments() -> Column:
    """For the node at ``place`` of a block: per level its siblings, as the digests before and after it in its run."""
    parts = []
    for j in range(DEPTH):
        at, own = f"(place DIV {ARITY**j})", f"(place DIV {ARITY**j} % {ARITY})"
        before = f"substring(level{j}, CAST(({at} - {own}) * {WIDTH} + 1 AS INT), CAST({own} * {WIDTH} AS INT))"
        after = f"substring(level{j}, CAST(({at} + 1) * {WIDTH} + 1 AS INT), CAST(({ARITY - 1} - {own}) * {WIDTH} AS INT))"
        parts.append(f"CASE WHEN level{j + 1} IS NOT NULL THEN struct({before} AS before, {after} AS after) END")
    return F.expr(f"filter(array({', '.join(parts)}), s -> s IS NOT NULL)")


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """tree, block, count, its levels, ``own`` (place, digest and carried columns of its nodes) and ``top``, its last digest.

    ``nodes`` has tree, place (from 0 in the tree), count (the tree's nodes), digest and the carried columns."""
    size = ARITY**DEPTH
    own = F.struct((F.col("place") % size).alias("place"), "digest", *carried)
    out = nodes.groupBy("tree", F.expr(f"place DIV {size}").alias("block")).agg(F.max("count").alias("count"), F.sort_array(F.collect_list(own)).alias("own"))
    out = out.withColumn("level0", F.array_join("own.digest", ""))
    for name, sql in levels("count"):
        out = out.withColumn(name, F.expr(sql))
    return out.withColumn("top", F.coalesce(*[F.col(f"level{j}") for j in range(DEPTH, -1, -1)]))


def climb(nodes: DataFrame, carried: list[str], name: str) -> list[DataFrame]:
    """The blocks of every round, staged; a tree is finished in the round where it has one block."""
    rounds = []
    while True:
        rounds.append(stage_table(blocks(nodes, carried if not rounds else []), name))
        nodes = rounds[-1].where(f"count > {ARITY**DEPTH}").select("tree", F.col("block").alias("place"), F.expr(f"(count + {ARITY**DEPTH - 1}) DIV {ARITY**DEPTH}").alias("count"), F.col("top").alias("digest"))
        if not nodes.take(1):
            return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """tree and root of every tree."""
    out = None
    for r in rounds:
        done = r.where(f"count <= {ARITY**DEPTH}").select("tree", F.col("top").alias("root"))
        out = done if out is None else out.unionAll(done)
    return out


def descend(rounds: list[DataFrame], above: DataFrame, carried: list[str], name: str) -> DataFrame:
    """tree, the carried columns of the first round's nodes, digest, path: siblings per level up to the tree's root and on along
    ``above`` (tree, root path above it, and any further columns, which are handed down too)."""
    further = [c for c in above.columns if c not in ("tree", "path")]
    upper = None
    for k in range(len(rounds) - 1, -1, -1):
        here = rounds[k]
        top = here.where(f"count <= {ARITY**DEPTH}").select("tree", F.col("block")).join(above, "tree").select("tree", "block", F.col("path").alias("up"), *further)
        upper = top if upper is None else top.unionAll(upper.select("tree", F.col("place").alias("block"), F.col("path").alias("up"), *further))
        keep = ["place", "digest", *(carried if k == 0 else [])]
        met = here.join(upper, ["tree", "block"])
        nodes = met.select("tree", "block", *[f"level{j}" for j in range(DEPTH + 1)], "up", *further, F.explode("own").alias("node"))
        nodes = nodes.select("*", *[F.col(f"node.{c}").alias(c) for c in keep])
        path = F.concat(segments(), F.col("up"))
        nodes = nodes.select("tree", (F.col("block") * ARITY**DEPTH + F.col("place")).alias("place"), path.alias("path"), *[c for c in keep if c != "place"], *further)
        upper = stage_table(nodes, name) if k else nodes
    return upper


def manifest(docs: DataFrame, changed: Column | None = None, new_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path (siblings before and after, from the leaf up), proof_sha256,
    folded_root and verified. The two roots are those of the document's source and of all sources.

    Where ``changed`` holds, the tree is checked against the record with ``new_text`` in place of its text.
    Sources are ordered by their UTF-8 bytes, null first, which is a source of its own; documents of a source by doc_id, null first, and
    those that share an id by their leaf, so repeated rows are leaves of their own. Null and empty texts have different leaves. Texts of
    any length are hashed whole. Only the five fields count: further columns, whatever their names, neither enter the hash nor the
    result. A lone document is its source's root and a lone source's root is the root: nothing is hashed then, and an empty list of
    siblings has the proof of the empty string. An empty table gives an empty table.
    """
    fields = [F.col(f) for f in FIELDS]
    leaf = leaf_hash(fields)
    other = F.lit(None).cast("string") if changed is None else F.when(F.coalesce(changed, F.lit(False)), leaf_hash([*fields[:-1], new_text]))
    tree = F.coalesce(F.concat(F.lit(":"), "source"), F.lit(""))
    own = docs.select("doc_id", tree.alias("tree"), leaf.alias("digest"), other.alias("other"))
    # Equal digests mean equal records, whose other leaves are equal too: ties in this order change nothing but which is which.
    own = stage_table(own.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = numbered(own, ["tree"], ["doc_id", "digest", "row"], "place", "count")
    carried = ["doc_id", "other"]
    lower = climb(placed, carried, "blocks")

    subroots = stage_table(roots(lower), "subroots")
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), ["tree"], ["source"], "place", "count")
    upper = climb(sources, ["source"], "source_blocks")
    above = roots(upper).select("tree", "root", F.expr("CAST(array() AS array<struct<before: string, after: string>>)").alias("path"))
    tops = descend(upper, above, ["source"], "source_paths").select(F.col("source").alias("tree"), "path", "root", F.col("digest").alias("subroot"))

    found = descend(lower, stage_table(tops, "source_paths"), carried, "paths")
    folded = F.aggregate("path", F.coalesce("other", "digest"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
