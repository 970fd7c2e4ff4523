"""Near-duplicate detection by SimHash with deletion-variant signatures.

A fingerprint has 64 bits, and two link at ``BITS`` = 3 or fewer differing bits. Cut into two halves, one half of a linked pair
differs by one bit at most. So each distinct fingerprint is indexed under the 32 variants of each half that leave out one bit:
linked fingerprints share a variant, equal variants meet by an equality shuffle, and the whole fingerprints are compared there.
Variants shared by very many fingerprints are cut once more, by the bytes of the other half, one of which must be equal.
A bucket gives a spanning forest of its links, never its pairs; components follow by alternating large and small stars.

That binds copies of similarity near 1 only; ``similar`` links by the similarity itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from routelore.llm.shared import LOWER, UPPER, salted_join
from routelore.sources.staging import stage_table

BITS = 3
#: Buckets of more fingerprints than this are cut further. No bucket is dropped.
HOT = 4096
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> list[int]:
    """A hash of each word shingle; one of all words if they are fewer, none without words."""
    from xxhash import xxh64_intdigest as digest

    own = (text or "").encode().translate(LOWERED).split()  # splits at exactly the six white-space bytes
    if not own:
        return []
    shingles = zip(*(own[k:] for k in range(words))) if len(own) >= words else [own]
    return [digest(b" ".join(s), seed) for s in shingles]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles, as a signed 64-bit number; 0 without words."""
    hashes = np.array(shingle_hashes(text, words, seed), dtype=">u8")
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp of every row. A null text has no words; other columns are left out."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), words) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hashed, schema)


def forest(fps: np.ndarray, block: int = 1024) -> np.ndarray:
    """For each fingerprint of a bucket the place of the smallest one that links reach within the bucket."""
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        for lo in range(0, len(fps), block):
            near = np.bitwise_count(fps[lo : lo + block, None] ^ fps[None, :]) <= BITS
            new[lo : lo + block] = np.where(near, label[None, :], len(fps)).min(axis=1)
        np.minimum.at(new, label, new.copy())  # what a member found, its root learns
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def bucket_links(variants: DataFrame) -> DataFrame:
    """Links (u, v) that join all fingerprints linked within a bucket of equal keys; at most one per row."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            twos = starts[sizes == 2]
            near = np.bitwise_count((fps[twos] ^ fps[twos + 1]).view(np.uint64)) <= BITS
            us, vs = [fps[twos + 1][near]], [fps[twos][near]]
            for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                own = fps[at : at + n]
                root = forest(own.view(np.uint64))
                moved = root != np.arange(n)
                us.append(own[moved])
                vs.append(own[root[moved]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for b in batches:  # sorted by key, so only the last key may go on in the next batch
            keys = np.concatenate([keys, b.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column("fp").to_numpy(zero_copy_only=False)])
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                yield found(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield found(keys, fps)

    return variants.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link, "u long, v long").where("u <> v")


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links between distinct fingerprints (column fp, no repeats)."""
    half = F.expr("CASE WHEN k < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    key = F.expr("shiftleft(CAST(k AS BIGINT), 32) | (half & ~shiftleft(1L, k % 32))")
    variants = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).withColumn("half", half).select("fp", key.alias("key"))
    # A bucket holds fingerprints of two values of its half: it can only be large if one of the values is common.
    halves = distinct.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.expr("shiftrightunsigned(fp, 32)").alias("half")), F.struct(F.lit(32).alias("s"), F.expr("fp & 4294967295L").alias("half")))).alias("h")).select("h.*")
    common = halves.groupBy("s", "half").agg(F.count("*").alias("n")).where(F.col("n") > hot // 2)
    common = stage_table(common.select("half", F.explode(F.sequence(F.col("s"), F.col("s") + 31)).alias("k")).select(key.alias("key")).distinct(), "common_variants")
    if not common.take(1):
        return bucket_links(variants)
    plain = bucket_links(variants.join(common, "key", "left_anti"))
    other = F.expr("CASE WHEN shiftrightunsigned(key, 32) < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    part = F.expr("shiftleft(key, 10) | shiftleft(CAST(b AS BIGINT), 8) | (shiftrightunsigned(other, 8 * b) & 255L)")
    finer = variants.join(common, "key", "left_semi").withColumn("other", other).select("fp", "key", "other", F.explode(F.array(*map(F.lit, range(4)))).alias("b"))
    return plain.unionAll(bucket_links(finer.select("fp", part.alias("key"))))


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) for each node that is not itself its root, the smallest node."""

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    edges = stage_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).select("u", F.least("u", "m").alias("m"))
        edges = stage_table(salted_join(both.where("v > u"), low, ["u"], ["v"], how="inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_stars")
        near = salted_join(edges, lowest(edges), ["u"], ["v"], how="inner")
        moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(near.select("u", F.col("m").alias("v")))
        edges = stage_table(moved.distinct(), "small_stars")
        before, state = state, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components have not settled")


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts, and texts of white space, have fingerprint 0 and link like any other. Equal texts share a fingerprint.
    A null doc_id is never the smallest unless all of its component are null. An empty table gives an empty table.
    """
    own = stage_table(fingerprints(docs, words), "fingerprints")
    distinct = stage_table(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    root = stars(links(distinct))
    placed = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = salted_join(placed, smallest, ["root"], ["fp"], how="inner").select("fp", "component_id")
    return salted_join(own, named, ["fp"], ["doc_id"])
