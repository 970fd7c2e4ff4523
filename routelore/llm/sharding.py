"""Two-pass external shuffle of a corpus into shards of equal numbers of rows.

The first pass scatters the records over buckets that fit in memory, by a seeded hash. The second shuffles each bucket by Fisher-Yates and
writes it. The buckets end to end are the shuffled corpus, which is cut into shards, so a record's place is its bucket's first place
and its place in the bucket. Records travel once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from routelore.sources.staging import scratch_folder, stage_table

SHARDS, SEED = 24, 13
#: Bytes of texts of a bucket, about: what a task holds in memory.
BUCKET_BYTES = 32 << 20
#: Bytes counted for a record beside its text.
RECORD_BYTES = 8
#: An id with more than this part of all rows is hot; there are fewer than its inverse.
HOT_SHARE = 1 / 1000


def record_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """Which record comes to each place: numpy's permutation draws one place for each, from the last down."""
    return np.random.default_rng([seed, bucket]).permutation(n)


def scattered(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The documents with __bucket and __key (which orders a bucket's records), and the number of rows.

    The hash is of all columns, so another layout of the files gives the same buckets. Only rows of hot ids add their number in a
    staged copy: as they may all be equal, nothing else could scatter them.
    """
    rows, size = docs.agg(F.count("*"), F.sum(record_size())).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    hot = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max(1, int(rows * HOT_SHARE))).select("doc_id").collect()
    number = F.lit(None).cast("long")
    if hot:
        docs = stage_table(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered_records")
        is_hot = F.coalesce(F.col("doc_id").isin([r[0] for r in hot if r[0] is not None]), F.lit(any(r[0] is None for r in hot)))
        number = F.when(is_hot, F.col("__row"))
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name != "__row"]
    found = docs.withColumn("__key", F.xxhash64(F.lit(seed), *values, number)).drop("__row")
    return found.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), "__key"), F.lit(buckets))), rows


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` with shard (from 0) and slot (from 0 in the shard), in random order.

    The numbers of rows of two shards differ by one at most; with fewer rows than shards some are empty. The same seed gives
    the same order, up to rows that are equal in all columns. Null ids and texts are values like others, empty and very long
    texts are records like others (a bucket with a text longer than ``bucket_bytes`` is so much larger). Columns named shard or slot
    are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("shard", "slot")
    found, rows = scattered(docs, seed, bucket_bytes)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A row per bucket, which is a row per bucket_bytes of the corpus.
    first = found.groupBy("__bucket").agg(F.count("*").alias("n")).select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))

    def mixed(bucket: pa.Table) -> pa.Table:
        bucket = bucket.take(pc.sort_indices(bucket, sort_keys=[("__key", "ascending")]))
        bucket = bucket.take(pa.array(fisher_yates(len(bucket), seed, bucket.column("__bucket")[0].as_py())))
        place = np.arange(len(bucket)) + bucket.column("__first")[0].as_py()
        shard = place * shards // rows
        slot = place - (shard * rows + shards - 1) // shards
        out = bucket.drop_columns(["__key", "__bucket", "__first"])
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot.astype(np.int64)))

    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return found.join(first, "__bucket").groupBy("__bucket").applyInArrow(mixed, schema)


def write_shards(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the shuffled documents as Parquet, a folder per shard, each file in the order of its slots; returns them read back."""
    path = folder or f"{scratch_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    out = shuffled(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.mode("errorifexists").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
