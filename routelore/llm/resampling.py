"""Importance resampling of documents towards a target distribution, by hashed n-grams.

Texts are cut and coded by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode``. Shifted
dictionary indices form the longer runs of words, each distinct run is hashed once by CRC-32, and a document's gains are taken from
a table of one number per bucket and reduced by segments. Counts of the whole corpus and of the target texts make that table,
whose size is the number of buckets. Documents are drawn without replacement by the Gumbel trick: a sum of mean gain and a hashed
Gumbel number ranks them, and the best are kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from routelore.llm.shared import numbered
from routelore.sources.staging import stage_table

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Fixed value: what separates words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that the kernels work on at a time.
SLICE = 4 << 20
#: Width of the bins in which scores are counted to find the last one drawn.
BIN = 64


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``SLICE`` bytes, with their first place; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def hashed_runs(texts: pa.Array, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to ``ngram`` words, ordered by text, and the number of words of each text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    owner = owner.filter(real).to_numpy().astype(np.int64)
    word, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    run, spelled = word, names
    found, owners = [], []
    for n in range(1, ngram + 1):
        if n > 1:  # the runs of n - 1 words, and the word after each in the same text
            inside = owner[n - 1 :] == owner[: max(0, len(owner) - n + 1)]
            pairs, run_at = np.unique(run[:-1] * len(names) + word[n - 1 :], return_inverse=True) if len(word) >= n else (np.empty(0, np.int64), np.empty(0, np.int64))
            spelled = [f"{spelled[p // len(names)]} {names[p % len(names)]}" for p in pairs.tolist()]
            run = run_at.astype(np.int64)
        else:
            inside = np.ones(len(word), bool)
        crc = np.fromiter((zlib.crc32(s.encode()) % buckets for s in spelled), np.int64, len(spelled))
        found.append(crc[run][inside])
        owners.append(owner[: len(run)][inside])
    bucket, text = np.concatenate(found), np.concatenate(owners)
    if ngram > 1:
        order = np.argsort(text, kind="stable")
        bucket, text = bucket[order], text[order]
    return bucket, text, np.bincount(owner, minlength=len(texts))


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features in it, of the whole column ``text``. Each task sends its sums only."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, some in slices(b.column("text")):
                total += np.bincount(hashed_runs(some, ngram, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of each bucket to the corpus', both with one feature added to each."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for row in counts.collect():  # one row per bucket at most
            into[row["bucket"]] = row["n"]
    all_s, all_t = int(s.sum()), int(t.sum())
    ratio = [((a + 1) * (all_s + buckets)) / ((b + 1) * (all_t + buckets)) for a, b in zip(t.tolist(), s.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of the features (0 without any)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(sent.value)
        for b in batches:
            for lo, some in slices(b.column("text")):
                bucket, text, words = hashed_runs(some, ngram, len(table))
                taken = table.take(pa.array(bucket)).to_numpy()
                n = np.bincount(text, minlength=len(some))
                starts = np.cumsum(n) - n
                total = np.zeros(len(some), np.int64)
                total[n > 0] = np.add.reduceat(taken, starts[n > 0]) if len(taken) else 0
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(some)), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]]
    return docs.select("doc_id", "text").mapInArrow(scored, T.StructType(fields))


def resampled(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document with doc_id, n_words, n_features, weight, score and rank (from 1; null if not drawn).

    Of the documents with ``least_words`` or more, ``percent`` in a hundred are drawn (rounded down), highest score first, ties to the
    smaller doc_id; null ids come first, and equal rows in the order of their files. A null or empty text has no features and weight 0; a null
    doc_id hashes as the empty string. Texts of any length are read whole, in slices. Columns but doc_id and text are left out, whatever their
    names. An empty table gives an empty table; an empty target makes all gains those of its added ones.
    """
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    own = weighed(docs, gain, ngram).withColumn("score", F.col("weight") + noise).withColumn("__row", F.monotonically_increasing_id())
    own = stage_table(own, "scores")
    able = own.where(F.col("n_words") >= least_words)
    bins = sorted(((r["bin"], r["n"]) for r in able.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("n")).collect()), reverse=True)
    many = sum(n for _, n in bins) * percent // 100  # the bins are bounded by the range of scores, some thousand
    cut, above = math.inf, 0
    for low, n in bins:
        if above >= many:
            break
        cut, above = low * BIN, above + n
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not many:
        return own.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    placed = numbered(own.where(near).withColumn("__down", -F.col("score")), [], ["__down", "doc_id", "__row"], "place")
    drawn = placed.select(*columns, F.when(F.col("place") < many, F.col("place") + 1).alias("rank"))
    return drawn.unionAll(own.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
