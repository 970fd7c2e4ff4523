"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are integers up to the capacity, so everything that decides the packing is a histogram with at most ``capacity``
rows, whatever the number of documents:

1. large lengths are sorted and cut into groups of equal cardinality; each is rounded up to the largest of its group;
2. the few-size problem is solved by configurations (column generation with a knapsack per round);
3. the groups' slots are filled with the actual, shorter pieces; this leaves known gaps;
4. small pieces go, longest first, into the smallest gap that holds them; what is left opens new sequences.

The result is a table of rank ranges: "pieces of length L with rank lo..hi go to sequences s, s+1, ...". Its size depends
on the capacity only (checked). Spark numbers the pieces of each length and joins them with that table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from routelore.sources.staging import stage_table

PLAN_SCHEMA = "length long, lo long, hi long, first_sequence long, per_sequence long, first_offset long"
#: Texts with characters beyond these (where Unicode versions differ), or with the special token's string, are left to the
#: tokenizer's own library; for all others the faster one gives the same ids.
UNCOMMON = re.compile("[^\\x00-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]|<\\|endoftext\\|>")


class Ids:
    """Token ids of a text by the vocabulary in ``path`` (a tokenizers file with its rank file beside it)."""

    def __init__(self, path: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        self.quick = None
        rank_file = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(rank_file):
            with open(rank_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.quick is not None and not UNCOMMON.search(text):
            try:
                return self.quick.encode_to_numpy(text).astype("<u4", copy=False)
            except ValueError:  # a run of white space too long for its pattern
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the place of its length in its task (part, place).

    A null text counts as empty, and an empty text is the end id alone. A document of more than ``capacity`` ids is cut into
    pieces of that length, the first of which may be shorter. Repeated rows give repeated pieces. Other columns are left out.
    ``keep_ids`` adds the ids themselves.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("place", T.LongType())]
    fields += [("ids", T.ArrayType(T.LongType()))] * keep_ids
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, part = Ids(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        arrow = None
        for batch in batches:
            out: list[tuple] = []
            arrow = arrow or pa.schema([("doc_id", batch.schema.field("doc_id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), *[("ids", pa.list_(pa.int64()))] * keep_ids])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(ids_of(text.as_py() or ""), np.array([end_id], "<u4")).astype("<u4", copy=False)
                first = (len(ids) - 1) % capacity + 1
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    own = ids[max(0, end - capacity) : end] if k else ids[:first]
                    n = len(own)
                    row = (doc, k, end - n, n, zlib.crc32(own), part, seen[n])
                    out.append((*row, own.tolist()) if keep_ids else row)
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def grouped_sizes(lengths: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal-cardinality groups of pieces in falling order of length: the rounded size of each and how many it holds.
    Groups of one size are merged."""
    ends = np.cumsum(counts)
    cuts = np.unique(np.linspace(0, ends[-1], groups + 1).astype(np.int64))
    sizes = lengths[np.searchsorted(ends, cuts[:-1], side="right")]
    distinct, where = np.unique(-sizes, return_inverse=True)
    return -distinct, np.bincount(where, np.diff(cuts)).astype(np.int64)


def best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth that fits: a knapsack by number of pieces."""
    most = capacity // int(sizes.min())
    value, picks = np.zeros(capacity + 1), []
    shifted = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits = shifted >= 0
    for _ in range(most):
        offers = np.where(fits, value[np.maximum(shifted, 0)] + worth[:, None], -1.0)
        pick = offers.argmax(axis=0)
        better = np.take_along_axis(offers, pick[None, :], 0)[0]
        gain = better > value + 1e-12
        if not gain.any():
            break
        picks.append(np.where(gain, pick, -1))
        value = np.maximum(value, better)
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            column[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(column @ worth), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1000, slack: float = 0.0005) -> list[tuple[np.ndarray, int]]:
    """How often to use which configuration: the linear program by column generation, rounded down, and best fit for the rest.

    Ends within half a sequence, or the share ``slack``, of the dual bound, or after ``rounds`` columns; any basis is feasible.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), demand / (capacity // sizes)
    bound = 0.0
    for step in range(rounds):
        worth = inverse.sum(axis=0)
        value, column = best_column(sizes, np.maximum(worth, 0), capacity)
        bound = max(bound, x.sum() / max(value, 1.0))
        if x.sum() - bound < max(0.5, slack * x.sum()):
            break
        move = inverse[:, column > 0] @ column[column > 0]
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / move[out]
        inverse -= move[:, None] * row
        inverse[out] = row
    left, used = demand.astype(np.int64).copy(), []
    for i in np.argsort(-x):
        times = int(np.floor(x[i] + 1e-7))
        if times:
            used.append((basis[:, i].round().astype(np.int64), times))
            left -= used[-1][0] * times
    left, gaps = np.maximum(left, 0), []
    for g in range(k):  # sizes fall
        for _ in range(int(left[g])):
            fit = min((b for b in gaps if b[0] >= sizes[g]), key=lambda b: b[0], default=None)
            if fit is None:
                gaps.append(fit := [capacity, np.zeros(k, np.int64)])
            fit[0] -= int(sizes[g])
            fit[1][g] += 1
    return used + [(b[1], 1) for b in gaps]


def packing_plan(histogram: dict[int, int], capacity: int = 1024, small: int = 160, groups: int = 200) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN_SCHEMA for a histogram of lengths; lengths up to ``small`` only fill gaps.

    Pieces of ``length`` with rank lo <= r < hi go to sequence first_sequence + (r - lo) div per_sequence, at first_offset +
    ((r - lo) mod per_sequence) * length.
    """
    lengths = np.array(sorted((n for n in histogram if n > small), reverse=True), dtype=np.int64)
    rows, gaps, sequences = [], defaultdict(list), 0  # gaps: room left -> [first sequence, how many]
    if len(lengths):
        counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
        ends = np.cumsum(counts)
        sizes, demand = grouped_sizes(lengths, counts, groups)
        place = np.concatenate([[0], np.cumsum(demand)[:-1]])
        stop = np.cumsum(demand)
        for column, times in configurations(sizes, demand, capacity):
            slots = []
            for g in np.flatnonzero(column):
                for _ in range(int(column[g])):
                    take = int(min(times, stop[g] - place[g]))
                    if take:
                        slots.append((int(place[g]), take))
                        place[g] += take
            edges = {0} | {t for _, t in slots}
            for p, t in slots:
                edges |= {int(e) - p for e in ends if p < e < p + t}
            edges = sorted(edges)
            for lo, hi in zip(edges, edges[1:]):
                offset = 0
                for p, t in slots:
                    if lo < t:
                        at = int(np.searchsorted(ends, p + lo, side="right"))
                        rank = p + lo - int(ends[at] - counts[at])
                        rows.append((int(lengths[at]), rank, rank + hi - lo, sequences + lo, 1, offset))
                        offset += int(lengths[at])
                gaps[capacity - offset].append((sequences + lo, hi - lo))
            sequences += edges[-1]
    for size in sorted((n for n in histogram if n <= small), reverse=True):
        rank, left, room = 0, int(histogram[size]), size
        while left:
            if room > capacity:
                new = -(-left // (capacity // size))
                gaps[capacity].append((sequences, new))
                sequences, room = sequences + new, capacity
            for first, n in gaps.pop(room, []):
                each = room // size
                full = min(n, left // each)
                part = left - full * each if full < n else 0
                for bins, q in ((full, each), (1, part)):
                    if bins and q:
                        rows.append((size, rank, rank + bins * q, first, q, capacity - room))
                        gaps[room - q * size].append((first, bins))
                        first, n, rank, left = first + bins, n - bins, rank + bins * q, left - bins * q
                if n:
                    gaps[room].append((first, n))
            room += 1
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, small: int = 160, groups: int = 200) -> DataFrame:
    """Adds sequence_id and offset to staged ``token_pieces``; part and place go.

    Every piece is placed once and sequences have no gaps before their end. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = stage_table(counts, "piece_counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = packing_plan(histogram, capacity, small, groups)
    if len(plan) > 64 * capacity + 64 * groups * capacity // small:
        raise AssertionError("the plan must not grow with the input")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    table = F.broadcast(spark.createDataFrame(plan, PLAN_SCHEMA))  # bounded by the capacity, checked above
    step = F.col("rank") - F.col("lo")
    placed = ranked.join(table, (ranked["length"] == table["length"]) & (ranked["rank"] >= table["lo"]) & (ranked["rank"] < table["hi"])).drop(table["length"])
    return placed.withColumns({
        "sequence_id": F.col("first_sequence") + F.floor(step / F.col("per_sequence")),
        "offset": F.col("first_offset") + step % F.col("per_sequence") * F.col("length"),
    }).drop("part", "place", "before", "rank", "lo", "hi", "first_sequence", "per_sequence", "first_offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, small: int = 160, groups: int = 200) -> DataFrame:
    """Pieces of ``docs`` with their places; the pieces are written once, so their ranks stay as they are if a task is lost."""
    return pack(stage_table(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity, small, groups)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """The token sequences themselves, from pieces packed with ``keep_ids``: sequence_id, ids, doc_ids (in order of offset)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # bounded by the capacity
    return placed.groupBy("sequence_id").agg(inside.alias("own")).select(
        "sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"))
