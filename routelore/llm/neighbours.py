"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector of length 1 is projected on Gaussian directions, shifted, and cut into cells of a width; ``hashes`` cells together name a
bucket, and there are several tables. A query visits, beside its own bucket, those whose cells are one off where that is most
likely: perturbations in rising order of the summed squared distances to the cell borders that are crossed. Queries and vectors
meet by an equality shuffle on (table, bucket, block); inside, scores are products of matrices, and each query leaves with its
best few only. Queries that find too few, or whose last neighbour is so far that probes reach its like with less than ``SURE``, then meet every
vector of their size exactly, in blocks; that chance follows from the parameters alone. Equal vectors are one vector with their smallest ids, and large buckets are cut into blocks that every query of
the bucket visits, so nothing is dropped and no pair list is written.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from routelore.llm.shared import salted_join
from routelore.sources.staging import stage_table

#: Production parameters. On vectors of 64 dimensions whose neighbours are far (cosine 0.5) they find over 0.9 of the true ones.
TABLES, HASHES, WIDTH, PROBES = 8, 8, 2.0, 128
BLOCK = 4096
TOP = 5
#: A query meets all vectors if its last found neighbour's cosine is one that the probes reach with a smaller chance than this.
SURE = 0.9


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the embedding, without null and zero vectors and those with null or non-finite parts."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", F.col("embedding").alias("v")).where(F.coalesce(good, F.lit(False)))


def directions(dim: int, tables: int, hashes: int, width: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def cells(vectors: np.ndarray, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers, and how far into its cell each projection lies (0 to 1), both (vectors, tables, hashes)."""
    a, b = directions(vectors.shape[1], tables, hashes, width)
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    at = (np.einsum("nd,dk->nk", unit, a) + b) / width
    cell = np.floor(at)
    return cell.astype(np.int64).reshape(-1, tables, hashes), (at - cell).reshape(-1, tables, hashes)


def bucket(cell: np.ndarray) -> np.ndarray:
    """One number for the cells of a table (the last axis); cells lie within -128 and 127 for any sensible width."""
    out = np.zeros(cell.shape[:-1], np.int64)
    for k in range(cell.shape[-1]):
        out = out * 1_000_003 + (cell[..., k] + 128)  # wraps; a collision only adds candidates
    return out


def probe_steps(inside: np.ndarray, probes: int) -> np.ndarray:
    """Steps (-1, 0, 1 for each hash) of the ``probes`` likeliest buckets, the own one first."""
    k = len(inside)
    cost = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(cost, kind="stable")
    ranked, steps = cost[order], [np.zeros(k, np.int64)]
    heap = [(ranked[0], (0,))]
    while heap and len(steps) < probes:
        score, chosen = heapq.heappop(heap)
        hashes = [int(order[i]) % k for i in chosen]
        if len(set(hashes)) == len(hashes):
            step = np.zeros(k, np.int64)
            for i in chosen:
                step[int(order[i]) % k] = -1 if order[i] < k else 1
            steps.append(step)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - ranked[last] + ranked[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + ranked[last + 1], (*chosen, last + 1)))
    return np.array(steps)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def keyed(vectors: DataFrame, keep: str, tables: int, hashes: int, width: float, probes: int) -> DataFrame:
    """Rows (slot: table, bucket; dim; the id column ``keep``; v): one per table, or per table and probe."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(keep).to_numpy(zero_copy_only=False), b.column("v").to_pylist()
            dims = np.array([len(x) for x in lists])
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                cell, inside = cells(np.array([lists[i] for i in own]), tables, hashes, width)
                if probes == 1:
                    who, table = np.repeat(own, tables), np.tile(np.arange(tables), len(own))
                    named = bucket(cell).ravel()
                else:
                    steps = [probe_steps(inside[n, t], probes) for n in range(len(own)) for t in range(tables)]
                    sizes = np.array([len(s) for s in steps])
                    at = np.repeat(cell.reshape(-1, hashes), sizes, axis=0) + np.concatenate(steps)
                    named = bucket(at)
                    who, table = np.repeat(np.repeat(own, tables), sizes), np.repeat(np.tile(np.arange(tables), len(own)), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), dim, np.int32)), pa.array(table.astype(np.int32)), pa.array(named), pa.array(ids[who])], names=["dim", "table", "bucket", keep])

    return vectors.mapInArrow(hashed, f"dim int, table int, bucket long, {keep} long")


@lru_cache(maxsize=None)
def trials(hashes: int, probes: int, many: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Made-up queries: where they lie in their cells, the steps that they probe, and a standard normal step for each hash."""
    rng = np.random.default_rng(11)
    inside = rng.uniform(0, 1, (many, hashes))
    return inside, np.array([probe_steps(at, probes) for at in inside]), rng.normal(size=(many, hashes))


def reach(cosine: float, tables: int, hashes: int, width: float, probes: int) -> float:
    """The chance that a vector of this cosine to a query lies in a bucket that the query visits, by simulation: a hash moves it
    by a normal step as wide as the distance of the two unit vectors."""
    inside, steps, normal = trials(hashes, probes)
    moved = np.floor(inside + normal * np.sqrt(2 - 2 * cosine) / width).astype(int)
    return 1 - (1 - (steps == moved[:, None]).all(axis=2).any(axis=1).mean()) ** tables


def surely_reached(tables: int, hashes: int, width: float, probes: int, sure: float = SURE) -> float:
    """The least cosine, to a hundredth, that probes reach with the chance ``sure``; above 1 if none is."""
    low, high = -100, 101
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if reach(middle / 100, tables, hashes, width, probes) >= sure else (middle + 1, high)
    return low / 100


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; powers of two, which round nothing, keep squares in range."""

    def unit(m: np.ndarray) -> np.ndarray:
        m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    return np.einsum("qd,nd->qn", unit(queries), unit(vectors), optimize=False)


def probed_nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK):
    """The usable vectors, their classes, the queries, each one's best rows (query_id, vec_id, score, rank) found by probing, and the
    function that scores a block of vectors for some queries."""
    own = stage_table(usable(vectors).where("vec_id IS NOT NULL").dropDuplicates(["vec_id"]), "vectors")
    # Equal vectors: the smallest ids suffice, one more than asked for as the query may be among them.
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = own.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= top + 1)
    classes = stage_table(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class"), "ids", "v"), "vector_classes")
    asked = stage_table(own.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id"), "queries")

    index = stage_table(keyed(classes, "class", tables, hashes, width, 1), "index")
    slot = ["dim", "table", "bucket"]
    blocks = index.groupBy(*slot).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*slot, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    blocks = stage_table(blocks, "large_buckets")
    dealt = salted_join(index, blocks, slot, ["class"], salts=8).withColumn("block", F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    probed = keyed(asked, "query_id", tables, hashes, width, probes)
    probed = salted_join(probed, blocks, slot, ["query_id"], salts=8).withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")

    right = salted_join(dealt, classes, ["class"], ["table"], salts=1, how="inner")
    left = salted_join(probed, asked, ["query_id"], ["table"], salts=1, how="inner")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), pa.float64()]
        if not asked.num_rows or not held.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        v, lists = matrix(held.column("v")), held.column("ids").to_pylist()
        out: list[tuple] = []
        for lo in range(0, asked.num_rows, 256):
            some = asked.slice(lo, 256)
            scores = exact_scores(matrix(some.column("v")), v)
            many = min(top + 1, len(lists))  # one class may hold only the query
            for q, row in zip(some.column("query_id").to_pylist(), scores):
                least = np.partition(row, -many)[-many]
                best = sorted((-row[i], x) for i in np.flatnonzero(row >= least) for x in lists[i] if x != q)[:top]
                out.extend((q, x, -s) for s, x in best)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    key = [*slot, "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = stage_table(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return own, classes, asked, best, meet


def unsure(own: DataFrame, asked: DataFrame, best: DataFrame, top: int, sure: float) -> DataFrame:
    """query_id and dim of the queries that found fewer than they should, or whose last score is below ``sure``."""
    sizes = stage_table(own.groupBy(F.size("v").alias("dim")).agg(F.least(F.count("*") - 1, F.lit(top)).alias("due")), "sizes")
    got = best.groupBy("query_id").agg(F.count("*").alias("got"), F.min("score").alias("last"))
    named = salted_join(asked.select("query_id", F.size("v").alias("dim")), sizes, ["dim"], ["query_id"], salts=8, how="inner")
    short = named.join(got, "query_id", "left").where((F.coalesce("got", F.lit(0)) < F.col("due")) | (F.col("last") < sure))
    return short.select("query_id", "dim")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each query (rows of ``vectors`` named by ``queries``, vec_id).

    Score is the cosine of the original vectors in double precision; ties go to the smaller vec_id, and the query's own id is no
    candidate (nor are rows repeating it). Vectors that are null, zero or have null or non-finite parts take no part, on either
    side; vectors of different sizes do not meet. Only fewer candidates give fewer rows, an empty table none.
    """
    own, classes, asked, best, meet = probed_nearest(vectors, queries, top, tables, hashes, width, probes, block)
    short = stage_table(unsure(own, asked, best, top, surely_reached(tables, hashes, width, probes)), "short_queries")

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sized = classes.withColumn("dim", F.size("v"))
    held, sets = stage_table(pieces(sized, "blocks"), "blocks"), stage_table(pieces(short, "sets"), "query_sets")
    whole = stage_table(held.join(sets, "dim"), "exact_blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = salted_join(short, whole, ["dim"], ["query_id"], salts=8, how="inner").join(asked, "query_id")
    left = left.withColumn("set", part("query_id", "sets")).withColumn("block", every("blocks"))
    right = salted_join(sized, whole, ["dim"], ["class"], salts=8, how="inner")
    right = right.withColumn("block", part("class", "blocks")).withColumn("set", every("sets"))
    key = ["dim", "block", "set"]
    exact = left.select(*key, "query_id", "v").groupBy(*key).cogroup(right.select(*key, "ids", "v").groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = best.select("query_id", "vec_id", "score").unionAll(exact).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
