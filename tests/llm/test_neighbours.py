from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from routelore.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, queries, top=5):
    rows = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in queries:
        scores = sorted((-float(rows[q] @ v / np.sqrt(rows[q] @ rows[q]) / np.sqrt(v @ v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        out[q] = [(i, -s) for s, i in scores[:top]]
    return out


def test_probe_order():
    inside = np.array([0.1, 0.5, 0.8])
    steps = neighbours.probe_steps(inside, 27)
    cost = [sum((x if s < 0 else 1 - x) ** 2 for s, x in zip(step, inside) if s) for step in steps]
    assert cost == sorted(cost) and len({tuple(s) for s in steps}) == 27


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    queries = [i for i, _ in rows if i % 50 == 0]
    truth, found = exact(rows, queries), {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = sum(len({v for _, v, _ in found[q]} & {v for v, _ in truth[q]}) for q in queries)
    assert hits >= 0.9 * 5 * len(queries)
    for q in queries:
        assert [r for r, _, _ in sorted(found[q])] == [1, 2, 3, 4, 5]
        known = {i: s for i, s in exact(rows, [q], len(rows))[q]}
        assert all(abs(known[v] - s) < 1e-12 for _, v, s in found[q])


def test_probes_alone_answer_the_given_queries(spark):
    """Recall of the method without its exact path, which no query of the table takes; and the share of vectors visited."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    queries = [i for i, _ in rows if i % 50 == 0]
    own, _, asked, best, _ = neighbours.probed_nearest(vectors, vectors.where("vec_id % 50 = 0"))
    sure = neighbours.surely_reached(neighbours.TABLES, neighbours.HASHES, neighbours.WIDTH, neighbours.PROBES)
    assert neighbours.unsure(own, asked, best, 5, sure).count() == 0
    found, truth = {}, exact(rows, queries)
    for r in best.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found[q] & {v for v, _ in truth[q]}) for q in queries) >= 0.9 * 5 * len(queries)


def test_chance_of_being_reached():
    """The simulated chance against hashing itself."""
    rng = np.random.default_rng(5)
    for cosine in (0.0, 0.3, 0.7):
        hits = 0
        for _ in range(150):
            q = rng.normal(size=64)
            q /= np.linalg.norm(q)
            o = rng.normal(size=64)
            o -= q * (o @ q)
            v = cosine * q + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o)
            turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]  # fixed directions, so turn the vectors
            cell, inside = neighbours.cells(np.array([turn @ q, turn @ v]), 8, 8, 2.0)
            hits += any((neighbours.probe_steps(inside[0, t], 64) == cell[1, t] - cell[0, t]).all(axis=1).any() for t in range(8))
        assert abs(hits / 150 - neighbours.reach(cosine, 8, 8, 2.0, 64)) < 0.12
    assert neighbours.surely_reached(8, 8, 2.0, 128) < 0.3 < neighbours.surely_reached(1, 8, 0.5, 2)


def test_very_large_numbers(spark):
    rows = [(0, [1e200, 0.0]), (1, [3e200, 0.0]), (2, [0.0, 1e-200]), (3, [5e-324, 5e-324])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in neighbours.nearest(vectors, vectors.where("vec_id = 0")).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and abs(got[3] - 0.5**0.5) < 1e-15


def test_copies_odd_vectors_and_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, base.tolist()) for i in range(60)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(20)] + [(200, [1.0, 2.0]), (201, [2.0, 4.1]), (60, (base * 3).tolist())]
    odd = [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] + [1.0] * 7), (304, [float("inf")] * 8), (305, []), (None, base.tolist()), (0, base.tolist())]
    vectors = spark.createDataFrame(rows + odd, SCHEMA).withColumn("v", F.lit("clash")).withColumn("ids", F.lit(1))
    queries = vectors.where("vec_id IN (0, 3, 60, 105, 200, 300, 301, 302)")
    for block in (4096, 4):
        found = {}
        for r in neighbours.nearest(vectors, queries, width=50.0, block=block).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert set(found) == {0, 3, 60, 105, 200}
        assert [v for v, _ in found[0]] == [1, 2, 3, 4, 5] and [v for v, _ in found[3]] == [0, 1, 2, 4, 5]
        assert found[200] == [(201, found[200][0][1])]
        truth = exact(rows, [105])[105]
        assert [s for _, s in found[105]] == [round(s, 9) for _, s in truth]
    assert neighbours.nearest(vectors.limit(0), queries.limit(0)).collect() == []


def test_few_orthogonal_and_opposed_vectors(spark):
    axes = np.eye(64)
    few = [(0, axes[0]), (1, axes[1]), (2, -axes[0]), (3, axes[2] - axes[0]), (4, axes[0] + axes[3])]
    few += [(10, np.array([1.0, 0.0])), (11, np.array([-1.0, 0.0])), (20, np.ones(3))]
    rng = np.random.default_rng(6)
    crowd = [(100 + i, np.r_[0.0, rng.normal(size=63)]) for i in range(300)] + [(99, axes[0])]  # 99 is orthogonal to all of them
    for rows, asked, block in ((few, [i for i, _ in few], 4096), (few, [i for i, _ in few], 2), (crowd, [99], 64)):
        rows = [(i, v.tolist()) for i, v in rows]
        vectors = spark.createDataFrame(rows, SCHEMA)
        found = {}
        for r in neighbours.nearest(vectors, vectors.where(F.col("vec_id").isin(asked)), block=block).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        truth = {q: [(i, round(s, 9)) for i, s in near] for q, near in exact(rows, asked).items() if near}
        assert found.keys() == truth.keys()
        assert all([s for _, s in found[q]] == [s for _, s in truth[q]] and len({i for i, _ in found[q]}) == len(found[q]) for q in truth)
