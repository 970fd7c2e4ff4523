from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from routelore.llm import mixing


def test_raking_meets_the_margins(spark):
    rows = [(f"s{i}", lang, topic, (i + 1) * 100 + 7 * len(topic)) for i in range(5) for lang in ("en", "de") for topic in ("a", "bbb", "cc") if (i + len(topic)) % 4]
    cells = mixing.raked(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), sweeps=25).collect()
    total = sum(r[3] for r in rows)
    assert abs(sum(c.weight for c in cells) - 1) < 1e-9
    for at, key in enumerate(mixing.KEYS):
        shares = {}
        for r in rows:
            shares[r[at]] = shares.get(r[at], 0) + r[3] / total
        whole = sum(v ** mixing.POWERS[key] for v in shares.values())
        for value, share in shares.items():
            weight = sum(c.weight for c in cells if c[key] == value)
            assert abs(weight - share ** mixing.POWERS[key] / whole) < 1e-4


def test_odd_rows(spark, documents):
    rows = [(i, "some words here " * (i % 7), "en" if i % 3 else "de", f"s{i % 4}") for i in range(400)]
    rows += [(1000, None, None, None), (1001, "", "xx", "empty"), (None, "a | b", "en", "s1"), (1, rows[1][1], "en", "s1")]
    docs = documents(rows).withColumn("tokens", F.lit("clash")).withColumn("weight", F.lit(3))
    found = mixing.calibrated(docs).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
        assert 0 <= r["__probability"] <= 1 and r["__sampled"] is not None
    assert by_id[1001][0]["__probability"] == 1.0 and by_id[1001][0]["__tokens"] == 0
    assert by_id[None][0]["__topic"] == "table" and by_id[1000][0]["__tokens"] == 0
    assert len({r["__sampled"] for r in by_id[1]}) == 1
    assert mixing.sampled(docs).columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in mixing.sampled(docs).collect()))) == sorted(str(r.doc_id) for r in found if r["__sampled"])
    assert mixing.sampled(documents([])).collect() == []


def test_expected_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    total, expected, got = mixing.calibrated(docs).agg(F.sum("__tokens"), F.sum(F.col("__tokens") * F.col("__probability")), F.sum(F.when(F.col("__sampled"), F.col("__tokens")))).first()
    assert expected <= mixing.FRACTION * total * 1.0001
    assert abs(got - expected) < 0.05 * total


def test_sample_meets_its_marginals(spark):
    """Shares of the expected tokens against the targets, whatever cells are taken whole."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = mixing.calibrated(docs).groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens"), F.max("__probability").alias("p")).collect()
    total = sum(r.tokens for r in found)
    expected = sum(r.tokens * r.p for r in found)
    assert abs(expected / total - mixing.FRACTION) < 1e-3 * mixing.FRACTION
    for at, key in enumerate(mixing.KEYS):
        shares, reached = {}, {}
        for r in found:
            shares[r[at]] = shares.get(r[at], 0) + r.tokens / total
            reached[r[at]] = reached.get(r[at], 0) + r.tokens * r.p / expected
        target = {v: s ** mixing.POWERS[key] for v, s in shares.items()}
        target = {v: t / sum(target.values()) for v, t in target.items()}
        for _ in range(20):
            whole = sum(t for v, t in target.items() if t < 2 * shares[v])
            held = sum(2 * shares[v] for v, t in target.items() if t >= 2 * shares[v])
            target = {v: 2 * shares[v] if t >= 2 * shares[v] else t * (1 - held) / whole for v, t in target.items()}
        assert all(abs(reached[v] - t) < 1e-3 * t for v, t in target.items()), key


def test_rare_values_are_taken_whole(spark):
    rows = [("big", "en", "a", 100_000), ("small", "en", "a", 10), ("big", "de", "b", 50), ("small", "de", "b", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    raked = mixing.raked(cells)
    assert all(c.weight <= c.most * (1 + 1e-9) for c in raked.collect())
    by = {(r.marginal, r.value): (r.target, r.reached) for r in mixing.marginals(raked).collect()}
    assert by["source", "small"] == pytest.approx((2 * 10 / 100_060,) * 2, rel=1e-12)
    assert mixing.marginals(mixing.raked(cells.limit(0))).collect() == []
