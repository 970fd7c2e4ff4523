"""Capped samples: what is ranked, and that the threshold changes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from routelore.functions import scalars as S
from routelore.operators import sampling as SA


@pytest.mark.parametrize("cap", [1, 7, 300, 4999, 5000, 9000])
def test_the_first_by_hash_are_kept(spark, cap):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    hashed = rows.withColumn("__h", S.hash_key(43, F.col("k")))
    want = [r.k for r in sorted(hashed.collect(), key=lambda r: r["__h"])][:cap]
    assert sorted(r.k for r in SA.sample_rows(rows, ["k"], max_rows=cap).collect()) == sorted(want)


def test_little_more_than_the_cap_is_ranked(spark, monkeypatch):
    ranked = []

    def counted(df, *args):
        ranked.append(df.count())
        return before(df, *args)

    before = SA.hash_positions
    monkeypatch.setattr(SA, "hash_positions", counted)
    rows = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    assert SA.sample_rows(rows, ["k"], max_rows=1000).count() == 1000
    assert SA.sample_contexts(rows, ["k"], 400).count() == 400
    assert 1000 <= ranked[0] < 2000 and 400 <= ranked[1] < 800


def test_too_few_below_the_threshold_means_all(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("k"))
    want = sorted(r.k for r in SA.sample_rows(rows, ["k"], max_rows=500).collect())
    monkeypatch.setattr(SA, "_below", lambda hashed, share: hashed.limit(3))
    assert sorted(r.k for r in SA.sample_rows(rows, ["k"], max_rows=500).collect()) == want
    uneven = spark.range(300).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") == 5, 2000).otherwise(1))).alias("v"))
    assert 0 < SA.sample_contexts_to_budget(uneven, ["k"], 200).count() <= 2001
