from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelore.llm import sharding

SMALL = {"bucket_bytes": 2000}


def placed(df):
    return sorted((r.shard, r.slot, r.doc_id, r.text) for r in df.collect())


def check(rows, got, shards=24):
    """Every record once, counts one apart at most, slots gapless."""
    assert Counter((r[2], r[3]) for r in got) == Counter(rows)
    sizes = Counter(r[0] for r in got)
    counts = [sizes[s] for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert [r[1] for r in got if r[0] == s] == list(range(sizes[s]))


@pytest.mark.parametrize("n", [1, 5, 24, 25, 500])
def test_records_counts_and_slots(spark, documents, n):
    rows = [(k, f"text {k}" * (k % 9)) for k in range(n)]
    got = placed(sharding.shuffled(documents(rows), **SMALL))
    check(rows, got)


def test_same_order_whatever_the_layout_and_another_by_seed(spark, documents):
    rows = [(k, f"text {k}") for k in range(400)]
    docs = documents(rows)
    first = placed(sharding.shuffled(docs.repartition(3, "doc_id"), **SMALL))
    assert first == placed(sharding.shuffled(docs.repartition(7).orderBy(F.desc("doc_id")), **SMALL))
    other = placed(sharding.shuffled(docs, seed=14, **SMALL))
    assert first != other
    check(rows, other)


def test_order_is_uniform(spark, documents):
    """No place keeps a trace of the order of ids: rank correlation near 0, and the ids of a shard spread over all."""
    n = 4000
    got = placed(sharding.shuffled(documents([(k, f"t{k}") for k in range(n)]), shards=4, bucket_bytes=5000))
    ids = np.array([r[2] for r in got])
    assert abs(np.corrcoef(ids, np.arange(n))[0, 1]) < 4 / np.sqrt(n)
    table = np.histogram2d([r[0] for r in got], ids // (n // 10), bins=(4, 10))[0]
    assert ((table - 100) ** 2 / 100).sum() < 70  # 27 degrees of freedom


def test_fisher_yates_gives_every_order_alike():
    seen = Counter(tuple(sharding.fisher_yates(4, 1, b)) for b in range(4800))
    assert len(seen) == 24 and max(seen.values()) < 270 and min(seen.values()) > 130


def test_hot_ids_copies_nulls_and_clashing_columns(spark, documents):
    rows = [(7, "same")] * 300 + [(None, None)] * 200 + [(k, "same") for k in range(100)] + [(1000, ""), (1001, None), (1002, "x" * 100_000)]
    docs = documents(rows).withColumns({"shard": F.lit("a"), "slot": F.lit("b"), "n": F.lit(1), "__keep": F.lit(2)})
    found, many = sharding.scattered(docs.drop("shard", "slot"), 13, 2000)
    hot = found.where("doc_id = 7").groupBy("__bucket").count().collect()
    assert many == len(rows) and len(hot) > 10  # equal rows are scattered too
    got = sharding.shuffled(docs, **SMALL)
    check(rows, placed(got))
    assert got.columns == [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"]


def test_written_shards_and_empty_table(spark, documents, tmp_path):
    rows = [(k, f"text {k}") for k in range(100)]
    back = sharding.write_shards(documents(rows), str(tmp_path / "out"), shards=8, **SMALL)
    check(rows, placed(back), 8)
    assert len(list((tmp_path / "out").glob("shard=*"))) == 8
    assert sharding.write_shards(documents([])).collect() == []
