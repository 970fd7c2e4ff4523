from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelore.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_chain(spark, documents):
    rows = [(i, f"word{i % 7} other{i % 5} " + ("awful insult" if i % 4 == 0 else "kind") + (" spam" if i % 3 == 0 else "")) for i in range(240)]
    rows += [(1000, None), (1001, ""), (1002, "awful insult again"), (None, "kind"), (1003, "awful insult " + "filler " * 30_000), (1, rows[1][1])]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(0, 240)] + [(0, 1, 0), (None, 0, 1), (7777, 0, 1), (5, None, None)], LABELS)
    docs = documents(rows).withColumn("fold", F.lit("clash")).withColumn("p_toxic", F.lit(1))
    found = toxicity.judged(docs, labels).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1002].flagged and by_id[1003].flagged and not by_id[None].flagged and not by_id[1000].flagged and not by_id[1001].flagged
    assert all(by_id[i].flagged == (i % 4 == 0) for i in range(240))
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in found)


def test_without_labels(spark, documents):
    docs, low = documents([(1, "a b"), (2, None)]), pytest.approx(0, abs=1e-12)
    assert [(r.p_low_quality, r.p_toxic, r.flagged) for r in toxicity.judged(docs, spark.createDataFrame([], LABELS)).collect()] == [(low, low, False)] * 2
    one_kind = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], LABELS)
    assert [(r.p_low_quality, r.p_toxic) for r in toxicity.judged(docs, one_kind).collect()] == [(low, pytest.approx(1))] * 2
    assert toxicity.judged(documents([]), one_kind).collect() == []


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    rows = [np.array([i % 2, 10 + rng.integers(0, 400)]) for i in range(900)]  # the second word tells nothing
    first = np.array([i % 2 for i in range(900)])
    first[rng.random(900) < 0.2] ^= 1
    models = toxicity.chain(rows, np.column_stack([first, first]), np.arange(900) % toxicity.FOLDS)
    assert len(models) == 2 and models[1].before.shape == (1,)
    assert models[1].probability({1}, [0.9]) > 0.6 > 0.4 > models[1].probability({0}, [0.1])


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.where(F.col("doc_id") % 5 != 0)
    rows = toxicity.judged(docs, known).join(labels.where(F.col("doc_id") % 5 == 0), "doc_id").select("flagged", "toxic").collect()
    hit = sum(r.flagged and r.toxic == 1 for r in rows)
    assert hit >= 0.7 * sum(r.toxic == 1 for r in rows)
    assert sum(r.flagged and r.toxic == 0 for r in rows) <= 0.03 * len(rows)


def test_scores_equal_a_plain_reading_of_the_models(spark):
    """Every document's chain by its definition: features of each word, sums of weights, earlier probabilities fed on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    models = toxicity.learn(docs, labels)
    found = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    for doc in docs.collect():
        words = set(toxicity.WORD.findall((doc.text or "").lower()))
        own = {zlib.crc32(w.encode()) % toxicity.FEATURES for w in words} | {zlib.crc32((w[:5] + "*").encode()) % toxicity.FEATURES for w in words if len(w) > 5}
        earlier = []
        for m in models:
            z = m.intercept + sum(w for f, w in m.weights.items() if f in own) + sum(a * b for a, b in zip(m.before, earlier))
            earlier.append(1 / (1 + np.exp(-z)))
        r = found[doc.doc_id]
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(earlier, abs=1e-9) and r.flagged == (r.p_toxic >= 0.5)


def test_partial_labels_and_several_texts_of_an_id(spark, documents):
    rows = [(i, f"word{i % 7} " + ("awful" if i % 4 == 0 else "kind")) for i in range(200)]
    whole = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(200)]
    # The toxic label of awful texts is unknown for half of them: these tell nothing, instead of speaking against.
    partial = [(i, q, None if t and i % 8 == 0 else t) for i, q, t in whole]
    docs = documents(rows + [(1000, "awful"), (1001, "kind")])
    by_id = {r.doc_id: r.p_toxic for r in toxicity.judged(docs, spark.createDataFrame(partial, LABELS)).collect()}
    assert by_id[1000] > 0.9 and by_id[1001] < 0.1
    names = ["__low_quality", "__toxic"]
    known = toxicity.training_rows(docs, spark.createDataFrame([(1, None, 1), (2, 0, None), (3, None, None)], LABELS)).select("doc_id", *names).collect()
    assert sorted(map(tuple, known)) == [(1, -1, 1), (2, 1, -1)]
    several = documents(rows + [(0, "kind word0"), (4, "kind other"), (8, "kind")])
    models = [toxicity.learn(several.repartition(n), spark.createDataFrame(whole, LABELS)) for n in (1, 5)]
    assert [(m.weights, m.intercept) for m in models[0]] == [(m.weights, m.intercept) for m in models[1]]
