from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routelore.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, ngram=1):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target, ngram=1, buckets=10_000, least=20, percent=10):
    spot = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(spot(f) for _, t in rows for f in features(t, ngram)[0])
    t = Counter(spot(f) for x in target for f in features(x, ngram)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in rows:
        found, words = features(text, ngram)
        weight = sum(gain(spot(f)) for f in found) // len(found) if found else 0
        u = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted([(*r[:4], ranks.get(id(r))) for r in out], key=repr)


def found(docs, target, **options):
    got = resampling.resampled(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(n):
    words = ["alpha", "Beta", "GAMMA", "größe", "x1", "日本", "the", "of", "Ärger", "é"]
    return [(k, " ".join(words[(k * 7 + j * j + j) % (3 + k % 8)] + (",\x00" if j % 5 == 0 else "") for j in range(k % 60))) for k in range(n)]


@pytest.mark.parametrize("ngram,percent", [(1, 10), (2, 50), (3, 100)])
def test_equals_brute_force(spark, documents, ngram, percent):
    rows, target = corpus(400), ["alpha größe the the of", "of x1 日本", None, ""]
    aims = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert found(documents(rows), aims, ngram=ngram, percent=percent) == brute(rows, target, ngram=ngram, percent=percent)


def test_small_slices_and_long_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 64)
    texts = pa.array(["a b", None, "", "c " * 500, "A-b c", "..."])
    runs = [(lo + t, b) for lo, some in resampling.slices(texts) for b, t in zip(*resampling.hashed_runs(some, 2, 1000)[:2])]
    want = [(k, zlib.crc32(f.encode()) % 1000) for k, t in enumerate(texts.to_pylist()) for f in features(t, 2)[0]]
    assert sorted(runs) == sorted(want)
    rows = [(1, "word " * 200_000), (2, "other " * 30)]
    aims = spark.createDataFrame([(1, "other")], "item_id long, text string")
    assert found(documents(rows), aims, percent=50) == brute(rows, ["other"], percent=50)


def test_nulls_ties_repeated_rows_and_clashing_columns(spark, documents):
    rows = [(None, "w " * 25), (None, "w " * 25), (3, "w " * 25), (3, "w " * 25), (3, "v " * 25), (9, None), (10, ""), (11, "?! ABC")] + [(k, "u " * 20) for k in range(20, 40)]
    aims = spark.createDataFrame([(1, "w v")], "item_id long, text string")
    names = ["rank", "score", "weight", "n_words", "n_features", "place", "__row", "bin", "bucket"]
    docs = documents(rows).withColumns({c: F.lit("x") for c in names})
    assert found(docs, aims, percent=40) == brute(rows, ["w v"], percent=40)


def test_empty_tables(spark, documents):
    aims = spark.createDataFrame([(1, "w v")], "item_id long, text string")
    assert found(documents([]), aims) == []
    rows = corpus(60)
    assert found(documents(rows), aims.where("false")) == brute(rows, [])
