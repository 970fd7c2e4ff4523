from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelore.llm import similar


def words_of(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute(texts, similarity=0.8):
    """For each text the smallest place it reaches over links."""
    sets, root = [words_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def corpus(seed=8, many=20):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(120)]
    rows = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 300))] for _ in range(many + 5)]
    rows += [[*passage, *(rng.choice(vocabulary) for _ in range(rng.randint(30, 90)))] for _ in range(60)]  # alike, but not enough
    for own in rows[:many]:
        for k in range(1, 9):
            other = list(own)
            for i in rng.sample(range(len(own)), k):
                other[i] = rng.choice(vocabulary)
            rows.append(other)
    rows += [[*rows[0], f"tail{i}"] for i in range(40)]
    rng.shuffle(rows)
    return [" ".join(w) for w in rows] + ["", None, "one two", "One  two"]


@pytest.mark.parametrize("hot", [1024, 8])
def test_components_equal_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT", hot)
    texts = corpus()
    root = brute(texts)
    got = {r.doc_id: r.component for r in similar.components(documents(list(enumerate(texts)))).collect()}
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(got[i])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pairs_between_parts_are_all_asked(spark):
    """Members that only the last round can bring together: every near pair of different components, however large the bucket."""
    rng = np.random.default_rng(3)
    sketches = [rng.integers(0, 256, similar.SENT, dtype=np.uint8) for _ in range(30)]
    rows = []
    for c in range(120):
        own = sketches[c % 30].copy()
        own[similar.SKETCH : similar.SKETCH + 4] = 9  # the name of the bucket's band
        own[: c // 30] ^= 1
        rows.append((7, 0, c, c // 60, own.tobytes()))
    members = spark.createDataFrame(rows, "key long, band int, class long, root long, sketch binary").withColumn("many", F.lit(120))
    for hot in (1024, 16):
        similar.HOT, before = hot, similar.HOT
        got = {(r.u, r.v) for r in similar.asked_pairs(similar.in_pairs_of_parts(members), 0.65, False).collect()}
        similar.HOT = before
        want = {(a, b) for a in range(120) for b in range(120) if a % 30 == b % 30 and a // 60 != b // 60}
        assert {tuple(sorted(p)) for p in got} == {tuple(sorted(p)) for p in want}
        assert similar.asked_pairs(similar.in_pairs_of_parts(members.withColumn("band", F.lit(1))), 0.65, False).count() == 0  # not their first band


def test_nothing_is_lost_without_ids_or_with_shared_ones(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (7, a), (7, b), (8, c), (5, a), (5, a), (5, "x y"), (None, None), (None, "")]
    docs = documents(rows).withColumn("component", F.lit("own")).withColumn("one", F.lit(1)).withColumn("text_hash", F.lit(2))
    kept = similar.deduplicated(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(found, key=repr)[:4] == sorted([(5, a), (5, "x y"), (7, b), (8, c)], key=repr)
    assert len(found) == 5 and found[-1][0] is None or (None, None) in found or (None, "") in found
    only = similar.deduplicated(documents([(None, a), (None, b), (None, c)]))
    assert sorted(r.text for r in only.collect()) == sorted([a, b, c])
    assert similar.deduplicated(documents([])).collect() == []


def test_very_long_text(spark, documents):
    long = " ".join(f"w{i * i % 10007}" for i in range(200_000))
    got = similar.deduplicated(documents([(1, long), (2, long + " tail"), (3, "w1 w2")])).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_simhash_links_are_candidates(spark, documents):
    """Copies that op5's fingerprints link are asked for by those links, and the sets decide."""
    rng = random.Random(11)
    long = [rng.choice([f"w{i}" for i in range(400)]) for _ in range(900)]
    texts = [" ".join(long), " ".join([*long, "end"]), " ".join(rng.sample(long, 900)), "a b c", "c d e f g h"]
    own = similar.signatures(documents(list(enumerate(texts))), 5)
    fps, classes = ([r[c] for r in own.orderBy("doc_id").collect()] for c in ("fp", "class"))
    want = {(classes[i], classes[j]) for i in range(5) for j in range(5) if i != j and ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3}
    got = {(r.u, r.v) for r in similar.simhash_pairs(own).collect()}
    assert (classes[0], classes[1]) in got and got == want


def test_last_round_writes_a_forest_not_pairs(spark):
    """A bucket of texts that may all be similar by their sketches gives the links that join its components, fewer than its members."""
    rng = np.random.default_rng(4)
    base = np.sort(rng.choice(1 << 40, 400, replace=False).astype(np.uint64))
    sketch = rng.integers(0, 256, similar.SENT, dtype=np.uint8)
    sketch[similar.SKETCH : similar.SKETCH + 4] = 9  # the name of the bucket's band
    sets = [np.unique(np.r_[base[: 400 - 90 * (k // 30)], rng.choice(1 << 40, 90 * (k // 30) + k % 30).astype(np.uint64)]) for k in range(90)]
    members = spark.createDataFrame([(7, 0, c, c, sketch.tobytes()) for c in range(90)], "key long, band int, class long, root long, sketch binary").withColumn("many", F.lit(90))
    own = spark.createDataFrame([(c, s.tobytes()) for c, s in enumerate(sets)], "class long, own binary")
    similar_pairs = [(a, b) for a in range(90) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]

    def roots(pairs):
        root = list(range(90))
        for u, v in pairs:
            low, high = sorted((root[u], root[v]))
            root = [low if r == high else r for r in root]
        return root

    want = roots(similar_pairs)
    assert len(set(want)) > 2 and len(similar_pairs) > 400
    for hot in (1024, 16):
        similar.HOT, before = hot, similar.HOT
        parts = similar.in_pairs_of_parts(members)
        got = [(r.u, r.v) for r in similar.bucket_links(parts, own, 0.71, 0.8).collect()]
        similar.HOT = before
        assert roots(got) == want and {tuple(sorted(p, reverse=True)) for p in got} <= set(similar_pairs)
        if hot == 1024:
            assert len(got) == 90 - len(set(want))


@pytest.mark.parametrize("hot", [1024, 3])
def test_pairs_that_only_share_large_buckets_are_found(spark, documents, monkeypatch, hot):
    """Texts whose only similar one lies in another part of each large bucket are held against it all the same."""
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "SHARED", 1)
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(160)]
    rows = [[*passage, *(rng.choice(vocabulary) for _ in range(42))] for _ in range(150)]  # 0.65 alike
    rows += [[*own[:-8], *(rng.choice(vocabulary) for _ in range(8))] for own in rows[:50]]  # 0.92 like one of them
    texts = [" ".join(w) for w in rows]
    root = brute(texts)
    got = {r.doc_id: r.component for r in similar.components(documents(list(enumerate(texts)))).collect()}
    assert len(set(root)) == 150
    assert all(got[i] == got[r] for i, r in enumerate(root)) and len(set(got.values())) == 150
