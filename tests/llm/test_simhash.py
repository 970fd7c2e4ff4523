from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from routelore.llm import simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    for text in [None, "", " \t", "One", "one two", "ONE two THREE", "Ä b c d\x1ce", "a b c d e f g a b c", "x " * 700]:
        assert simhash.fingerprint(text) == signed(brute_fingerprint(text)), text


def components_of(spark, fps, hot=simhash.HOT):
    table = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    return {r.node: r.root for r in simhash.stars(simhash.links(table, hot)).collect()}


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:  # neighbours at 1 to 4 bits, and chains of them
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.append(f)
    family = rng.getrandbits(64)  # one half the same: hot variants
    fps += [family ^ rng.getrandbits(9) for _ in range(150)] + [0, 7, (1 << 64) - 1]
    fps = sorted(set(fps), key=signed)
    expected = brute_components(fps)
    for hot in (4096, 16):
        roots = components_of(spark, fps, hot)
        assert [roots.get(signed(f), signed(f)) for f in fps] == [signed(fps[e]) for e in expected]


def test_bucket_forest():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 14, 900).astype(np.uint64) << np.uint64(3))
    assert simhash.forest(fps, 64).tolist() == brute_components([int(f) for f in fps])


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    roots = {r.node: r.root for r in simhash.stars(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_components(spark, documents):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base + " tail"), (4, None), (2, ""), (8, "  "), (7, "other text here"), (7, "other text here"), (None, base)]
    docs = documents(rows).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    fps = [brute_fingerprint(r[1]) for r in rows]
    labels = brute_components(fps)
    low = {c: min(r[0] for r, e in zip(rows, labels) if e == c and r[0] is not None) for c in labels}
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp, r.component_id) for r in simhash.components(docs).collect())
    assert got == sorted((-1 if r[0] is None else r[0], signed(f), low[c]) for r, f, c in zip(rows, fps, labels))
    assert simhash.components(documents([])).collect() == []
