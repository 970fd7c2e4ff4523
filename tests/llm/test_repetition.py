from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from routelore.llm import repetition


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text, least):
    text = text or ""
    words = words_of(text)
    n, longest = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    spread = lambda size: len({x for i in range(n) for x in range(i, i + size(longest[i]))})
    lines = [x for x in text.split("\n") if words_of(x)]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            spread(lambda k: 3 if k >= 3 else 0), spread(lambda k: k if k >= least else 0), max(longest, default=0))


@pytest.mark.parametrize("seed", range(8))
def test_measures_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "é", "|", " ", "\x1c"]) for _ in range(rng.choice([0, 1, 5, 90]))) for _ in range(25)]
    for got, text in zip(repetition.measure(texts, 4).tolist(), texts):
        assert tuple(got) == brute(text, 4), repr(text)


def test_spans():
    text = "a b c d x a b c d y b c"
    assert repetition.repeated_spans(text, 3) == [(0, 4), (5, 4)]
    assert repetition.repeated_spans("", 3) == []


def test_verdicts(spark, documents):
    clean = " ".join(f"w{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, clean), (2, None), (3, ""), (4, "few words"), (5, "a b c " * 50), (6, clean + " " + passage + " mid " + passage), (7, f"{passage} x {passage}"),
            (8, " ".join(f"u{i}" for i in range(1000)) + " " + " ".join(f"u{i}" for i in range(150))), (1, clean)]
    docs = documents(rows).withColumn("kept", F.lit("clash")).withColumn("extra", F.lit(1))
    got = {r.doc_id: r for r in repetition.quality(docs).collect()}
    assert {k: (r.base_failed, r.kept) for k, r in got.items()} == {
        1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False), 6: (False, False), 7: (True, False), 8: (False, False)}
    assert repetition.quality(docs).count() == len(rows) and got[1].extra == 1
    assert repetition.quality(documents([])).collect() == []


def test_very_long_text():
    text = " ".join(str(i % 5000) for i in range(60_000))
    n, _, _, _, repeated, covered, longest = repetition.measure([text], 8)[0].tolist()
    assert (n, repeated, covered, longest) == (60_000, 60_000, 60_000, 55_000)
