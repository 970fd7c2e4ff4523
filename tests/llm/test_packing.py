from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelore.llm import packing
from routelore.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def pieces_of(tokenizer, text, capacity=1024):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    first = (len(ids) - 1) % capacity + 1
    starts = [0, *range(first, len(ids), capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def check_sequences(rows, capacity=1024):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in at.values())
    return at


def test_ids_equal_the_tokenizers(tokenizer):
    ids = packing.Ids(PATH)
    odd = ["", " ", "a　b", "漢字 emoji 😀", "x <|endoftext|> y", "\u0085 ﻿", "don't I'LL 123 4５", "a" * 20_000, " " * 30_000 + "x", "\n\n\t x \r\n", "é"]
    every = ["q" + chr(c) + " " + chr(c) + "7" for c in range(0x530)]
    for text in odd + every:
        assert ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:20]


def test_pieces_and_places(spark, documents, tokenizer):
    texts = [None, "", " ", "one two three", "one two three", "x y z " * 900, "w" * 5000 + " ß" * 3000, "<|endoftext|>"] + [f"word{i} " * (i % 97) for i in range(200)]
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(4, texts[4])]).withColumn("offset", F.lit(5)).withColumn("part", F.lit("x"))
    rows = packing.pack_documents(docs, PATH, keep_ids=True).collect()
    expected = sorted((i, k, a, n, c) for i, t in [*enumerate(texts), (4, texts[4])] for k, a, n, c, _ in pieces_of(tokenizer, t))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    filled = check_sequences(rows)
    assert len(filled) <= 1.03 * sum(filled.values()) / 1024 + 1
    placed = packing.pack_documents(docs, PATH, keep_ids=True)
    whole = {r.sequence_id: r for r in packing.packed_sequences(placed).collect()}
    assert sum(len(r.ids) for r in whole.values()) == sum(r[3] for r in expected)


def test_empty_table(spark, documents):
    assert packing.pack_documents(documents([]), PATH).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, rng.integers(1, 3000)) if seed % 2 else np.minimum(1024, rng.lognormal(5, 1, 2000).astype(int) + 1)
    sizes, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist()))
    seen, used = {}, {}
    for length, lo, hi, first, q, offset in packing.packing_plan(histogram):
        for r in range(lo, hi):
            assert seen.setdefault((length, r), True) is True
            used.setdefault(first + (r - lo) // q, []).append((offset + (r - lo) % q * length, length))
    assert len(seen) == sum(histogram.values()) == sum(len(u) for u in used.values())
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    big = int((lengths > 512).sum())
    assert len(used) <= 1.02 * max(big, lengths.sum() / 1024) + 0.06 * len(used) + 2


def test_plan_does_not_grow_with_counts():
    small = {n: 3 for n in range(1, 1025, 7)}
    large = {n: 3_000_000 for n in range(1, 1025, 7)}
    assert len(packing.packing_plan(large)) < 20 * len(packing.packing_plan(small)) + 5000
