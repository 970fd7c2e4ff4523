from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from routelore.llm import token_counts
from routelore.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


def reference(pieces, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TEXTS = ["", " ", "  ", " a", "▁x", "a  b\n\nc", "é漢字𝄞 x<0x41></s>", "中文中文 \t\r\nab", "word " * 300, "x" * 3000, "漢" * 500, "😀 ok"]


def test_counts_equal_the_tokenizers():
    pieces = token_counts.vocabulary(PATH)
    expected, counter = reference(pieces, True), token_counts.Counter(pieces)
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdeth  éß漢𝄞\n▁<>0xA") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in TEXTS + made:
        assert counter.text(text) == expected(text), repr(text)


@pytest.mark.parametrize("seed", range(10))
def test_ties_in_small_vocabularies(seed):
    rng = random.Random(seed)
    names = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(14)}
    pieces = [("<unk>", 0.0), *((n, -float(rng.randint(1, 3))) for n in sorted(names))]
    expected, counter = reference(pieces, False), token_counts.Counter(pieces)
    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))
        assert counter.text(text) == expected(text), (pieces, text)


def test_query_shape(spark, documents):
    rows = [(1, "one two"), (2, None), (3, ""), (None, "one two"), (1, "one two")]
    n = reference(token_counts.vocabulary(PATH), True)("one two")
    got = token_counts.token_counts(documents(rows).withColumn("n_tokens", F.lit("clash")), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, n), (1, n), (1, n), (2, 0), (3, 0)]
    assert token_counts.token_counts(documents([]), PATH).collect() == []
