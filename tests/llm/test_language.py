from __future__ import annotations

import math
import zlib

from pyspark.sql import functions as F

from routelore.llm import language

FOLDER = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute_bits(rows, langs, order, text, lang, least=8):
    """Code length of a text by the recursive definition."""
    counts = {}
    for own, t in rows:
        raw = b"\n" * order + t.encode()
        for i in range(order, len(raw)):
            for d in range(order + 1):
                c = counts.setdefault(raw[i - d : i], {}).setdefault(own, {})
                c[raw[i]] = c.get(raw[i], 0) + 1
    seen = {b for _, t in rows for b in b"\n" * order + t.encode()}
    size = len(seen) + 1
    total = lambda context: sum(sum(c.values()) for c in counts.get(context, {}).values())

    def bits(context, byte, first=True):
        if first:
            while total(context) < least:
                context = context[1:]
        own = counts[context].get(lang, {})
        n, kinds = sum(own.values()), len(own)
        if byte in own:
            return -math.log2(own[byte] / (n + kinds))
        escape = -math.log2(kinds / (n + kinds)) if n else 0.0
        if context == b"":
            return escape + math.log2(size)
        shorter = context[1:]
        while total(shorter) < least:
            shorter = shorter[1:]
        return escape + bits(shorter, byte, False)

    raw = bytes(b if b in seen else 255 for b in b"\n" * order + text.encode())
    return sum(bits(raw[i - order : i], raw[i]) for i in range(order, len(raw)))


def test_code_lengths_equal_the_definition(spark, documents):
    rows = [("en", "the cat sat on the mat and the dog"), ("de", "der hund und die katze und das haus"), ("fr", "le chat et le chien sur la table"), ("en", "a thing of the other")]
    order = 2
    docs = documents([(i, t, a) for i, (a, t) in enumerate(rows)])
    counted = language.grams(docs.select("text", "lang"), order).collect()
    langs = ["de", "en", "fr"]
    model = language.Model(langs, sorted(tuple(r) for r in counted), order, least=3)
    texts = ["the dog", "die katze", "x", "", "qu'est-ce ß que", "le la le"]
    got = model.bits(texts)
    for text, own in zip(texts, got):
        for lang, bits in zip(langs, own):
            assert abs(bits - brute_bits(rows, langs, order, text, lang, 3)) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language.identified(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", F.col("lang").alias("true"), F.length("text").alias("n")), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) for r in found)
    test = [r for r in found if r.held_out and r.n > 100]
    assert sum(r.lang_pred == r.true for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in found)


def test_inputs_of_a_prediction(spark, documents):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(40)] + [(i, "der hund und das haus " * 3, "de") for i in range(40, 80)]
    extra = [(100, None), (101, ""), (102, "12 34 !?"), (103, "the mat", None), (None, "das haus", "en"), (104, "das haus und " * 20_000, "en"), (1, rows[1][1])]
    docs = documents(rows + extra).withColumn("score", F.lit("clash")).withColumn("extra", F.lit(2))
    found = {r.doc_id: r for r in language.identified(docs).collect()}
    assert [found[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert found[100].score == 0 and found[None].held_out is False and found[104].lang_pred == "de" and found[1].extra == 2
    assert language.identified(docs).count() == len(rows) + len(extra)
    assert language.identified(documents([])).collect() == []
    unlabelled = language.identified(documents([(1, "words", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
