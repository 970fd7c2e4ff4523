from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from routelore.llm import language, mixing, repetition
from test_repetition import brute, words_of
from test_simhash import brute_components, brute_fingerprint


def corpus(documents):
    rng = random.Random(3)
    words = {"en": "the and of to in is that with for was on are".split(), "de": "der die und das ist mit auf ein nicht für dem zu".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "x", "ing", "ung"]) + str(rng.randint(0, 99)) for _ in range(120 + i)), lang, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(10)]
    rows += [(300, None), (301, ""), (302, "123 456"), (303, "too short"), (304, "spam spam spam " * 60), (305, rows[3][1] + " " + rows[3][1]), (4, *rows[4][1:])]
    return documents(rows).withColumn("kept", F.lit("own")).withColumn("lang_pred", F.lit(7)).withColumn("fp", F.lit(1.5)).withColumn("offset", F.lit(2))


def test_each_stage_against_brute_force(spark, documents, tmp_path):
    docs = corpus(documents)
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)

    def step(name, frame):
        out = stages[name](spark, frame, None)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    key = lambda r: (r.doc_id, r.text)
    one = step(names[0], docs)
    assert one.columns == docs.columns and one.first().kept == "own" and one.first().lang_pred == 7
    predicted = language.identified(docs.select("doc_id", "text", "lang")).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.LEAST_SCORE}").collect()
    assert sorted(map(key, one.collect())) == sorted(map(key, predicted))
    assert {300, 301, 302}.isdisjoint(r.doc_id for r in one.collect()) and set(range(120)) <= {r.doc_id for r in one.collect()}

    def good(text):
        n, _, _, _, repeated, covered, longest = brute(text, 8)
        return n >= 50 and 100 * repeated <= 50 * n and covered <= 0.3 * n and longest <= 100

    two = step(names[1], one)
    assert sorted(map(key, two.collect())) == sorted(key(r) for r in one.collect() if good(r.text))
    assert {303, 304, 305}.isdisjoint(r.doc_id for r in two.collect())

    three = step(names[2], two)
    rows = two.collect()
    labels = brute_components([brute_fingerprint(r.text) for r in rows])
    smallest = {c: min(r.doc_id for r, own in zip(rows, labels) if own == c) for c in labels}
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(smallest.values())) and three.columns == docs.columns

    four = step(names[3], three)
    chosen = {r.doc_id for r in mixing.calibrated(three).where("__sampled").collect()}
    assert {r.doc_id for r in four.collect()} == chosen and four.columns == docs.columns

    five = step(names[4], four).collect()
    assert {r.doc_id for r in five} == chosen
    for own in {r.sequence_id for r in five}:
        at = 0
        for r in sorted((r for r in five if r.sequence_id == own), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_run(spark, documents, tmp_path):
    corpus(documents).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    documents([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mix_sources", "best_fit_packing"]


def test_words_are_the_contracts():
    assert words_of("a\x1cb\tc\x0bd") == ["a\x1cb", "c", "d"] and repetition.measure(["a\x1cb\tc\x0bd"], 8)[0][0] == 3


def five_word_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_near_dedup_against_brute_force_jaccard(spark, documents):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 300))] for _ in range(25)]
    for own in rows[:20]:  # copies with 1 to 8 words changed, chains of them, and a large family
        for k in range(1, 9):
            other = list(own)
            for i in rng.sample(range(len(own)), k):
                other[i] = rng.choice(vocabulary)
            rows.append(other)
    rows += [[*rows[0], f"tail{i}"] for i in range(40)]
    rng.shuffle(rows)
    texts = [" ".join(w) for w in rows] + ["", "one two", "One  two"]
    sets = [five_word_set(t) for t in texts]
    root, middle = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            middle += 0.8 <= alike < 0.95
            if alike >= corpus_pipeline.SIMILARITY and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert middle > 30 and len(set(root)) > 30
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(list(enumerate(texts))), None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_python_gets_texts_in_small_batches(spark, documents):
    docs = documents([(i, f"{i} the and of " * 8_000, "en") for i in range(100)]).coalesce(1)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(setting)
            stage(spark, docs.limit(0), None)
            found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
            assert len(found) > 1 and max(found) <= 1.5 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.unset(setting)
