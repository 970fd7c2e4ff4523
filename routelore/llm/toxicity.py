"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over hashed words and word beginnings; the model of a category also
sees the probabilities of the categories before it. While learning, these probabilities come from models fitted without the
document's own fold, so a later model meets the same kind of input as in use.

Learning takes a bounded sample of labelled documents (``SAMPLE_ROWS`` of at most ``SAMPLE_BYTES`` bytes each), whose features come
to the driver; every document is scored, whole, in tasks that hold the few chosen features only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from routelore.sources.staging import stage_table

SAMPLE_ROWS, SAMPLE_BYTES, FOLDS = 12_000, 20_000, 3
#: Hashed features, those a model may use, letters of a word's beginning, and words a task remembers.
FEATURES, CHOSEN, BEGINNING, REMEMBERED = 1 << 18, 512, 5, 1 << 18
#: Categories in the order of the chain, with the condition on ``labels``.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
WORD = re.compile(r"[^\W\d_]{2,}")


def word_features(word: str) -> tuple[int, ...]:
    """The word itself, and its beginning if it is longer."""
    own = (word, word[:BEGINNING] + "*") if len(word) > BEGINNING else (word,)
    return tuple(zlib.crc32(w.encode()) % FEATURES for w in own)


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Linear:
    """A logistic model: weights of chosen features, of the probabilities before it, and the intercept."""

    weights: dict[int, float]
    before: np.ndarray
    intercept: float

    def probability(self, features: set[int], before: Sequence[float]) -> float:
        z = self.intercept + sum(map(self.weights.get, self.weights.keys() & features)) + float(np.dot(self.before, before))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chosen_features(rows: Sequence[np.ndarray], y: np.ndarray, many: int, least: int = 5) -> np.ndarray:
    """Which features differ most between the classes, by their standard score; rare ones are left out."""
    flat, own = np.concatenate(rows), np.repeat(y, [len(r) for r in rows])
    seen, share = np.bincount(flat, minlength=FEATURES), y.mean()
    score = np.abs(np.bincount(flat, own, FEATURES) - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    score[seen < least] = 0
    best = np.argsort(-score, kind="stable")[:many]
    return best[score[best] > 0]


def fitted(rows: Sequence[np.ndarray], y: np.ndarray, before: np.ndarray, epochs: int = 40, rate: float = 0.5, penalty: float = 1e-4, batch: int = 128) -> Linear:
    """Logistic regression by AdaGrad over seeded shuffles. Labels all alike give their share as a constant."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Linear({}, np.zeros(before.shape[1]), 30.0 if share else -30.0)
    chosen = chosen_features(rows, y, CHOSEN)
    place = np.full(FEATURES, -1)
    place[chosen] = np.arange(len(chosen))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    k = before.shape[1]
    w, squares = np.zeros(len(chosen) + k + 1), np.full(len(chosen) + k + 1, 1e-8)
    w[-1] = np.log(share / (1 - share))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            flat, own = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            z = np.bincount(own, w[flat], len(part)) + (before[part] * w[len(chosen) : -1]).sum(axis=1) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            slope = np.concatenate([np.bincount(flat, error[own], len(chosen)), (before[part] * error[:, None]).sum(axis=0), [error.sum()]])
            slope[: len(chosen)] += penalty * w[: len(chosen)]
            squares += slope * slope
            w -= rate * slope / np.sqrt(squares)
    return Linear(dict(zip(chosen.tolist(), w[: len(chosen)].tolist())), w[len(chosen) : -1].copy(), float(w[-1]))


def chain(rows: Sequence[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model per column of ``labels``, each with out-of-fold probabilities of those before it.

    A category is learned from the documents whose label of it is known (0 or 1; -1 is unknown); all get its probability."""
    models, before = [], np.zeros((len(rows), 0))
    sets = [set(r.tolist()) for r in rows]
    for k in range(labels.shape[1]):
        y, known = labels[:, k].astype(float), labels[:, k] >= 0
        some = lambda kept: fitted([rows[i] for i in np.flatnonzero(kept)], y[kept], before[kept])
        models.append(some(known))
        held = np.zeros(len(rows))
        for f in range(FOLDS if k < labels.shape[1] - 1 else 0):
            own = np.flatnonzero(fold == f)
            model = some(known & (fold != f))
            held[own] = [model.probability(sets[i], before[i]) for i in own]
        before = np.column_stack([before, held])
    return models


def training_rows(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text, fold and a column for each category (1, 0, or -1 where no row knows it), for a bounded sample of labelled documents,
    chosen by a hash.

    Labels of one doc_id are merged: a category holds if any row says so. Documents whose labels are all null are left out.
    """
    merged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.expr(f"CAST({c} AS INT)")).alias(f"__{n}") for n, c in categories])
    merged = stage_table(merged.where(F.coalesce(*[f"__{n}" for n, _ in categories]).isNotNull()), "merged_labels")
    chance = int((sample_rows << 30) / max(1, merged.count()))
    chosen = merged.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(chance)).fillna(-1)
    chosen = chosen.withColumn("__fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    # At most about sample_rows narrow rows are broadcast.
    return docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes).join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS) -> list[Linear]:
    names = [f"__{n}" for n, _ in categories]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({f for w in text_words(t.as_py()) for f in word_features(w)}) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "__hash", "__fold", *names)] + [pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "__hash", "__fold", *names, "own"])

    sample = training_rows(docs, labels, categories, sample_rows).withColumn("__hash", F.xxhash64("text"))
    fields = [sample.schema["doc_id"], T.StructField("__hash", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("__fold", *names)], T.StructField("own", T.ArrayType(T.IntegerType()))]
    held = sample.select("doc_id", "text", "__hash", "__fold", *names).mapInArrow(numbered, T.StructType(fields))
    # Of several texts under one id the one of the least hash is learned from.
    one = held.groupBy("doc_id").agg(F.min_by(F.struct("__fold", *names, "own"), "__hash").alias("one"))
    held = one.select("doc_id", "one.*").toArrow().sort_by("doc_id")
    rows = [np.array(r, np.int64) for r in held.column("own").to_pylist()]
    return chain(rows, np.column_stack([held.column(n).to_numpy() for n in names]).reshape(-1, len(names)), held.column("__fold").to_numpy())


class Known(dict):
    """Chosen features of a word, remembered; bounded."""

    def __init__(self, chosen: set[int]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(f for f in word_features(word) if f in self.chosen)
        return found


def judged(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category, and flagged: whether the last category's probability reaches the threshold.

    A null or empty text is judged by the models' intercepts. A category whose labels are all alike, or that has none, gets
    probability (almost) 1 or 0. A label that is null in one category only tells nothing about that category. Repeated rows stay; other columns are left out; an empty table gives an empty table.
    """
    models = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, categories, sample_rows))
    names = [f"p_{n}" for n, _ in categories]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models.value
        known = Known({f for m in own for f in m.weights})
        for b in batches:
            out: list[list[float]] = []
            for text in b.column("text"):
                features = {f for w in text_words(text.as_py()) for f in known[w]}
                row: list[float] = []
                for model in own:
                    row.append(model.probability(features, row))
                out.append(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in out], pa.float64()) for k in range(len(names)))], names=["doc_id", *names])

    fields = [docs.schema["doc_id"], *[T.StructField(n, T.DoubleType()) for n in names]]
    return docs.select("doc_id", "text").mapInArrow(scored, T.StructType(fields)).withColumn("flagged", F.col(names[-1]) >= threshold)
