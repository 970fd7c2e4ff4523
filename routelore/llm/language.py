"""Language identification by prediction by partial matching.

For each language a variable-order byte model is learned: contexts of 0 to ``order`` bytes with the counts of the bytes that
follow. A context that was seen often enough is a node; a byte not seen there escapes to the next shorter context (escape
probability by method C: distinct successors against all successors). The statistics are frozen after learning, so the code
length of a byte depends only on the bytes before it, and the code lengths of all languages are read from one table. A text goes
to the language that codes it shortest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LETTER = re.compile(r"[^\W\d_]")
#: Bound on the texts learned from, in documents of each language and in bytes of each (longer ones are not learned from).
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 20_000


def training_sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text and lang of learning documents: labelled, doc_id's crc32 not 2 modulo 4, and at most about ``sample_docs`` a language,
    chosen by a hash. The choice costs one narrow aggregation and no shuffle of texts."""
    learnable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 4 <> 2")
    sizes = [(r.lang, r.n) for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # a row per language, as in the model
    if not sizes:
        return docs.where("false").select("text", "lang")
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, int((sample_docs << 30) / n))])[F.col("lang")]
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share
    return learnable.where(chosen).where("text IS NOT NULL").where(F.octet_length("text") <= sample_bytes).select("text", "lang")


def grams(sample: DataFrame, order: int) -> DataFrame:
    """Counts of context and next byte (gram: the bytes as a number; size: their count), for every language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                found = []
                for text, own in zip(texts, langs):
                    if own == lang:
                        raw = np.frombuffer(padded(text, order), np.uint8).astype(np.int64)
                        found.append(sum(raw[k : len(raw) - order + k] << 8 * (order - k) for k in range(order + 1)))
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return sample.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def padded(text: str, order: int) -> bytes:
    return b"\n" * order + text.encode()


class Model:
    """Frozen code lengths: ``cost[state, symbol, language]`` in bits, and the state of each context of ``order`` symbols.

    Bytes are mapped to the symbols seen while learning, all others to one more symbol. States are the contexts of full order seen
    at least ``least`` times in any language, the rest fall back to their suffixes, so the tree has nodes of different depths.
    ``cells`` bounds the table: of a depth's contexts the most frequent become nodes.
    """

    def __init__(self, langs: list[str], rows: list[tuple[str, int, int]], order: int, least: int = 8, cells: int = 1 << 24):
        self.langs, self.order = langs, order
        data = np.array([(langs.index(a), g, n) for a, g, n in rows], np.int64).reshape(-1, 3)
        columns = np.stack([(data[:, 1] >> 8 * (order - k)) & 255 for k in range(order + 1)], axis=1)
        seen = np.unique(columns)
        self.symbol = np.full(256, len(seen), np.uint8)
        self.symbol[seen] = np.arange(len(seen))
        a = self.alphabet = len(seen) + 1
        states = max(a, cells // (2 * a * len(langs)))
        columns, count, lang = self.symbol[columns].astype(np.int64), data[:, 2].astype(float), data[:, 0]
        parent_state = np.zeros(1, np.int32)
        cost = np.full((1, a, len(langs)), np.log2(a), np.float32)  # no context at all: every symbol alike
        for depth in range(order + 1):
            context = np.zeros(len(data), np.int64)
            for k in range(order - depth, order):
                context = context * a + columns[:, k]
            names, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, count, minlength=len(names))
            chosen = np.flatnonzero(total >= least)
            if len(chosen) > states:
                chosen = np.sort(chosen[np.argsort(-total[chosen], kind="stable")[:states]])
            number = np.full(len(names), -1)
            number[chosen] = np.arange(len(chosen))
            in_node = number[where] >= 0
            freq = np.zeros((len(chosen), a, len(langs)), np.float32)
            np.add.at(freq, (number[where][in_node], columns[in_node, order], lang[in_node]), count[in_node])
            # The state of a context of this depth without a node is that of its suffix.
            suffix = parent_state[np.arange(a**depth) % max(1, a ** (depth - 1))] if depth else parent_state
            lower = cost[suffix[names[chosen]]]
            all_, kinds = freq.sum(axis=1, keepdims=True), (freq > 0).sum(axis=1, keepdims=True)
            whole = np.maximum(all_ + kinds, 1)
            escape = np.where(all_ > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
            own = np.where(freq > 0, -np.log2(np.maximum(freq, 1) / whole), escape + lower)
            parent_state = suffix.copy()
            parent_state[names[chosen]] = len(cost) + np.arange(len(chosen), dtype=np.int32)
            cost = np.concatenate([cost, own.astype(np.float32)])
        self.state, self.cost = parent_state, np.ascontiguousarray(cost.reshape(-1, len(langs)))

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        lo, size, group = 0, 0, []
        for k, text in enumerate(texts):
            group.append(padded(text, self.order))
            size += len(group[-1])
            if size > 1 << 20 or k == len(texts) - 1:
                out[lo : k + 1] = self._bits(group)
                lo, size, group = k + 1, 0, []
        return out

    def _bits(self, group: list[bytes]) -> np.ndarray:
        sizes = np.array([len(g) for g in group])
        s = self.symbol[np.frombuffer(b"".join(group), np.uint8)].astype(np.int32)
        context = s[: len(s) - self.order].copy()
        for k in range(1, self.order):
            context *= self.alphabet
            context += s[k : len(s) - self.order + k]
        index = self.state[context] * self.alphabet + s[self.order :]
        starts = np.cumsum(sizes) - sizes
        stops = starts + sizes - self.order  # places that start in one text and end in the next count for none
        out = np.zeros((len(group), len(self.langs)))
        for j in range(len(self.langs)):
            total = np.concatenate([[0.0], np.cumsum(self.cost[index, j], dtype=np.float64)])
            out[:, j] = total[stops] - total[starts]
        return out


def learn(docs: DataFrame, order: int = 3, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """The model, or None if nothing can be learned from. What comes to the driver are counts over the bounded sample."""
    rows = [tuple(r) for r in grams(training_sample(docs, sample_docs, sample_bytes), order).collect()]
    langs = sorted({r[0] for r in rows})
    return Model(langs, sorted(rows), order) if langs else None


def identified(docs: DataFrame, order: int = 3, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """All columns of ``docs`` with held_out, lang_pred and score.

    lang_pred is ``und`` with score 0 for a null text, one without a letter, or if nothing was learned. Otherwise score is the share of the
    chosen language when languages are weighed by 2 to the minus code length; ties go to the language that sorts first. held_out
    is whether doc_id's crc32 is 2 modulo 4 (false for a null doc_id, which is not learned from either). Columns named like a
    result are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, order, sample_docs, sample_bytes))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = b.column("text").to_pylist()
            own = [k for k, t in enumerate(texts) if m is not None and t and LETTER.search(t)]
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            if own:
                bits = m.bits([texts[k] for k in own])
                best = bits.argmin(axis=1)
                names[own] = np.array(m.langs, object)[best]
                scores[own] = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*b.schema.names, "lang_pred", "score"])

    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    held = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 4 = 2"), F.lit(False))
    return docs.mapInArrow(judged, T.StructType(fields)).withColumn("held_out", held)
