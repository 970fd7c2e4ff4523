"""Quality rules with suffix-array repetition.

A batch of texts becomes one array of word numbers. Prefix doubling sorts the suffixes of every text; the ranks of each doubling
are kept, so the longest common prefix of suffixes that are neighbours in the array follows by halving steps. The longer of the
prefixes shared with the neighbour before and after a suffix is the longest repeat that starts there, and the longest-common-
prefix intervals are exactly the maximal repeated substrings. The union of their spans gives the covered fraction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def longest_repeats(words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each position the length of the longest word sequence starting there that occurs again in the same text
    (occurrences may overlap). Texts lie one after another; ``text_of`` numbers them."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((words, text_of))
    new = np.r_[True, (words[order][1:] != words[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, h = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        ahead = np.minimum(tied + h, n - 1)
        inside = (tied + h < n) & (text_of[ahead] == text_of[tied])
        key = rank[tied] * (n + 1) + np.where(inside, rank[ahead] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, own = key[order], tied[order]
        group = rank[own]
        place = np.arange(len(own))
        first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], place, 0))
        finer = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0))
        rank = rank.copy()
        rank[own] = group + finer - first
        levels.append(rank.astype(np.int32))
        h *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    a, b = array[:-1], array[1:]
    common = np.zeros(n - 1, np.int64)
    at = np.flatnonzero(levels[0][a] == levels[0][b])  # others share no word
    for level in range(len(levels) - 1, -1, -1):
        i, j = a[at] + common[at], b[at] + common[at]
        ok = np.maximum(i, j) < n
        same = np.zeros(len(at), bool)
        same[ok] = levels[level][i[ok]] == levels[level][j[ok]]
        common[at[same]] += 1 << level
    longest = np.zeros(n, np.int64)
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def measure(texts: list[str], min_repeat: int, window: int = 3) -> np.ndarray:
    """The columns of MEASURES for each text."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    out = np.zeros((len(texts), 7), np.int64)
    parts, at = [], [0]
    for k, text in enumerate(texts):
        raw = text.encode()
        words = raw.split()  # at exactly the six white-space bytes
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[k, :4] = len(words), len(text) - sum(map(text.count, SPACE_CHARS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))
        parts.append(np.fromiter((number[w] for w in words), np.int64, len(words)))
        at.append(at[-1] + len(words))
    n, sizes = at[-1], np.diff(at)
    if n:
        text_of = np.repeat(np.arange(len(texts)), sizes)
        longest = longest_repeats(np.concatenate(parts), text_of)
        full = sizes > 0
        first = np.array(at[:-1])[full]
        repeats = np.flatnonzero(longest >= window)
        out[full, 4] = np.add.reduceat(covered(repeats, np.full(len(repeats), window), n).astype(np.int64), first)
        spans = np.flatnonzero(longest >= min_repeat)
        out[full, 5] = np.add.reduceat(covered(spans, longest[spans], n).astype(np.int64), first)
        out[full, 6] = np.maximum.reduceat(longest, first)
    return out


def repeated_spans(text: str, min_repeat: int = 8) -> list[tuple[int, int]]:
    """Maximal repeated substrings of one text as (first word, words), leaving out those within an earlier span."""
    words = text.encode().split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    longest = longest_repeats(np.array([number[w] for w in words], np.int64), np.zeros(len(words), np.int64))
    return [(i, int(n)) for i, n in enumerate(longest) if n >= min_repeat and not (i and longest[i - 1] > n)]


def quality(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.3, max_longest: int = 100, min_words: int = 50, max_repeat_percent: int = 50, words_at_once: int = 1 << 19) -> DataFrame:
    """All columns of ``docs``, then the measures, base_failed and kept.

    Base: too few words, or more than ``max_repeat_percent`` of the words in repeated 3-word windows. The method fails a text whose
    repeats of ``min_repeat`` or more words cover more than ``max_covered`` of its words, or one of whose repeats is longer than
    ``max_longest`` words. A null text counts as one without words. Columns of ``docs`` named like a result come back under
    their own name only in the results' meaning, so they must be renamed before; other columns pass. Repeated rows stay.
    """
    from pyspark.sql import types as T

    measures = T._parse_datatype_string(MEASURES)
    clash = [c for c in docs.columns if c in {*measures.names, "base_failed", "kept"}]
    docs = docs.drop(*clash)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            parts, lo, chars = [], 0, 0
            for k, text in enumerate(texts):  # bounded arrays; one text is never cut
                chars += len(text)
                if chars > 6 * words_at_once or k == len(texts) - 1:
                    parts.append(measure(texts[lo : k + 1], min_repeat))
                    lo, chars = k + 1, 0
            if parts:
                found = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[:, i]) for i in range(7))], names=[*b.schema.names, *measures.names])

    found = docs.mapInArrow(measured, T.StructType([*docs.schema.fields, *measures.fields]))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    passes = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes)
