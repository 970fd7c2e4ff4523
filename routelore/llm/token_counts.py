"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at a character; dynamic programming keeps the best score
up to there and the number of pieces on that path. Ties go as in the tokenizers library: for one end the earliest start (longest
piece) is offered first and a later one must be strictly better; a character without a piece of its own may be unknown, at the
lowest score of the vocabulary less 10, and counts as its UTF-8 bytes if the vocabulary has byte pieces. Words repeat, so a task
remembers the counts of short ones in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Fixed values of the tokenizer: the word mark, and how far an unknown character lies below the lowest score.
MARK, UNKNOWN_PENALTY = "▁", 10.0
REMEMBERED, LONGEST_REMEMBERED = 1 << 20, 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Piece counts of words; ``counter[word]`` looks up or computes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.bytes = {p for p, _ in pieces} >= {f"<0x{b:02X}>" for b in range(256)}

    def __missing__(self, word: str) -> int:
        count = self.pieces(MARK + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def pieces(self, word: str) -> int:
        """Number of pieces on the best path through one word, mark included."""
        if not self.single.issuperset(word):
            return self.pieces_with_unknown(word)
        score, count, before = [0.0] * (len(word) + 1), [0] * (len(word) + 1), -1
        for last, (size, own) in self.automaton.iter(word):  # by end, longest first
            start = last + 1 - size
            offer = score[start] + own
            if last != before or offer > score[last + 1]:
                score[last + 1], count[last + 1], before = offer, count[start] + 1, last
        return count[-1]

    def pieces_with_unknown(self, word: str) -> int:
        """The same for a word with characters that are no pieces."""
        n, unknown = len(word), self.unknown
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # ends up to here are settled

        def settle(end: int, best: float | None, pieces: int, single: bool) -> None:
            if not single:
                offer = unknown + score[end - 1]
                if best is None or offer > best:
                    best, loose[end] = offer, True
                    pieces = count[end - 1] + (len(word[end - 1].encode()) if self.bytes else 0 if loose[end - 1] else 1)
            score[end], count[end] = best, pieces

        best, pieces, single = None, 0, False
        for last, (size, own) in self.automaton.iter(word):
            end = last + 1
            while done < last:  # the end under work, and any without a piece
                settle(done + 1, best, pieces, single)
                best, pieces, single, done = None, 0, False, done + 1
            offer = score[end - size] + own
            if best is None or offer > best:
                best, pieces = offer, count[end - size] + 1
            single = single or size == 1
        while done < n:
            settle(done + 1, best, pieces, single)
            best, pieces, single, done = None, 0, False, done + 1
        return count[n]

    def text(self, text: str | None) -> int:
        """Pieces of a text: spaces become marks, one stands before the first word, and words are cut before each mark."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        return sum(map(self.__getitem__, text.removeprefix(" ").split(" ")))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every row; null and empty texts have none. Repeated rows stay and other columns are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path))
        for b in batches:
            counts = pa.array([counter.text(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts], names=["doc_id", "n_tokens"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())]
    return docs.select("doc_id", "text").mapInArrow(counted, T.StructType(fields))
