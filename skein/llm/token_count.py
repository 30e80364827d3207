"""Token counts of a unigram tokenizer without its tokens.

A text's words (each with the mark for the space before it) are counted once per distinct word: an Aho-Corasick automaton
over the vocabulary enumerates all matches, and dynamic programming over end positions carries the best score and its
number of pieces. Ties follow the tokenizer: among segmentations of one score the one whose last piece is longest wins, a
character without a match of its own length may be unknown at the lowest score less 10, and an unknown character is spelled
in one byte piece for each of its bytes.

The vocabulary's pieces and scores come from a public SentencePiece file, taken as unigram log scores.

Defined results: a null or empty text has 0 tokens and score 0; long texts are worked off word by word, a long word takes 16 bytes
a character beside itself; repeated rows give repeated results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that are remembered, the longest of them, and from what length on a word's matches are not gathered first.
CACHED, KEPT, LONG = 300_000, 100, 10_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary and byte pieces of a SentencePiece file with their scores; the first entry is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    some = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    return [("", 0.0), *((model.id_to_piece(i), model.get_score(i)) for i in some)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def _ending(self, word: str) -> Iterable[list[tuple[int, float]]]:
        """The matches that end at each character; those of a long word one character at a time."""
        if len(word) <= LONG:
            ending: list[list[tuple[int, float]]] = [[] for _ in range(len(word))]
            for end, match in self.automaton.iter(word):
                ending[end].append(match)
            return ending
        return self._ending_one_by_one(word)

    def _ending_one_by_one(self, word: str) -> Iterator[list[tuple[int, float]]]:
        at, here = 0, []
        for end, match in self.automaton.iter(word):
            while at < end:
                yield here
                at, here = at + 1, []
            here.append(match)
        while at < len(word):
            yield here
            at, here = at + 1, []

    def word(self, word: str) -> tuple[int, float]:
        n = len(word)
        best, count = ([0.0] * (n + 1), [0] * (n + 1)) if n <= LONG else (array("d", bytes(8 * n + 8)), array("q", bytes(8 * n + 8)))
        for end, matches in enumerate(self._ending(word), 1):
            top, length = None, 0
            for size, score in matches:
                score += best[end - size]
                if top is None or score > top or (score == top and size > length):
                    top, length = score, size
            pieces = count[end - length] + 1
            if all(size != 1 for size, _ in matches):
                score = self.unknown + best[end - 1]
                if top is None or score > top:
                    top, pieces = score, count[end - 1] + len(word[end - 1].encode())
            best[end], count[end] = top, pieces
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = text.replace(MARK, " ").split(" ")
        if parts[0] == "":  # the text has its own first mark
            del parts[0]
        known, n, total = self.known, 0, 0.0
        for part in parts:
            found = known.get(part)
            if found is None:
                found = self.word(MARK + part)
                if len(part) <= KEPT:
                    if len(known) >= CACHED:
                        known.clear()
                    known[part] = found
            n += found[0]
            total += found[1]
        return n, total


def _count(vocabulary_path: str) -> Callable:
    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter(unigram_vocabulary(vocabulary_path))
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                found = [counter.text(t or "") for t in rows.column(1).to_pylist()]
                n, score = np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.float64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(score)], ["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, without a shuffle: id, n_tokens and the score of the best segmentation."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(vocabulary_path), f"doc_id {kind}, n_tokens long, score double").withColumnRenamed("doc_id", id_col)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
