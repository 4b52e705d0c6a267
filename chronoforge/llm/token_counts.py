"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary enumerates all pieces that end at each character of a word;
dynamic programming carries the best score and its number of pieces, never the pieces. The
rules are those of the ``tokenizers`` library's unigram model with byte fallback: of equal scores the
longest last piece wins; a character that is no piece costs 10 below the least score, and counts
as many pieces as it has UTF-8 bytes. Words are what the Metaspace pre-tokenizer makes: the
text split before each space, with one mark put in front of the text.

The vocabulary is a parameter (a sentencepiece model file, pieces and scores as they stand there); here it is the
public 32k vocabulary. Counts of words are cached per worker process, in a cache of fixed size.

Cases: null and empty text have 0 tokens; texts of any length are counted whole; repeated rows are
repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter(dict):
    """word -> (pieces, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = MARK + word
        found: list[list] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            found[end].append(match)
        scores, counts = [0.0], [0]
        for end, matches in enumerate(found):
            best, pieces, single = None, 0, False
            for length, score in sorted(matches, reverse=True):  # longest first
                single |= length == 1
                total = scores[end + 1 - length] + score
                if best is None or total > best:
                    best, pieces = total, counts[end + 1 - length] + 1
            if not single:
                total = scores[end] + self.unknown
                if best is None or total > best:
                    best, pieces = total, counts[end] + len(text[end].encode("utf-8", "surrogatepass"))
            scores.append(best)
            counts.append(pieces)
        self[word] = out = (counts[-1], scores[-1])
        return out

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(MARK, " ").split(" ")
        if len(words) > 1 and not words[0]:
            del words[0]
        got = list(map(self.__getitem__, words))
        return sum(n for n, _ in got), sum(s for _, s in got)


@cache
def counter_of(path: str) -> Counter:
    """One per worker process, which Spark uses for many tasks."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation)."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            got = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
