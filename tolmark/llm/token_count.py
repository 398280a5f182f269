"""Token counts: the Viterbi path of a unigram vocabulary, of which only score and number of pieces are kept.

An Aho-Corasick automaton gives all vocabulary pieces that end at a character, the longest first; the best score at the
character is the best of (score where the piece begins + its own). The tie rule is that of the tokenizers library's unigram model: it
goes through begins from left to right and only a strictly better score replaces one, so that of equals the earliest begin,
which is the longest piece, stays; a character without a piece of its own may also stand for itself at the lowest score of the vocabulary less 10,
and is considered last. Such a character counts as its bytes (byte fallback). Sums are 64-bit floats from the left.

A text is cut as the Metaspace rule does: a mark before the text and for every space, a new word at each mark; no
piece goes past a mark, and none holds a newline, so that the words' counts add up and words are counted once for each
worker. Whole texts are counted; a word of any length takes memory in proportion.

Defined results: null and empty texts have no tokens. Rows are independent: repeated rows give equal rows; an empty table
gives an empty one; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tolmark.llm._tables import arrow_type, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: What an unknown character scores less than the worst piece; a fixed value of the library.
UNKNOWN = 10.0
#: Words whose counts a worker remembers; beyond, it forgets them all.
REMEMBERED = 500_000


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file, without its control pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]


class Words(dict):
    """Counts of words, made as they are asked for."""

    def __init__(self, counter: Counter, before: str) -> None:
        self.counter, self.before = counter, before

    def __missing__(self, word: str) -> int:
        n = self.counter.path(self.before + word)[1]
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class Counter:
    def __init__(self, pieces: Sequence[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.lowest = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.alone = {p for p, _ in pieces if len(p) == 1}
        assert not any("\n" in p or MARK in p.lstrip(MARK) for p, _ in pieces)
        self.after_mark, self.bare = Words(self, MARK), Words(self, "")

    def path(self, word: str) -> tuple[float, int]:
        """Score and number of tokens of the best path."""
        size = len(word)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        ends = self.automaton.iter(word) if len(self.automaton) else iter(())
        end, found = next(ends, (size, None))
        for at in range(size):
            best, n = None, 0
            while end == at and found:
                begin = at + 1 - found[0]
                s = score[begin] + found[1]
                if best is None or s > best:
                    best, n = s, count[begin] + 1
                end, found = next(ends, (size, None))
            if word[at] not in self.alone:
                s = score[at] + self.lowest
                if best is None or s > best:
                    best, n = s, count[at] + len(word[at].encode("utf-8", "surrogatepass"))
            score[at + 1], count[at + 1] = best, n
        return score[size], count[size]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            first, *rest = line.split(" ")
            if k:
                total += 1 + self.bare[first]  # the newline is a byte of its own
            elif first or not rest:
                total += self.after_mark[first]
            total += sum(map(self.after_mark.__getitem__, rest))
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key, n_tokens. No shuffle."""
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("value"))
    schema = T.StructType([T.StructField(key, slim.schema["key"].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, c = arrow_type(schema), counter(path)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.count(t) for t in part.column(1).to_pylist()], pa.int64())], schema=to)

    return slim.mapInArrow(run, schema)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"op2_token_count": op2_token_count}
ORACLES: dict[str, str] = {}
