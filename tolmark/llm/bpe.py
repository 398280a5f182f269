"""BPE encoding and decoding with tree concatenation.

A text is taken unsplit: it is cut in halves, quarters and so on down to blocks of at most BLOCK characters, wherever that falls.
The blocks are encoded on their own and concatenated up the tree. Around each join a window of w pieces on either side is encoded
anew, and w doubles until the window's first piece is the left half's piece there and its last piece is the right half's; then every
piece is one that a scan of the whole text gives. A piece that no rule splits (hundreds of letters or signs in a row) goes through
the same tree one level below: blocks of PIECE_BLOCK symbols are merged on their own, in parallel, and windows of w tokens are merged
anew until both sides agree. Then every neighbouring pair of tokens is one that the merges yield themselves, which makes the whole
sequence the one that encoding in one go gives.

White space is a sure cut, so a text of more than SEGMENT characters is worked off in segments that end at white space. Characters
outside the alphabet on which this module's split rule is known to agree with the library's (see _alphabet) are left to the
library's own normaliser and splitter, one chunk between white space at a time.

Defined results: null text counts as empty; an empty text has no tokens, and both digests are those of the empty
string. Special tokens' strings in a text become the special ids, as the tokenizers library does by default. Rows are
independent of each other: repeated rows give equal rows, an empty table gives an empty one, very long texts give all their
tokens, and columns other than key and text are not read. A file whose normaliser, splitter or model is of another shape than the
one described in TreeBPE is refused with ValueError.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tolmark.llm._tables import arrow_type, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Leaves of a text's tree, in characters, and of an unsplit piece's, in symbols.
BLOCK, PIECE_BLOCK = 1024, 256
#: Longer texts are worked off in segments of about so many characters.
SEGMENT = 1 << 20
#: Pieces whose tokens a worker remembers, in each of two generations: when the young one is full, it becomes the old one.
REMEMBERED = 150_000


def join_halves(left: list[int], right: list[int], encode: Callable[[str], list[int]], text: Callable[[list[int]], str], window: int = 4) -> list[int]:
    """The tokens of the two halves' concatenated text."""
    w = window
    while True:
        a, b = min(w, len(left)), min(w, len(right))
        middle = encode(text(left[len(left) - a :] + right[:b]))
        open_left = a == len(left) or middle[0] == left[len(left) - a]
        open_right = b == len(right) or middle[-1] == right[b - 1]
        if open_left and open_right:
            return left[: len(left) - a] + middle + right[b:]
        w *= 2


def join_pieces(text: str, low: int, at: int, high: int, left: list[str], right: list[str], split: Callable[[str, int, int], list[str]], window: int = 2) -> list[str]:
    """The pieces of text[low:high] from those of text[low:at] and text[at:high].

    A piece at a boundary depends on at most two characters after its first, hence on no more than the next two pieces: a
    window of two is the least from which the left side's earlier pieces are settled.
    """
    w = window
    while True:
        i, j = max(len(left) - w, 0), min(w, len(right))
        a, b = at, at
        for piece in reversed(left[i:]):
            a = text.rindex(piece, low, a)
        for piece in right[:j]:
            b = text.index(piece, b, high) + len(piece)
        middle = split(text, a, b)
        if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
            return left[:i] + middle + right[j:]
        w *= 2


@cache
def _alphabet() -> dict[str, str]:
    """Characters by kind, as contents of a regular expression's class: L, N, s (white space) and other.

    Only blocks that have long been stable, whose characters are their own canonical composition next to each other, and
    which are lower-cased one by one to another one of them.
    """
    kinds: dict[str, list[str]] = {"L": [], "N": [], "s": [], "other": []}
    for low, high in ((1, 0x180), (0x400, 0x460), (0x2010, 0x2028), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)):
        for c in map(chr, range(low, high)):
            if c != "İ":  # its lower case is two characters
                category = unicodedata.category(c)
                kind = "s" if c in "\t\n\v\f\r \x85\xa0" else category[0] if category[0] in "LN" else "other"
                kinds[kind].append(c)
    return {k: _ranges(v) for k, v in kinds.items()}


def _ranges(characters: list[str]) -> str:
    out, codes = [], sorted(map(ord, characters))
    start = 0
    for k in range(1, len(codes) + 1):
        if k == len(codes) or codes[k] != codes[k - 1] + 1:
            out.append(f"\\u{codes[start]:04x}-\\u{codes[k - 1]:04x}")
            start = k
    return "".join(out)


def _letters_of_bytes() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class TreeBPE:
    """Encoder and decoder for a tokenizers file: NFC, white space to one space and lower case; split by one pattern whose matches
    are the pieces; byte letters; BPE with a word end."""

    def __init__(self, path: str = VOCABULARY, block: int | None = None, threads: int = 2) -> None:
        """block: the leaves of both trees; by default BLOCK characters and PIECE_BLOCK symbols."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = self._pattern(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Whole words, and parts of words, which have no word end. As merges are by the pair of tokens, the last character alone differs.
        self.whole = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.end, cache_capacity=0))
        self.part = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.names = [names[i] for i in range(len(names))]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.block, self.piece_block, self.threads = block or BLOCK, block or PIECE_BLOCK, threads
        kinds = _alphabet()
        self.split = re.compile(pattern.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", kinds["s"])).findall
        self.foreign = re.compile(f"[^{''.join(kinds.values())}]").search
        self.letters = _letters_of_bytes()
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    @staticmethod
    def _pattern(spec: dict) -> str:
        """The split pattern; ValueError if the file is not of the shape that this class encodes."""
        try:
            normal, cuts = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
            shape = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            shape = shape and normal[1]["pattern"] == {"Regex": r"\s+"} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            pattern = cuts[0]["pattern"]["Regex"]
            # what join_pieces' least window rests on: short fixed strings, and runs of one class each
            runs = r"\[(?:\^|\\s|\\p\{[LN]\})+\]\+?"
            shape = shape and all(re.fullmatch(rf"{runs}|[^\\\[\]()*+?{{}}]{{1,3}}", p) for p in pattern.split("|"))
            model = spec["model"]
            shape = shape and model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
            shape = shape and all(a["content"].startswith("<|") and not (a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]) for a in spec["added_tokens"])
        except (KeyError, TypeError, IndexError):
            shape = False
        if not shape:
            raise ValueError("not a BPE file with word ends, lower case and one split pattern")
        return pattern

    # Pieces of a text.

    def pieces(self, text: str) -> list[str]:
        """The pieces of a lower-cased text in the known alphabet, by its tree."""
        level = [(a, min(a + self.block, len(text))) for a in range(0, len(text), self.block)]
        parts = [(a, b, self.split(text, a, b)) for a, b in level]
        while len(parts) > 1:
            joined = [(x[0], y[1], join_pieces(text, x[0], y[0], y[1], x[2], y[2], self.split) if x[2] and y[2] else x[2] + y[2]) for x, y in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][2] if parts else []

    def _foreign(self, text: str) -> list[str]:
        """The pieces of a text with unusual characters: the library splits the chunks that hold them."""
        out: list[str] = []
        # str.split() also cuts at four control characters that the tokenizer doesn't count as white space
        for chunk in text.split() if not re.search("[\x1c-\x1f]", text) else re.split(r"[\t\n\v\f\r ]+", text):
            if not chunk:
                continue
            if not self.foreign(chunk):
                out += self.pieces(chunk.lower())
            else:
                out += ["\0" + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        return out

    def segments(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pieces, and special ids. A piece that starts with NUL is in byte letters already."""
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield self.special[part]
                continue
            a = 0
            while a < len(part):
                b = a + SEGMENT
                if b < len(part):
                    found = re.compile(r"[\t\n\v\f\r ]").search(part, b)
                    b = found.start() if found else len(part)
                segment = part[a:b] if a or b < len(part) else part
                yield self._foreign(segment) if self.foreign(segment) else self.pieces(segment.lower())
                a = b

    # Tokens of a piece.

    def _block(self, text: str) -> list[int]:
        """Tokens of part of a piece, which may carry the word end."""
        if text.endswith(self.end):
            return self.whole.encode(text[: -len(self.end)], add_special_tokens=False).ids
        return self.part.encode(text, add_special_tokens=False).ids

    def _text(self, ids: list[int]) -> str:
        return "".join([self.names[i] for i in ids])

    def tree(self, piece: str) -> list[int]:
        """Tokens of one unsplit piece, in byte letters."""
        level = [piece[s : s + self.piece_block] for s in range(0, len(piece), self.piece_block)]
        level[-1] += self.end
        with ThreadPoolExecutor(self.threads) as pool:
            parts = list(pool.map(self._block, level))
            while len(parts) > 1:
                pairs = [parts[k : k + 2] for k in range(0, len(parts), 2)]
                parts = list(pool.map(lambda p: p[0] if len(p) == 1 else join_halves(*p, self._block, self._text), pairs))
        return parts[0]

    def byte_letters(self, piece: str) -> str:
        if piece[0] == "\0" and len(piece) > 1:
            return piece[1:]
        return piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.letters)

    def _known(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[str, str]]:
        """Ids and names, each joined by spaces, of all these pieces (and others)."""
        wanted = set(pieces)
        if self.young and len(self.young) + len(wanted) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, new = self.young, []
        for p in wanted:
            if p not in young:
                found = self.old.get(p)
                if found is None:
                    new.append(p)
                else:
                    young[p] = found
        short = []
        for p in new:
            letters = self.byte_letters(p)
            if len(letters) > self.piece_block:
                young[p] = self._known(self.tree(letters))
            else:
                short.append((p, letters))
        for (p, _), found in zip(short, self.whole.encode_batch_fast([w for _, w in short], add_special_tokens=False)):
            young[p] = self._known(found.ids)
        return young

    def forget(self) -> None:
        self.young, self.old = {}, {}

    # Texts.

    def batch(self, texts: Iterable[str | None], at_once: int = 100_000) -> Iterator[Iterator[tuple[str, str]]]:
        """For each text its segments' ids and names, joined by spaces; to be read in order."""
        waiting: list[list[list[str] | int]] = []
        held = 0

        def told() -> Iterator[Iterator[tuple[str, str]]]:
            known = self.learn(chain.from_iterable(s for segments in waiting for s in segments if not isinstance(s, int)))
            for segments in waiting:
                yield (self._joined(s, known) for s in segments)

        for text in texts:
            if text and len(text) > SEGMENT:
                yield from told()
                waiting, held = [], 0
                yield (self._joined(s, self.learn(s) if not isinstance(s, int) else {}) for s in self.segments(text))
                continue
            segments = list(self.segments(text)) if text else []
            waiting.append(segments)
            held += sum(len(s) for s in segments if not isinstance(s, int))
            if held >= at_once:
                yield from told()
                waiting, held = [], 0
        yield from told()

    def _joined(self, segment: list[str] | int, known: dict[str, tuple[str, str]]) -> tuple[str, str]:
        if isinstance(segment, int):
            return str(segment), self.names[segment]
        found = [known[p] for p in segment]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.both(text)[0].split()))

    def decode(self, ids: Sequence[int]) -> str:
        """As the library decodes without a decoder: the tokens' names with a space between."""
        return " ".join([self.names[i] for i in ids])

    def both(self, text: str | None) -> tuple[str, str, int]:
        """The ids as decimals joined by spaces, the text that decode() gives for them, and their number."""
        parts = [p for p in next(self.batch([text])) if p[0]]
        ids = " ".join([p[0] for p in parts])
        return ids, " ".join([p[1] for p in parts]), ids.count(" ") + 1 if ids else 0


_coders: dict[tuple, TreeBPE] = {}


def coder(path: str, block: int | None = None) -> TreeBPE:
    """One for each Python worker."""
    if (path, block) not in _coders:
        _coders[path, block] = TreeBPE(path, block)
    return _coders[path, block]


def _ids(parts: Iterator[tuple[str, str]]) -> tuple:
    return (np.concatenate([np.empty(0, np.int32), *(np.fromstring(ids, np.int32, sep=" ") for ids, _ in parts)]),)


def _digests(parts: Iterator[tuple[str, str]]) -> tuple:
    n, made = 0, (hashlib.sha256(), hashlib.sha256())
    for part in parts:
        if part[0]:
            for h, s in zip(made, part):
                h.update((" " + s if n else s).encode())
            n += part[0].count(" ") + 1
    return n, made[0].hexdigest(), made[1].hexdigest()


def _mapped(df: DataFrame, key: str, column: str, fields: list[T.StructField], rows: Callable[[TreeBPE, list], Iterable[tuple]], path: str, block: int | None = None) -> DataFrame:
    slim = df.select(F.col(key).alias("key"), F.col(column).alias("value"))
    schema = T.StructType([T.StructField(key, slim.schema["key"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, c = arrow_type(schema), coder(path, block)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                made = list(rows(c, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip(zip(*made), list(to)[1:]))], schema=to)
        c.forget()  # the worker lives on, and later stages need its memory

    return slim.mapInArrow(run, schema)


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY, block: int | None = None) -> DataFrame:
    """key, ids (array of int). No shuffle."""
    return _mapped(df, key, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda c, values: map(_ids, c.batch(values)), path, block)


def decode(df: DataFrame, key: str, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """key, text: as the library's decode(ids, skip_special_tokens=False)."""
    return _mapped(df, key, ids, [T.StructField("text", T.StringType())], lambda c, values: ((c.decode(v or []),) for v in values), path)


def encode_digest(df: DataFrame, key: str, text: str, path: str = VOCABULARY, block: int | None = None) -> DataFrame:
    """encode and decode in one pass, of which only number and digests leave the worker: key, n_tokens, ids_sha256, decoded_sha256."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, key, text, fields, lambda c, values: map(_digests, c.batch(values)), path, block)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
