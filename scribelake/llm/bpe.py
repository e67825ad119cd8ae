"""Byte-level BPE, encoding and decoding.

Texts are cut at the special tokens, then into words.  Each distinct word of a
batch is encoded once, by a
*contiguous rank array*: the parts between its boundaries and the ranks of adjacent parts
lie side by side in two arrays; the smallest rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are looked up anew.  The arrays of some thousand
words of like length are rows of one matrix and advance together.  That is quadratic in
the number of parts, which is what one wants for the short words that make up text; words
of more than ``LONG_WORD`` bytes (a run of letters without spaces) keep the candidates in a
heap instead, with the same ids.

The vocabulary file is read once, by the driver, and sent to the executors; its size is
checked against ``MAX_VOCABULARY_BYTES`` first.

Defined results: NULL text is the empty text, which has no ids; a special token's string
in a text is that token; ids outside the vocabulary and NULL ids decode to nothing; bytes
that are not UTF-8 decode to the replacement character.  Other columns only pass through.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

LONG_WORD = 64
MAX_VOCABULARY_BYTES = 64 << 20
_WORDS_AT_ONCE = 8192
_CHARS_AT_ONCE = 1 << 23
_RUNS_AT_ONCE = 1 << 18
# fixed value: how the vocabulary's pre-tokeniser cuts words
_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# letters, then ASCII marks without the apostrophe, which begins contractions
_LETTERS_AND_MARKS = r"^(?P<letters>\p{L}+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_INNER_SPACE = re.compile(r" (?<=\s\s)(?!\S)")
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_NO_RANK = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in plain)
    return letters | {chr(0x100 + k): b for k, b in enumerate(others)}


class Spelling:
    """What each id stands for."""

    def __init__(self, content: bytes) -> None:
        parsed, letters = json.loads(content), _byte_letters()
        self.bytes_of = {
            i: bytes(letters[c] for c in token) for token, i in parsed["model"]["vocab"].items()
        } | {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}

    def decode(self, ids: list[int | None]) -> str:
        spelt = self.bytes_of
        return b"".join([spelt.get(i, b"") for i in ids]).decode("utf-8", errors="replace")


class Ragged(NamedTuple):
    """Many short runs of ids: run k is ``flat[first[k] : first[k] + count[k]]``."""

    flat: np.ndarray
    first: np.ndarray
    count: np.ndarray


def _both(a: Ragged, b: Ragged) -> Ragged:
    """The runs of ``a``, then those of ``b``."""
    return Ragged(
        np.concatenate([a.flat, b.flat]),
        np.concatenate([a.first, b.first + len(a.flat)]),
        np.concatenate([a.count, b.count]),
    )


def _assemble(table: Ragged, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs one after the other, and where each of them ends."""
    counts = table.count[runs]
    ends = np.cumsum(counts)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    for at in range(0, len(runs), _RUNS_AT_ONCE):
        part = slice(at, at + _RUNS_AT_ONCE)
        n, begin = counts[part], int(ends[at] - counts[at])
        within = np.arange(n.sum()) - np.repeat(ends[part] - n - begin, n)
        ids[begin : begin + len(within)] = table.flat[np.repeat(table.first[runs[part]], n) + within]
    return ids, ends


class Vocabulary:
    """The merges of a vocabulary file."""

    def __init__(self, content: bytes) -> None:
        parsed = json.loads(content)
        vocab, pairs = parsed["model"]["vocab"], parsed["model"]["merges"]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for letter, byte in _byte_letters().items():
            self.byte_ids[byte] = vocab[letter]
        #: by rank: what the pair merges into
        self.merged = np.array([vocab[left + right] for left, right in pairs], dtype=np.int64)
        numbers = np.array([(vocab[left] << 32) | vocab[right] for left, right in pairs], dtype=np.int64)
        self.pair_ranks = np.argsort(numbers)
        self.pair_numbers = numbers[self.pair_ranks]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        numbers = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_numbers, numbers), len(self.pair_numbers) - 1)
        return np.where(self.pair_numbers[at] == numbers, self.pair_ranks[at], _NO_RANK)

    # -------------------------------------------------------------- words

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, space: bool):
        """(ids, counts): the merges of words of like length, whose arrays are rows of a matrix."""
        extra = int(space)
        lengths = lengths + extra
        width = int(lengths.max())
        cols = np.arange(width)
        places = starts[:, None] + cols - extra
        inside = cols < lengths[:, None]
        ids = np.where(inside, self.byte_ids[data[np.clip(places, 0, len(data) - 1)]], -1)
        if space:
            ids[:, 0] = self.byte_ids[0x20]
        ranks = np.full((len(lengths), width), _NO_RANK, dtype=np.int64)
        both = inside[:, 1:]
        ranks[:, :-1][both] = self._rank(ids[:, :-1][both], ids[:, 1:][both])
        done, counts = np.empty((len(lengths), width), dtype=np.int32), np.empty(len(lengths), dtype=np.int64)
        rows = np.arange(len(lengths))
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            least = ranks[line, at]
            ended = least == _NO_RANK
            if ended.any():
                done[rows[ended]], counts[rows[ended]] = ids[ended], lengths[ended]
                go = ~ended
                rows, ids, ranks, lengths, at, least = (x[go] for x in (rows, ids, ranks, lengths, at, least))
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = self.merged[least]
            # delete the boundary: what lies right of it moves up by one
            right_of = cols[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(right_of, ids[:, 1:], ids[:, :-1])
            right_of = cols[None, :-1] >= at[:, None]
            ranks[:, :-1] = np.where(right_of, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, _NO_RANK
            lengths -= 1
            # refresh the ranks on both sides of the new part
            right = np.flatnonzero(at + 1 < lengths)
            ranks[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
        return done[cols < counts[:, None]], counts

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word: lowest rank first, then leftmost."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self._rank(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist()
        queue = [(r, at, ids[at], ids[at + 1]) for at, r in enumerate(rank) if r != _NO_RANK]
        heapq.heapify(queue)
        while queue:
            least, at, a, b = heapq.heappop(queue)
            nxt = right[at]
            if ids[at] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[at], ids[nxt] = int(self.merged[least]), -1
            right[at] = right[nxt]
            if right[at] < n:
                left[right[at]] = at
            for i, j in ((left[at], at), (at, right[at])):
                if i >= 0 and j < n:
                    found = int(self._rank(np.int64(ids[i]), np.int64(ids[j])))
                    if found != _NO_RANK:
                        heapq.heappush(queue, (found, i, ids[i], ids[j]))
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    def _encode_spelt(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, space: bool) -> Ragged:
        """The ids of words given as stretches of ``data``, each after a space if ``space``."""
        order = np.argsort(lengths, kind="stable")
        short = order[: np.searchsorted(lengths[order], LONG_WORD, side="right")]
        runs, counts = [np.empty(0, dtype=np.int32)], np.zeros(len(lengths), dtype=np.int64)
        for at in range(0, len(short), _WORDS_AT_ONCE):
            some = short[at : at + _WORDS_AT_ONCE]
            ids, counts[some] = self._side_by_side(data, starts[some], lengths[some], space)
            runs.append(ids)
        for k in order[len(short) :]:
            word = data[starts[k] : starts[k] + lengths[k]].tobytes()
            ids = self._long(b" " + word if space else word)
            counts[k] = len(ids)
            runs.append(ids)
        first = np.empty(len(lengths), dtype=np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return Ragged(np.concatenate(runs), first, counts)

    def _encode_cut(self, pieces: list[list[str | int]]) -> Ragged:
        """The ids of pieces given as their words; a number among them is an id already."""
        words = list({w for words in pieces for w in words if isinstance(w, str)})
        spelt = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, spelt), dtype=np.int64, count=len(spelt))
        data = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        found = self._encode_spelt(data, np.cumsum(lengths) - lengths, lengths, False)
        flat = found.flat.tolist()
        ids = {w: flat[i : i + n] for w, i, n in zip(words, found.first.tolist(), found.count.tolist())}
        runs = [[i for w in words for i in (ids[w] if isinstance(w, str) else (w,))] for words in pieces]
        count = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        flat = np.fromiter(chain.from_iterable(runs), dtype=np.int32, count=int(count.sum()))
        return Ragged(flat, np.cumsum(count) - count, count)

    # -------------------------------------------------------------- texts

    def _words(self, text: str) -> list[str | int]:
        """Words and special ids of any text."""
        if not (self.cut and self.cut.search(text)):
            return _WORDS.findall(text)
        parts = enumerate(self.cut.split(text))
        # special tokens stand at the odd places of a split
        return [w for k, s in parts for w in ([self.special[s]] if k % 2 else _WORDS.findall(s))]

    def _encode_letters(self, words: pa.StringArray) -> Ragged:
        """The ids of words of letters, each with a space before it."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        if not len(distinct):
            return Ragged(np.empty(0, dtype=np.int32), *np.empty((2, 0), dtype=np.int64))
        ends = np.frombuffer(distinct.buffers()[1], dtype=np.int32)[: len(distinct) + 1].astype(np.int64)
        data = np.frombuffer(distinct.buffers()[2], dtype=np.uint8)
        found = self._encode_spelt(data, ends[:-1], np.diff(ends), True)
        at = coded.indices.to_numpy()
        return Ragged(found.flat, found.first[at], found.count[at])

    def _encode_pieces(self, pieces: pa.StringArray) -> Ragged:
        """The ids of distinct pieces, each with a space before it.

        Most are letters, or letters and then marks other than apostrophes, which are words
        of their own; only what is left has to be cut by the general rule.
        """
        parts = pc.extract_regex(pieces, _LETTERS_AND_MARKS)
        words, marks = pc.struct_field(parts, "letters"), pc.struct_field(parts, "marks")
        fits = pc.fill_null(pc.utf8_is_alpha(words), False).to_numpy(zero_copy_only=False)
        chosen = pa.array(fits)
        word_ids = self._encode_letters(words.filter(chosen))
        marked = marks.filter(chosen).dictionary_encode()
        mark_ids = self._encode_cut([_WORDS.findall(m) for m in marked.dictionary.to_pylist()])
        runs = np.stack([np.arange(fits.sum()), fits.sum() + marked.indices.to_numpy()], axis=1).ravel()
        flat, ends = _assemble(_both(word_ids, mark_ids), runs)
        ends = np.concatenate([[0], ends[1::2]])
        one = Ragged(flat, ends[:-1], np.diff(ends))
        rest = self._encode_cut([_WORDS.findall(" " + p) for p in pieces.filter(pa.array(~fits)).to_pylist()])
        table = _both(one, rest)
        order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
        first, count = np.empty(len(pieces), dtype=np.int64), np.empty(len(pieces), dtype=np.int64)
        first[order], count[order] = table.first, table.count
        return Ragged(table.flat, first, count)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, one after the other, and where each text ends.

        A word may begin with a space and holds no other, so every space begins a piece,
        except inside or at the end of white space.  Texts with such spaces or with special
        tokens are cut as a whole, of others only what precedes the first space.
        """
        heads, rests = [], []
        for text in texts:
            whole = _INNER_SPACE.search(text) or (self.cut and self.cut.search(text))
            head, space, rest = (text, "", "") if whole else text.partition(" ")
            heads.append(self._words(head))
            rests.append(rest if space else None)
        head_ids = self._encode_cut(heads)
        split = pc.split_pattern(pa.array(rests, pa.string()), " ")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())
        coded = split.flatten().dictionary_encode()
        piece_ids = self._encode_pieces(coded.dictionary)
        table = _both(piece_ids, head_ids)
        # the runs of all texts: a head, then its pieces
        places = np.arange(len(texts)) + np.concatenate([[0], ends[:-1]]).astype(np.int64)
        runs = np.empty(len(texts) + len(coded), dtype=np.int32)
        is_piece = np.ones(len(runs), dtype=bool)
        is_piece[places] = False
        runs[places] = len(coded.dictionary) + np.arange(len(texts))
        runs[is_piece] = coded.indices.to_numpy()
        ids, run_ends = _assemble(table, runs)
        return ids, run_ends[np.append(places[1:], len(runs)) - 1]


def segments(text: str) -> Iterator[str]:
    """A text in pieces of little over ``_CHARS_AT_ONCE``, cut where words are cut anyway.

    That is before a space between two characters that are none; where a text has no such
    place it stays whole.
    """
    at = 0
    while len(text) - at > _CHARS_AT_ONCE and (cut := _SEAM.search(text, at + _CHARS_AT_ONCE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_all(vocabulary: Vocabulary, texts: pa.Array) -> pa.ListArray:
    """The ids of each text, NULL as empty, worked on some millions of characters at a time."""
    ids, ends, some, last, size, total = [], [], [], [], 0, 0
    spaced = any(c.isspace() for token in vocabulary.special for c in token)

    def flush() -> int:
        flat, stops = vocabulary.encode(some)
        ids.append(flat)
        ends.append(stops[np.array(last, dtype=np.int64)] + total)
        return total + len(flat)

    for text in texts:
        text = text.as_py() or ""
        pieces = [text] if spaced else list(segments(text))
        for k, piece in enumerate(pieces, 1):
            some.append(piece)
            size += len(piece)
            if k == len(pieces):
                last.append(len(some) - 1)
            if size >= _CHARS_AT_ONCE:
                total, some, last, size = flush(), [], [], 0
    if some:
        flush()
    offsets = np.concatenate([[0], *ends]).astype(np.int32)
    values = np.concatenate([np.empty(0, dtype=np.int32), *ids])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def read_vocabulary(spark: SparkSession, path: str):
    """The file's content as a broadcast variable; ``path`` is a local file of the driver."""
    if (size := os.path.getsize(path)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary file of {size} bytes is above {MAX_VOCABULARY_BYTES}")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def decode_all(spelling: Spelling, ids: pa.ListArray) -> pa.StringArray:
    return pa.array([spelling.decode(i.as_py() or []) for i in ids], type=pa.string())


Make = Callable[[], Callable[[pa.Array], list[pa.Array]]]


def _with_columns(df: DataFrame, source: str, columns: list[StructField], make: Make) -> DataFrame:
    """``df`` with further columns made from the Arrow array of ``source``, batch by batch."""
    place, names = df.columns.index(source), [c.name for c in columns]
    # Spark tells names apart without regard to case
    kept = [k for k, c in enumerate(df.columns) if c.lower() not in {n.lower() for n in names}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for batch in batches:
            before = [batch.column(k) for k in kept]
            yield pa.RecordBatch.from_arrays(
                [*before, *made(batch.column(place))],
                names=[*(batch.schema.names[k] for k in kept), *names],
            )

    return df.mapInArrow(run, StructType([*(df.schema.fields[k] for k in kept), *columns]))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its whole texts; a column named ``ids_col``, in any case, is replaced."""
    content = read_vocabulary(docs.sparkSession, path)

    def make():
        vocabulary = Vocabulary(content.value)
        return lambda texts: [encode_all(vocabulary, texts)]

    return _with_columns(docs, text_col, [StructField(ids_col, ArrayType(IntegerType()))], make)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of its ids; a column named ``text_col`` is replaced."""
    content = read_vocabulary(docs.sparkSession, path)

    def make():
        spelling = Spelling(content.value)
        return lambda ids: [decode_all(spelling, ids)]

    return _with_columns(docs, ids_col, [StructField(text_col, StringType())], make)


def round_trip(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """``docs`` with its ids and what these decode to, in one pass through the same workers."""
    content = read_vocabulary(docs.sparkSession, path)

    def make():
        vocabulary, spelling = Vocabulary(content.value), Spelling(content.value)

        def both(texts: pa.Array) -> list[pa.Array]:
            ids = encode_all(vocabulary, texts)
            return [ids, decode_all(spelling, ids)]

        return both

    columns = [
        StructField(ids_col, ArrayType(IntegerType())),
        StructField(decoded_col, StringType()),
    ]
    return _with_columns(docs, text_col, columns, make)


def ids_text(ids: str) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
