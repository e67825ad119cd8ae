"""Edit distances between two texts of a row, by character and by word.

``engine="arrow"`` counts them for a batch of rows at once, bit-parallel in numpy, up to
``LONG`` characters a text; ``engine="jvm"`` is the built-in ``levenshtein``, which also takes
the longer texts of the other.  For the built-in, words are coded as one code point each.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.functions import text

# texts of more characters stay with the built-in
LONG = 1024
# pairs that are counted side by side
ROWS = 2048
# runs of characters that are cut off for the built-in where both texts begin or end with them
CUTS = (64, 32, 16, 8)
_LETTERS = string.ascii_letters + string.digits + string.punctuation


def _near_diagonal(codes, n, m, at_a, at_b, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Distances by the diagonals around those on which a pair begins and ends, if exact.

    There are as many as ``kind``, a type of unsigned words, has bits.  One word a column holds
    the differences between its cells on these diagonals and moves down by a row from column to
    column (Hyyrö 2003); no cell comes out too small.  Beside them, a path costs at least what
    reaching the next diagonal and coming back does: answers up to that are exact.  The last
    code stands for no character; pairs are in order of ``m``.
    """
    most = 8 * kind().itemsize - 1
    one, top, none = kind(1), kind(most), kind(0)
    gap, reach = n - m, np.arange(m[0] + most)
    low = np.clip((gap - most) // 2, -most, 0)
    margin = np.minimum(np.minimum(gap, 0) - low, low + most - np.maximum(gap, 0))
    at = low[:, None] + reach
    a = codes.take(np.where((at >= 0) & (at < n[:, None]), at_a[:, None] + at, len(codes) - 1))
    b = codes.take(at_b + np.arange(m[0])[:, None], mode="clip")
    up, down = (~none << (-low).astype(kind)) << one, np.zeros(len(n), kind)
    last, kept = np.clip(gap - low, 0, most).astype(kind), np.zeros(len(n), kind)
    for j, k in enumerate(np.searchsorted(-m, -np.arange(m[0]))):
        same = (a[:k, j : j + most + 1] == b[j, :k, None]).reshape(-1)
        eq = np.packbits(same, bitorder="little").view(kind)
        # the new row at the lower end grows by one from the row above
        pv, mv = (up[:k] >> one) | (one << top), down[:k] >> one
        level = (((eq & pv) + pv) ^ pv) | eq | mv
        kept[:k] += (level >> last[:k]) & one
        plus = ((mv | ~(level | pv)) << one) | one
        up[:k], down[:k] = ((pv & level) << one) | ~(level | plus), plus & level
    found = np.maximum(gap, 0) + m - kept.astype(np.int64)
    return found, (margin >= 0) & (found <= abs(gap) + 2 * (margin + 1))


def _distances(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Distances of the sequences in the first half of ``lengths`` to those in the second.

    ``codes`` holds all sequences end to end.  The bits of a column of 64-bit words are the
    differences between the cells of a column of the usual table (Myers 1999, in blocks as by
    Hyyrö 2003).  Pairs are in order of their second length, so that those with characters
    left are the first ones; bits beyond a first sequence never reach the ones below.  Most
    pairs are decided near the diagonal, by one word a column, first of 32 bits and then of 64;
    what is left of all pairs is counted side by side again.
    """
    none = int(codes.max(initial=0)) + 1
    starts, codes = np.cumsum(lengths) - lengths, np.append(codes, none).astype(np.min_scalar_type(none))
    (n, m), (at_a, at_b) = np.split(lengths, 2), np.split(starts, 2)
    out, order, one, top = np.empty(len(n), np.int32), np.argsort(-m), np.uint64(1), np.uint64(63)
    for kind in (np.uint32, np.uint64):
        # the diagonals reach from a pair's begin to its end
        near = abs(n - m)[order] < 8 * kind().itemsize
        rest = ~near
        for k in range(0, len(at := np.flatnonzero(near)), ROWS):
            rows = order[part := at[k : k + ROWS]]
            out[rows], sure = _near_diagonal(codes, n[rows], m[rows], at_a[rows], at_b[rows], kind)
            rest[part] = ~sure
        order = order[rest]
    for rows in (order[k : k + ROWS] for k in range(0, len(order), ROWS)):
        words = max(1, -(-int(n[rows].max()) // 64))
        a = codes.take(at_a[rows][:, None] + np.arange(64 * words), mode="clip")
        b = codes.take(at_b[rows] + np.arange(m[rows[0]])[:, None], mode="clip")
        up, down = np.full((words, len(rows)), ~np.uint64(0)), np.zeros((words, len(rows)), np.uint64)
        for j, column in enumerate(b):
            k = int(np.searchsorted(-m[rows], -j))
            same = np.packbits(a[:k] == column[:k, None], axis=1, bitorder="little").view(np.uint64)
            # the uppermost row of the table grows by one from column to column
            plus, minus = one, np.uint64(0)
            for w in range(words):
                pv, mv, eq = up[w, :k], down[w, :k], same[:, w]
                xv, eq = eq | mv, eq | minus
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                shifted, lowered = (ph << one) | plus, (mh << one) | minus
                plus, minus = ph >> top, mh >> top
                up[w, :k], down[w, :k] = lowered | ~(xv | shifted), shifted & xv
        # the bits that belong to the first sequence
        left = np.clip(n[rows] - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
        own = np.where(left > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(left, one)), np.uint64(0))
        change = np.bitwise_count(up & own).astype(np.int32) - np.bitwise_count(down & own)
        out[rows] = m[rows] + change.sum(axis=0)
    return out


def _of_known(a: pa.Array, b: pa.Array, coded) -> pa.Array:
    """Distances of the pairs that are not NULL, by the codes of their texts."""
    known = pc.and_(a.is_valid(), b.is_valid())
    texts = pa.concat_arrays([a.filter(known), b.filter(known)])
    at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
    out = np.zeros(len(a), np.int32)
    if len(at):
        out[at] = _distances(*coded(texts))
    return pa.array(out, mask=~known.to_numpy(zero_copy_only=False))


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points, in the smallest type that holds them, and how many each text has."""
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "")[0].as_buffer()
    codes = np.frombuffer(str(whole, "utf-8").encode("utf-32-le"), np.uint32)
    kind = np.min_scalar_type(codes.max(initial=0))
    return codes.astype(kind), pc.utf8_length(texts).to_numpy().astype(np.int64)


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and how many words each text has."""
    return _codes_of(pc.split_pattern(texts, " "))


def _codes_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    codes = words.filter(full).dictionary_encode().indices.to_numpy()
    return codes, np.bincount(of.filter(full).to_numpy(), minlength=len(lists))


@F.arrow_udf(T.IntegerType())
def _char_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return _of_known(a, b, _points)


@F.arrow_udf(T.IntegerType())
def _word_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return _of_known(a, b, _word_codes)


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("edits", "total")]))
def _raw_word_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances of texts with any whitespace between words, and the words of the first one."""
    lengths = np.zeros(0)

    def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal lengths
        codes, lengths = _codes_of(pc.utf8_split_whitespace(texts))
        return codes, lengths

    edits = _of_known(a, b, coded)
    known = edits.is_valid().to_numpy(zero_copy_only=False)
    total = np.zeros(len(a), np.int32)
    total[known] = lengths[: known.sum()]
    return pa.StructArray.from_arrays([edits, pa.array(total, mask=~known)], ["edits", "total"])


def _word_levenshtein(a: Column, b: Column) -> Column:
    """``levenshtein`` over word lists, one code point per distinct word of the pair."""

    def encode(side: Column, vocabulary: Column) -> Column:
        def point(word: Column) -> Column:
            at = F.array_position(vocabulary, word) + 255
            at = F.when(at >= 0xD800, at + 0x800).otherwise(at)  # step over the surrogates
            return F.lpad(F.hex(at), 8, "0")

        return F.decode(F.unhex(F.array_join(F.transform(side, point), "")), "UTF-32")

    def letters(side: Column, vocabulary: Column) -> Column:
        def letter(word: Column) -> Column:
            at = F.array_position(vocabulary, word).cast("int")
            return F.substr(F.lit(_LETTERS), at, F.lit(1))

        return F.array_join(F.transform(side, letter), "")

    def counted(a: Column, b: Column, v: Column) -> Column:
        short = F.levenshtein(letters(a, v), letters(b, v))
        return F.when(F.size(v) <= len(_LETTERS), short).otherwise(F.levenshtein(encode(a, v), encode(b, v)))

    # one-element transforms name the lists, then the vocabulary: each is built once per row
    lists = F.array(F.struct(a.alias("a"), b.alias("b")))
    named = F.transform(
        lists,
        lambda s: F.struct(
            s["a"].alias("a"), s["b"].alias("b"), F.array_distinct(F.concat(s["a"], s["b"])).alias("v")
        ),
    )
    return F.transform(named, lambda s: counted(s["a"], s["b"], s["v"]))[0]


def _trimmed(a: Column, b: Column) -> Column:
    """Both texts without what they begin and end with alike, which costs no edits.

    Cut in runs of ``CUTS`` characters, each tried once, so that a few comparisons do.
    """

    def cut(same, rest):
        def step(pair: Column, k: Column) -> Column:
            alike = same(pair["a"], k) == same(pair["b"], k)
            cut_pair = F.struct(rest(pair["a"], k).alias("a"), rest(pair["b"], k).alias("b"))
            return F.when(alike, cut_pair).otherwise(pair)

        return step

    cuts = F.array(*map(F.lit, CUTS))
    head = cut(F.left, lambda text, k: F.substr(text, k + 1))
    tail = cut(F.right, lambda text, k: F.left(text, F.char_length(text) - k))
    begun = F.aggregate(cuts, F.struct(a.alias("a"), b.alias("b")), head)
    return F.aggregate(cuts, begun, tail)


def _banded(a: Column, b: Column) -> Column:
    """Exact ``levenshtein`` that first tries the cells near the diagonal.

    With a limit the built-in visits only those, and answers -1 beyond it, which reads as NULL
    here, so that ``coalesce`` moves on.  What words lost or added cost shows in the lengths;
    beside that a recogniser mishears a small share of the characters, so that for most
    pairs the first call is the only one.  Equal texts need none, and the characters that both
    texts begin and end with are left out.
    """
    n, m = F.char_length(a), F.char_length(b)
    limit = (F.abs(n - m) + n / 16 + 4).cast("int")

    def counted(x: Column, y: Column) -> Column:
        # a one-element transform names the answer, so that the first call is made once per row
        tried = F.array(F.call_function("levenshtein", x, y, limit))
        near = F.transform(tried, lambda d: F.nullif(d, F.lit(-1)))[0]
        return F.coalesce(near, F.levenshtein(x, y))

    apart = F.transform(F.array(_trimmed(a, b)), lambda pair: counted(pair["a"], pair["b"]))[0]
    return F.when(a == b, F.lit(0)).otherwise(apart)


def _known(*texts: Column | str) -> list[Column]:
    return [F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in texts]


def _by_batch(a: Column, b: Column, batch) -> Column:
    """What ``batch`` says of a pair; equal and long texts do not go to Python, and get NULL."""
    sent = (a != b) & (F.greatest(F.char_length(a), F.char_length(b)) <= LONG)
    return batch(F.when(sent, a), F.when(sent, b))


def _by_engine(a: Column | str, b: Column | str, engine: str, batch, builtin) -> Column:
    a, b = _known(a, b)
    if engine != "arrow":
        return builtin(a, b)
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(_by_batch(a, b, batch), builtin(a, b)))


def char_edits(a: Column | str, b: Column | str, engine: str = "arrow") -> Column:
    """Unit-cost edit distance over code points; NULL reads as the empty text."""
    return _by_engine(a, b, engine, _char_batch, _banded)


def _builtin_words(a: Column, b: Column) -> Column:
    left, right = (F.array_remove(F.split(x, " "), "") for x in (a, b))
    return F.when(a == b, F.lit(0)).otherwise(_word_levenshtein(left, right))


def word_edits(a: Column | str, b: Column | str, engine: str = "arrow") -> Column:
    """Unit-cost edit distance over words of two texts with single-space separators."""
    return _by_engine(a, b, engine, _word_batch, _builtin_words)


def raw_word_edits(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """:func:`word_edits` of texts with any whitespace between words, and the words of the first.

    The whitespace of texts that go to Python is not read in the JVM.
    """
    a, b = _known(a, b)
    x, y = text.raw_words_text(a), text.raw_words_text(b)
    told = _by_batch(a, b, _raw_word_batch)
    edits = F.when(a == b, F.lit(0)).otherwise(F.coalesce(told["edits"], _builtin_words(x, y)))
    return edits, F.coalesce(told["total"], text.word_count(x))
