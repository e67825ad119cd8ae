"""Text expressions.  All but the Unicode forms are evaluated in the JVM."""

from __future__ import annotations

import string
import unicodedata
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What normalisation turns into a space.
PUNCTUATION = string.punctuation
CURLY_APOSTROPHE = "’"
# Every whitespace character, by rule; the last one lies at U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_TO_SPACE = PUNCTUATION + CURLY_APOSTROPHE + WHITESPACE
_PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"
_UNICODE_NORMALIZER = "com.ibm.icu.text.Normalizer"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(text: Column | str) -> Column:
    """True when every character takes one byte."""
    return F.octet_length(_col(text)) == F.char_length(_col(text))


def _of_batch(texts: pa.Array, form: str) -> pa.Array:
    """The form of each text; NULLs, and texts already in it, come back as they are.

    All texts of the batch that are not in the form yet are normalised in one call.
    """
    rows = texts.to_pylist()
    todo = [k for k, t in enumerate(rows) if t is not None and not unicodedata.is_normalized(form, t)]
    if not todo:
        return texts
    # a line feed takes no part in any composition
    spans = [rows[k].count("\n") + 1 for k in todo]
    lines = iter(unicodedata.normalize(form, "\n".join(rows[k] for k in todo)).split("\n"))
    for k, n in zip(todo, spans):
        rows[k] = "\n".join(islice(lines, n))
    return pa.array(rows, pa.string())


@F.arrow_udf(T.StringType())
def _nfkc_batch(text: pa.Array) -> pa.Array:
    return _of_batch(text, "NFKC")


@F.arrow_udf(T.StringType())
def _nfd_batch(text: pa.Array) -> pa.Array:
    return _of_batch(text, "NFD")


def unicode_form(text: Column | str, form: str, engine: str = "arrow") -> Column:
    """NFKC or NFD of a non-null string.

    Spark has no such function.  ``engine="arrow"`` is a vectorised Python function that
    gets NULL for ASCII rows, which need no change; to the optimiser it is like any other
    function, so filters on other columns still reach the scan.  ``engine="jvm"`` calls
    the Unicode library Spark ships for its collations: rows stay in the JVM, but Spark
    takes such calls for non-deterministic, so filters stop at them, and they cannot
    stand in aggregates, joins or windows.
    """
    text = _col(text)
    if engine == "arrow":
        batch = _nfkc_batch if form == "NFKC" else _nfd_batch
        return F.coalesce(batch(F.when(~is_ascii(text), text)), text)
    method, compatibility = ("compose", True) if form == "NFKC" else ("decompose", False)
    converted = F.java_method(
        F.lit(_UNICODE_NORMALIZER), F.lit(method), text, F.lit(compatibility)
    )
    return F.when(is_ascii(text), text).otherwise(converted)


def squeeze(text: Column, to_space: str) -> Column:
    """Turn each listed character into a space, then collapse and trim spaces."""
    spaced = F.translate(text, to_space, " " * len(to_space))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def _folded(text: Column | str, engine: str) -> Column:
    return F.lower(unicode_form(F.coalesce(_col(text).cast("string"), F.lit("")), "NFKC", engine))


def normalise(text: Column | str, *, strip_accents: bool = False, engine: str = "arrow") -> Column:
    """NULL to '', NFKC, lower case, punctuation to space, single spaces, trimmed."""
    folded = _folded(text, engine)
    if strip_accents:
        folded = F.regexp_replace(unicode_form(folded, "NFD", engine), r"\p{Mn}+", "")
    return squeeze(folded, _TO_SPACE)


def clean_prediction(text: Column | str, engine: str = "arrow") -> Column:
    """Clean-up of recogniser output before it is stored; accents are kept."""
    return normalise(text, strip_accents=False, engine=engine)


def raw_words_text(text: Column | str) -> Column:
    """The text with whitespace runs made single spaces: words of un-normalised text."""
    return squeeze(F.coalesce(_col(text), F.lit("")), WHITESPACE)


def words(normalised: Column | str) -> Column:
    """Words of normalised text; the empty text has none."""
    return F.array_remove(F.split(_col(normalised), " "), "")


def normalised_words(text: Column | str, engine: str = "arrow") -> Column:
    """:func:`words` of the :func:`normalise` form, whose spaces need not be collapsed first."""
    return words(F.translate(_folded(text, engine), _TO_SPACE, " " * len(_TO_SPACE)))


def tokens(normalised: Column | str) -> Column:
    """Runs of letters and digits of any script, from normalised text."""
    letters = F.regexp_replace(_col(normalised), r"[^\p{L}\p{N}_ ]+", " ")
    return words(letters)


def word_count(normalised: Column | str) -> Column:
    """Number of words, from the spaces between them, without building the words."""
    text = _col(normalised)
    gaps = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(gaps + 1)


def occurrences(text: Column, char: str) -> Column:
    """How often one ASCII character occurs; NULL text counts none."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))
    return F.coalesce(removed, F.lit(0))


def comma_count(raw: Column | str) -> Column:
    return occurrences(_col(raw), ",")


def quote_count(raw: Column | str) -> Column:
    return occurrences(_col(raw), '"')


def apostrophe_count(raw: Column | str) -> Column:
    return occurrences(_col(raw), "'")


def digit_count(raw: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_col(raw), F.lit(r"\p{Nd}")), F.lit(0))


def punctuation_count(raw: Column | str) -> Column:
    """ASCII punctuation marks in the raw text.

    ``translate`` deletes them and the byte lengths are compared, which is several
    times faster than counting regular-expression matches.
    """
    raw = _col(raw)
    kept = F.translate(raw, PUNCTUATION, "")
    return F.coalesce(F.octet_length(raw) - F.octet_length(kept), F.lit(0))


def length_bucket(word_total: Column | str) -> Column:
    """Bucket of a reference length in words."""
    n = _col(word_total)
    # Bucket edges and names.
    return (
        F.when(n <= 5, "00_05").when(n <= 10, "06_10").when(n <= 20, "11_20").otherwise("21_plus")
    )


def id_prefix(value: Column | str) -> Column:
    """Part before the first underscore; empty when there is none (profile form)."""
    text = _col(value).cast("string")
    return F.when(F.contains(text, F.lit("_")), F.substring_index(text, "_", 1)).otherwise("")


def id_group(value: Column | str) -> Column:
    """Part before the first underscore; the whole id when there is none (validation form)."""
    return F.substring_index(_col(value).cast("string"), "_", 1)


def slug(value: Column | str) -> Column:
    """Lower-case letters and digits, every other run one underscore; never empty."""
    joined = F.regexp_replace(F.lower(_col(value)), r"[^\p{L}\p{N}]+", "_")
    trimmed = F.trim(joined, F.lit("_"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("experiment")).otherwise(trimmed)


def _in_utc(moment: Column | str) -> Column:
    """The wall clock of a timestamp in UTC, whatever the session time zone."""
    return F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), _col(moment).cast("timestamp").cast("timestamp_ntz")
    )


def run_id(name: Column | str, started: Column | str) -> Column:
    """``yyyymmdd_hhmmss_slug`` in UTC."""
    return F.concat_ws("_", F.date_format(_in_utc(started), "yyyyMMdd_HHmmss"), slug(name))


def utc_text(moment: Column | str) -> Column:
    """ISO seconds in UTC with a trailing ``Z``."""
    return F.date_format(_in_utc(moment), "yyyy-MM-dd'T'HH:mm:ss'Z'")
