"""Column roles: which column of a table holds the id, the text, the audio, the language."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted column names per role, in order of preference.
ROLE_NAMES: dict[str, tuple[str, ...]] = {
    "text": (
        "transcription",
        "sentence",
        "text",
        "normalized_text",
        "target",
        "prediction",
        "predicted",
        "transcript",
        "label",
    ),
    "id": ("ID", "id", "uid", "audio_id", "file_id", "path"),
    "audio": ("audio", "speech", "path", "file", "audio_path"),
    "language": ("language", "lang", "locale", "config"),
}

# Languages used when a caller names none.
DEFAULT_LANGUAGES = ("lin", "sna", "lug")


class MissingColumnError(ValueError):
    """A table lacks a column that a job needs."""


def find_role(columns: Iterable[str], role: str) -> str | None:
    """Best column for ``role``: the earliest accepted name, then the exact spelling.

    Of columns that fit equally well, differing in case only, the first one is taken.
    """
    rank = {name.lower(): place for place, name in reversed(list(enumerate(ROLE_NAMES[role])))}
    exact = set(ROLE_NAMES[role])
    fitting = [
        (rank[c.lower()], c not in exact, at, c)
        for at, c in enumerate(map(str, columns))
        if c.lower() in rank
    ]
    return min(fitting)[-1] if fitting else None


def need_role(columns: Iterable[str], role: str) -> str:
    columns = list(columns)
    match = find_role(columns, role)
    if match is None:
        raise MissingColumnError(f"no {role} column among {columns}")
    return match


def need_columns(columns: Iterable[str], required: Iterable[str], table: str = "table") -> None:
    absent = sorted(set(required).difference(columns))
    if absent:
        raise MissingColumnError(f"{table} lacks required columns {absent}")


def pick(df: DataFrame, *columns: tuple[str, str, bool]) -> DataFrame:
    """Select ``(source, target, as_string)`` triples by position.

    Going by position lets a table hold both ``ID`` and ``id``, which a lookup by
    name rejects as ambiguous unless the session is case sensitive.
    """
    names = df.columns
    if len({n.lower() for n in names}) < len(names):
        df = df.toDF(*[f"c{i}" for i in range(len(names))])
        lookup = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    else:
        lookup = {n: F.col(f"`{n}`") for n in names}
    return df.select(
        *[
            (lookup[src].cast("string") if as_string else lookup[src]).alias(dst)
            for src, dst, as_string in columns
        ]
    )


def canonical(
    df: DataFrame,
    *,
    id: str | None = "id",
    text: str | None = None,
    language: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project a table to its roles, as strings, under the names given.

    ``canonical(t, text="reference_text")`` yields ``id, reference_text``.  A
    language that the table does not have is left out; other roles raise.
    """
    wanted: list[tuple[str, str, bool]] = []
    if id:
        wanted.append((need_role(df.columns, "id"), id, True))
    if text:
        wanted.append((need_role(df.columns, "text"), text, True))
    if language:
        found = find_role(df.columns, "language")
        if found:
            wanted.append((found, language, True))
    wanted += [(name, name, False) for name in keep]
    return pick(df, *wanted)


def languages_or_default(languages: Iterable[str] | None) -> list[str]:
    """Trimmed, non-blank language codes; the default list if nothing remains."""
    cleaned = [code.strip() for code in languages or ()]
    return [code for code in cleaned if code] or list(DEFAULT_LANGUAGES)


def bytes_present(df: DataFrame, audio: str, *, read_bytes: bool = False) -> Column:
    """Whether an audio struct carries its bytes, by the flag stored at ingest.

    A struct with bytes but without flag is refused, since testing the ``bytes`` field
    makes the scan read that (very large) column; ``read_bytes`` allows it.
    """
    field = df.schema[audio].dataType
    names = getattr(field, "names", None)
    if names and "bytes_present" in names:
        return F.coalesce(F.col(f"{audio}.bytes_present"), F.lit(False))
    if names and "bytes" in names:
        if not read_bytes:
            raise MissingColumnError(f"{audio} holds bytes but no bytes_present flag")
        return F.col(f"{audio}.bytes").isNotNull()
    return F.lit(False)


def audio_pointer(df: DataFrame, audio: str, *, read_bytes: bool = False) -> Column:
    """``{path, bytes_present}`` for an audio struct, or for a plain path column."""
    names = getattr(df.schema[audio].dataType, "names", None)
    if names is None:
        path = F.col(audio).cast("string")
    elif "path" in names:
        path = F.col(f"{audio}.path").cast("string")
    else:
        path = F.lit(None).cast("string")
    return F.struct(path.alias("path"), bytes_present(df, audio, read_bytes=read_bytes).alias("bytes_present"))
