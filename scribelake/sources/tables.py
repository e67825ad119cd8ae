"""Delimited transcript tables: quoted fields, backslash escapes, embedded newlines."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.sources.files import open_stream

CORRUPT = "_corrupt_record"
_ROWS_PER_BATCH = 10_000

# How a quote inside a quoted field is written.  Spark's own reader and writer know one
# escape character at a time and mis-split the other style; ``backslash`` is the default
# of both, so that what one writes the other reads.
NATIVE_ESCAPE = {"backslash": "\\", "doubled": '"'}
DEFAULT_DIALECT = "backslash"
# columns by which the rows of a numbered table are in file order
POSITION = ("_file", "_row")


def native_options(dialect: str) -> dict[str, str]:
    """Options under which Spark's reader gives back what its writer was given."""
    if dialect not in NATIVE_ESCAPE:
        raise ValueError(f"unknown dialect {dialect!r}")
    return {
        "header": "true",
        "quote": '"',
        "escape": NATIVE_ESCAPE[dialect],
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }


def _reader(stream: io.TextIOBase) -> Iterator[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return csv.reader(stream, quotechar='"', escapechar="\\", doublequote=True)


def _open_text(path: str) -> io.TextIOWrapper:
    return io.TextIOWrapper(open_stream(path), encoding="utf-8-sig", newline="")


def header_of(path: str) -> list[str]:
    """Column names in the first line of one file."""
    with _open_text(path) as stream:
        return next(_reader(stream))


def _string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # only path and length are selected, so no content is read here
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _columns(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None) -> list[str]:
    if columns:
        return list(columns)
    first = _listing(spark, path).where("length > 0").agg(F.min("path").alias("p")).first()["p"]
    if first is None:
        raise ValueError(f"no table file under {path}")
    return header_of(first)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    *,
    dialect: str = DEFAULT_DIALECT,
    columns: Sequence[str] | None = None,
    strict: bool = True,
    multi_line: bool = True,
    numbered: bool = False,
) -> DataFrame:
    """All rows of delimited files, every column a string, blank cells NULL.

    ``backslash``, as :func:`write_table` writes, and ``doubled`` use Spark's reader.
    ``mixed`` accepts ``\\"`` and ``""`` in the same file; with ``multi_line`` it streams each
    file once, in bounded memory, without, Spark splits files and column expressions part
    the fields.  A row of too few or too many fields fails the read; with
    ``strict=False`` the native dialects keep it in a ``_corrupt_record`` column instead.

    Fields may hold newlines, so one file is one task: keep large tables in many files,
    convert them to Parquet once, or pass ``multi_line=False`` for tables without such
    fields, whose files Spark then splits.  ``numbered`` adds the columns
    ``POSITION``, which put the rows in file order.
    """
    columns = _columns(spark, path, columns)
    if dialect != "mixed":
        options = native_options(dialect)
        if numbered and not multi_line:
            raise ValueError("rows of split files cannot be numbered")
        read = (
            spark.read.schema(_string_schema([*columns] if strict else [*columns, CORRUPT]))
            .options(**options)
            .option("enforceSchema", False)
            .option("multiLine", multi_line)
        )
        if strict:
            rows = read.option("mode", "FAILFAST").csv(path)
        else:
            rows = read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
        if not numbered:
            return rows
        # a file is read by one task, from its first row to its last
        return rows.select(
            "*",
            F.col("_metadata.file_path").alias(POSITION[0]),
            F.monotonically_increasing_id().alias(POSITION[1]),
        )
    if not multi_line:
        if numbered or not strict:
            raise ValueError("lines of mixed tables are neither numbered nor kept if malformed")
        return _split_lines(spark, path, columns)
    schema = _string_schema(columns)
    arrow_schema = pa.schema([(c, pa.string()) for c in columns])
    if numbered:
        schema = schema.add(POSITION[0], T.StringType()).add(POSITION[1], T.LongType())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                done = 0
                for part in _parse_file(file, arrow_schema):
                    if numbered:
                        n = part.num_rows
                        part = part.append_column(POSITION[0], pa.array([file] * n, pa.string()))
                        part = part.append_column(POSITION[1], pa.array(range(done, done + n), pa.int64()))
                        done += n
                    yield part

    return _listing(spark, path).select("path").mapInArrow(parse, schema)


# a field after its comma: quoted, with quotes doubled or escaped inside, or plain
_FIELD = r',("(?:[^"\\]++|\\.|"")*+"|(?:[^,\\]++|\\.)*+)'
_NO_SUCH_SIGN = "\x01"


def _split_lines(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """Mixed tables of one row a line: Spark reads lines and expressions part the fields."""
    # a separator and a quote that do not occur make a line one field; headers are left out
    lines = (
        spark.read.schema("line string")
        .options(header="true", sep=_NO_SUCH_SIGN, quote="", escape="", enforceSchema="true")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    fields = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(_FIELD), F.lit(1))
    short = F.concat(F.lit(f"a row of other than {len(columns)} fields: "), F.substring("line", 1, 80))
    checked = F.when(F.size("fields") == len(columns), F.col("fields")).otherwise(F.raise_error(short))
    parted = lines.select("line", fields.alias("fields")).select(checked.alias("fields"))

    def cell(k: int) -> Column:
        raw = F.col("fields")[k]
        inner = F.when(F.startswith(raw, F.lit('"')), F.substring(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(raw)
        # of an escaped sign, and of two quotes, the second stays
        plain = F.regexp_replace(inner, F.lit(r'\\(.)|"(")'), F.lit("$1$2"))
        return F.nullif(plain, F.lit(""))

    return parted.select(*(cell(k).alias(c) for k, c in enumerate(columns)))


def _parse_file(file: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    with _open_text(file) as stream:
        rows = _reader(stream)
        header = next(rows, None)
        if header is None:
            return
        absent = [c for c in schema.names if c not in header]
        if absent:
            raise ValueError(f"{file} lacks columns {absent}")
        places = [header.index(c) for c in schema.names]
        pending: list[list[str]] = []

        def batch() -> pa.RecordBatch:
            cells = [pa.array([r[i] or None for r in pending], pa.string()) for i in places]
            return pa.record_batch(cells, schema=schema)

        for row in rows:
            if row and len(row) != len(header):
                raise ValueError(f"{file} line {rows.line_num}: {len(row)} fields")
            if row:
                pending.append(row)
            if len(pending) == _ROWS_PER_BATCH:
                yield batch()
                pending = []
        if pending:
            yield batch()


def malformed_rows(df: DataFrame) -> int:
    """Lines a native dialect, read with ``strict=False``, could not fit to the columns."""
    # a data column takes part, since the reader refuses to fill the corrupt one alone
    row = df.agg(
        F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"), F.count(df.columns[0])
    ).first()
    return row["malformed"]


def write_table(
    df: DataFrame,
    path: str,
    *,
    dialect: str = DEFAULT_DIALECT,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    single_file: bool = False,
) -> None:
    """Write a table with a header.  ``single_file`` is for small result tables."""
    if single_file:
        df = df.coalesce(1)
    writer = df.write.mode(mode).options(**native_options(dialect)).option("quoteAll", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
