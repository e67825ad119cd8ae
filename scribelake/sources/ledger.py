"""Run ledger and metric history: append-only tables of what was run and how it scored.

A ledger that retried jobs write to is kept by run instead: ``recent`` has a folder for each
run, which recording the run again replaces, and ``whole`` the numbered results of
compactions, of which the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.sources.files import delete_path, names_in, path_exists
from scribelake.sources.tables import DEFAULT_DIALECT, native_options

# Ledger columns in order.
LEDGER_COLUMNS = (
    "experiment_id",
    "created_at_utc",
    "stage",
    "hypothesis",
    "status",
    "dataset_version",
    "model",
    "config_path",
    "output_path",
    "local_wer",
    "local_cer",
    "local_error",
    "local_score",
    "public_score",
    "submitted",
    "notes",
)

HISTORY_COLUMNS = (
    "experiment_id",
    "created_at_utc",
    "slice",
    "value",
    "rows",
    "wer",
    "cer",
    "error",
    "score",
)


def ledger_rows(records: DataFrame) -> DataFrame:
    """Records under the ledger columns: unknown ones dropped, absent ones ''."""
    return records.select(
        *[
            (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit(""))
            .alias(c)
            for c in LEDGER_COLUMNS
        ]
    )


def append_ledger(records: DataFrame, path: str, format: str = "csv") -> None:
    """Append to the ledger, in the form that ``read_table`` reads by default.

    Each file carries the header, so readers see it once per file.
    """
    writer = ledger_rows(records).write.mode("append").format(format)
    if format == "csv":
        writer = writer.options(**native_options(DEFAULT_DIALECT)).option("quoteAll", True)
    writer.save(path)


def history_rows(sliced: DataFrame, experiment_id: Column, created_at_utc: Column) -> DataFrame:
    """One row per slice of a run, from a sliced metrics table."""
    return sliced.select(
        experiment_id.alias("experiment_id"),
        created_at_utc.alias("created_at_utc"),
        *HISTORY_COLUMNS[2:],
    )


def append_history(rows: DataFrame, path: str) -> None:
    rows.select(*HISTORY_COLUMNS).write.mode("append").parquet(path)


_STORED = ", ".join(f"{c} string" for c in LEDGER_COLUMNS)


def record_runs(records: DataFrame, path: str) -> None:
    """Enter runs in a ledger by run: recording a run again replaces what it had.

    Several records of one run in ``records`` are reduced to the last.  A run is known by
    its ``experiment_id``, which must be there.
    """
    rows = _last_of_each(ledger_rows(records))
    if not rows.where("experiment_id = ''").isEmpty():
        raise ValueError("a record without experiment_id")
    (
        # the folder is named by a digest, as ids may hold any sign
        rows.withColumn("run", F.sha2(F.col("experiment_id").cast("binary"), 256))
        .repartition("run")
        .write.partitionBy("run")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(f"{path}/recent")
    )


def _last_of_each(rows: DataFrame, age: Column | None = None) -> DataFrame:
    """One record a run: of the smallest ``age``, then the latest, then the largest in all columns.

    The choice is an aggregate, so a run recorded very often is combined in each task.
    """
    age = F.lit(0) if age is None else age
    ordered = F.struct(-age, F.col("created_at_utc"), F.struct(*LEDGER_COLUMNS))
    last = rows.groupBy("experiment_id").agg(F.max(ordered).alias("last"))
    return last.select(*(F.col(f"last.col3.{c}").alias(c) for c in LEDGER_COLUMNS))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the compactions that were finished."""
    names = (n for n in names_in(spark, f"{path}/whole") if n.startswith("version="))
    return sorted(
        int(n.split("=")[1]) for n in names if path_exists(spark, f"{path}/whole/{n}/_SUCCESS")
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Each run once: what was recorded last, compacted or not."""
    parts = []
    if versions := _versions(spark, path):
        whole = spark.read.schema(_STORED).parquet(f"{path}/whole/version={versions[-1]}")
        parts.append(whole.withColumn("age", F.lit(1)))
    if names_in(spark, f"{path}/recent"):
        recent = spark.read.schema(f"{_STORED}, run string").parquet(f"{path}/recent").drop("run")
        parts.append(recent.withColumn("age", F.lit(0)))
    if not parts:
        return spark.createDataFrame([], _STORED)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _last_of_each(both, F.col("age"))


def compact_ledger(spark: SparkSession, path: str, max_records_per_file: int = 1_000_000) -> None:
    """Bring the runs' files together; keeps the last record of each run.

    The new version counts once it is whole; only then are the files that went into it
    deleted, and older versions but the last.  A compaction that breaks in between leaves
    records in both places, which reads and the next compaction reduce to one.  Runs that
    are recorded meanwhile stand in files of other names, which are kept.
    """
    folders = [n for n in names_in(spark, f"{path}/recent") if n.startswith("run=")]
    included = [f"{n}/{file}" for n in folders for file in names_in(spark, f"{path}/recent/{n}")]
    versions = _versions(spark, path)
    new = versions[-1] + 1 if versions else 0
    writer = read_ledger(spark, path).write.option("maxRecordsPerFile", max_records_per_file)
    writer.mode("overwrite").parquet(f"{path}/whole/version={new}")
    for name in included:
        delete_path(spark, f"{path}/recent/{name}")
    for old in versions[:-1]:
        delete_path(spark, f"{path}/whole/version={old}")
