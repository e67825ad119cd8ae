"""Batch prediction that a restart continues.

Rows are dealt to chunks by a hash of their id.  Chunks are predicted in waves; when a wave
is stored, its chunks are entered in a list of what is done, and only what that list names
counts.  A restart anti-joins the rows with the ids that are done, so it predicts what
a broken run left over, and rows that have been added since, and nothing twice.

Folder            Content
----------------  ------------------------------------------------------------------
``predictions``   by ``chunk`` and ``take``, the number of times the chunk was done before
``done``          one row for each take of a chunk that is whole: chunk, take, run, rows,
                  and of how many chunks it is one

A wave that breaks leaves files that no entry names.  The next run writes the same take of
the same chunk anew, replacing them (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.operators import predict as P
from scribelake.operators.ids import IncompleteError, counts_by_id, repeated
from scribelake.session import materialise
from scribelake.sources.files import path_exists

CHUNKS = 64
DONE = "chunk int, take int, run int, rows long, chunks int"
PREDICTIONS = "id string, prediction string, chunk int, take int"


def chunk_of(key: str, chunks: int) -> Column:
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10)
    return F.pmod(digits.cast("long"), F.lit(chunks)).cast("int")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def done_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``chunk, take, run, rows, chunks`` of all that is done; a few rows for each chunk."""
    return _stored(spark, f"{path}/done", DONE)


def stored_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``id, prediction, chunk, take, run`` of the chunks that are done."""
    done = done_chunks(spark, path).select("chunk", "take", "run")
    found = _stored(spark, f"{path}/predictions", PREDICTIONS)
    return found.join(done, ["chunk", "take"]).select("id", "prediction", "chunk", "take", "run")


def _write_wave(predictions: DataFrame, path: str) -> None:
    (
        predictions.write.partitionBy("chunk", "take")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(f"{path}/predictions")
    )


def predict_resumable(
    rows: DataFrame,
    factory: P.RecogniserFactory,
    path: str,
    *,
    chunks: int = CHUNKS,
    per_wave: int = 8,
    max_waves: int | None = None,
    batch_size: int = 4,
    uniform: str | None = None,
    key: str = "id",
) -> DataFrame:
    """Predict the rows whose ids are not done yet; returns all that is done.

    A wave reads the rows once more, to keep those of its chunks, so waves should be long
    beside a scan; what a failure can lose is one wave.  ``max_waves`` ends the run earlier,
    for machines that are lent for a time.  Rows without id and ids on two rows are refused,
    as is another number of ``chunks`` than the folder has.
    """
    spark = rows.sparkSession
    ids = rows.select(F.col(key).cast("string").alias("id"))
    audit = counts_by_id({"a": ids}).agg(
        repeated("a").alias("again"), F.count_if(F.col("id").isNull()).alias("without")
    ).first()
    if audit["again"] or audit["without"]:
        raise IncompleteError(f"ids to predict must be there once: {audit.asDict()}")
    earlier = done_chunks(spark, path).groupBy("chunk").agg(
        F.max("take").alias("take"), F.max("run").alias("run"), F.max("chunks").alias("chunks")
    ).collect()
    if any(r.chunks != chunks for r in earlier):
        raise ValueError(f"{path} has {earlier[0].chunks} chunks, not {chunks}")
    run = max((r.run + 1 for r in earlier), default=0)
    takes = {r.chunk: r.take + 1 for r in earlier}

    # ids alone: what is left of each chunk
    done = stored_predictions(spark, path).select(F.col("id").alias("_left"))
    left = ids.withColumn("chunk", chunk_of("id", chunks)).withColumnRenamed("id", "_left")
    left = materialise(left.join(done, "_left", "left_anti"), "left")
    pending = [r.chunk for r in left.select("chunk").distinct().orderBy("chunk").collect()]
    keyed = rows.withColumn("_chunk", chunk_of(key, chunks))
    waves = [pending[k : k + per_wave] for k in range(0, len(pending), per_wave)]
    for wave in waves[:max_waves]:
        # of chunks that were never done all rows are left, and need not be joined
        new, again = ([c for c in wave if (c in takes) == known] for known in (False, True))
        asked = keyed.where(F.col("_chunk").isin(new))
        if again:
            wanted = left.where(F.col("chunk").isin(again)).select("_left")
            more = keyed.where(F.col("_chunk").isin(again))
            more = more.join(wanted, F.col(key).cast("string") == F.col("_left"), "left_semi")
            asked = asked.unionByName(more)
        made = P.predict(asked.drop("_chunk"), factory, batch_size=batch_size, uniform=uniform, key=key)
        take = F.element_at(
            F.create_map(*(F.lit(v) for c in wave for v in (c, takes.get(c, 0)))), F.col("chunk")
        ).cast("int")
        made = P.cleaned(made).withColumn("chunk", chunk_of("id", chunks)).withColumn("take", take)
        _write_wave(made, path)
        stored = _stored(spark, f"{path}/predictions", PREDICTIONS).where(F.col("chunk").isin(wave))
        counted = stored.where(F.col("take") == take).groupBy("chunk", "take").agg(
            F.count(F.lit(1)).alias("rows")
        )
        entry = counted.select("chunk", "take", F.lit(run).alias("run"), "rows", F.lit(chunks).alias("chunks"))
        # one small file a wave, committed whole or not at all
        entry.coalesce(1).write.mode("append").parquet(f"{path}/done")
    return stored_predictions(spark, path)
