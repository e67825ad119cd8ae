"""Queries that write derived tables to scratch storage and read them back, and
queries that select rows, predict and fill templates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions.roles import MissingColumnError, canonical
from scribelake.operators import guards, ids, predict, profile, selection
from scribelake.plans import manifests, prediction
from scribelake.session import scratch_path
from scribelake.sources import fingerprint as fp
from scribelake.sources import ledger, ordered, splits, tables
from workload import tables as t
from workload.registry import query

LANGUAGES = ("en", "fr", "es")
_CORPUS = t.with_sql("corpus", "SELECT * FROM corpus")


def _sql_text(text: str) -> str:
    """A text as SQL, control characters by number."""
    return " || ".join(f"chr({ord(c)})" for c in text)


def _csv_round_trip(spark: SparkSession, rows: DataFrame, written: str, read: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    tables.write_table(rows, path, dialect=written)
    result = tables.read_table(spark, path, dialect=read)
    return result.drop(tables.CORRUPT)


@query(_CORPUS)
def csv_scan_backslash(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, with quotes and line breaks inside fields."""
    return _csv_round_trip(spark, t.corpus(spark, sf), "backslash", "backslash")


@query(_CORPUS)
def csv_scan_doubled(spark: SparkSession, sf: str) -> DataFrame:
    return _csv_round_trip(spark, t.corpus(spark, sf), "doubled", "doubled")


@query(_CORPUS)
def csv_scan_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Files in both quoting styles in one scan."""
    rows = t.corpus(spark, sf)
    path = scratch_path(spark, "csv")
    held_out = F.col("original_split") == "validation"
    tables.write_table(rows.where(held_out), path, dialect="backslash", mode="append")
    tables.write_table(rows.where(~held_out), path, dialect="doubled", mode="append")
    return tables.read_table(spark, path, dialect="mixed")


_QUOTED = t.with_sql(
    "utterances",
    """SELECT id, chr(34) || transcription || ', ' || chr(92) || chr(34) AS transcription, language, original_split
    FROM utterances""",
)


@query(_QUOTED)
def csv_scan_mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Files in both quoting styles, a row a line, parted by expressions."""
    text = F.concat(F.lit('"'), "transcription", F.lit(', \\"'))
    rows = t.utterances(spark, sf).withColumn("transcription", text)
    path = scratch_path(spark, "csv")
    held_out = F.col("original_split") == "validation"
    tables.write_table(rows.where(held_out), path, dialect="backslash", mode="append")
    # the other style has no escapes, so a backslash in it is written twice, for the reader
    doubled = rows.withColumn("transcription", F.replace("transcription", F.lit("\\"), F.lit("\\\\")))
    tables.write_table(doubled.where(~held_out), path, dialect="doubled", mode="append")
    return tables.read_table(spark, path, dialect="mixed", multi_line=False)


_SPOKEN = "CASE language WHEN 'en' THEN 'lin' WHEN 'fr' THEN 'sna' WHEN 'es' THEN 'lug' ELSE language END"


@query(
    t.with_sql(
        "recordings corpus",
        f"""SELECT r.id, {_SPOKEN.replace("language", "r.language")} AS language, c.transcription AS text,
            'label table lacks required columns [''language'', ''original_split'']' AS refused
        FROM recordings r JOIN corpus c ON r.id = c.id
        WHERE split = 'validation' AND c.original_split = 'validation' AND r.language IN ('en', 'fr', 'es')""",
    )
)
def default_languages_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Blank language codes mean the default ones; what a label table without columns is told."""
    spoken = F.expr(_SPOKEN)
    store = t.recordings(spark, sf).withColumn("language", spoken)
    labels = t.corpus(spark, sf).withColumn("language", spoken)
    try:
        splits.load_labelled_split(store, labels.drop("language", "original_split"), "validation", [" "])
        refused = ""
    except MissingColumnError as error:
        refused = str(error)
    rows = splits.load_labelled_split(store, labels, "validation", [" ", ""])
    return rows.select("id", "language", "text", F.lit(refused).alias("refused"))


# what every text gets: a path, quotes in both styles, line breaks and a last backslash
_AWKWARD = "C:\\new\\table \\\"a\\\" \"\" \n\r\n \t , ' "


@query(
    t.with_sql(
        "corpus",
        f"""SELECT id, {_sql_text(_AWKWARD)} || coalesce(transcription, '') || chr(92) AS transcription,
            language || chr(92) AS language, chr(34) || original_split AS original_split FROM corpus""",
    )
)
def csv_defaults_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """What the default writer wrote and the default reader gives back."""
    rows = t.corpus(spark, sf).select(
        "id",
        F.concat(F.lit(_AWKWARD), F.coalesce("transcription", F.lit("")), F.lit("\\")).alias(
            "transcription"
        ),
        F.concat("language", F.lit("\\")).alias("language"),
        F.concat(F.lit('"'), "original_split").alias("original_split"),
    )
    path = scratch_path(spark, "csv")
    tables.write_table(rows, path)
    return tables.read_table(spark, path)


@query(
    t.with_sql(
        "corpus", "SELECT id, transcription AS reference_text, language AS code FROM corpus"
    )
)
def canonical_projection(spark: SparkSession, sf: str) -> DataFrame:
    return canonical(t.corpus(spark, sf), text="reference_text", language="code")


@query(
    t.with_sql(
        "recordings",
        """SELECT id, language, path, transcription AS text FROM recordings
        WHERE language = 'fr' AND split = 'train'""",
    )
)
def language_split_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.load_split(t.recording_store(spark, sf), "train", ["fr"])
    return rows.select("id", "language", "audio.path", "text")


@query(
    t.with_sql(
        "recordings",
        """SELECT id, language, path FROM recordings
        WHERE language IN ('en', 'fr', 'es') AND split = 'test'""",
    )
)
def many_languages_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.load_split(t.recording_store(spark, sf), "test", LANGUAGES, keep_text=False)
    return rows.select("id", "language", "audio.path")


@query(
    t.with_sql(
        "recordings",
        "SELECT id, language, path FROM recordings WHERE language IN ('en', 'fr', 'es', 'de')",
    )
)
def concatenated_splits(spark: SparkSession, sf: str) -> DataFrame:
    store = t.recording_store(spark, sf)
    parts = [
        splits.load_split(store, split, [*LANGUAGES, "de"], keep_text=False)
        for split in ("train", "validation", "test")
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.select("id", "language", "audio.path")


@query(
    t.with_sql(
        "test_ids template",
        """SELECT *, 'dry_run_validated' AS status FROM (
            SELECT 'test_rows' AS measure, '' AS key, count(*) AS value FROM test_ids
            UNION ALL SELECT 'sample_rows', '', count(*) FROM template
            UNION ALL SELECT 'test_unique_ids', '', count(DISTINCT ID) FROM test_ids
            UNION ALL SELECT 'sample_unique_ids', '', count(DISTINCT ID) FROM template
            UNION ALL SELECT 'test_sample_symmetric_difference', '', count(*) FROM (
                (SELECT ID FROM test_ids EXCEPT SELECT ID FROM template)
                UNION ALL (SELECT ID FROM template EXCEPT SELECT ID FROM test_ids))
            UNION ALL SELECT 'test_id_prefix', split_part(ID, '_', 1), count(*) FROM test_ids GROUP BY ALL
            UNION ALL SELECT 'sample_id_prefix', split_part(ID, '_', 1), count(*) FROM template GROUP BY ALL)""",
    )
)
def prediction_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """Validates the inputs, logs the dry run, predicts nothing."""
    book = scratch_path(spark, "ledger")
    checked = prediction.dry_run(t.test_ids(spark, sf), t.template(spark, sf))
    prediction.log_dry_run(spark, prediction.Run("Dry run"), book)
    logged = tables.read_table(spark, book, columns=ledger.LEDGER_COLUMNS)
    status = logged.agg(F.max("status").alias("status")).withColumn("part", F.lit(1))
    return checked.withColumn("part", F.lit(1)).join(status, "part").drop("part")


@query(
    t.with_sql(
        "recordings corpus",
        """SELECT r.id, r.language, path, c.transcription AS text
        FROM recordings r JOIN corpus c ON r.id = c.id AND r.language = c.language
        WHERE split = 'validation' AND c.original_split = 'validation'
            AND c.language IN ('en', 'fr', 'es')""",
    )
)
def labelled_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.load_labelled_split(
        t.recording_store(spark, sf), t.corpus(spark, sf), "validation", LANGUAGES
    )
    return rows.select("id", "language", "audio.path", "text")


@query(
    t.with_sql(
        "recordings",
        """SELECT id, language, split, path, bytes_present,
            CASE WHEN split <> 'test' THEN transcription END AS text
        FROM recordings WHERE language IN ('en', 'fr', 'es', 'de')""",
    )
)
def manifest_records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    manifests.write_manifests(
        t.recording_store(spark, sf), path, languages=[*LANGUAGES, "de"]
    )
    schema = (
        "id string, language string, split string, "
        "audio struct<path: string, bytes_present: boolean>, text string"
    )
    records = spark.read.schema(schema).json(path)
    return records.select("id", "language", "split", "audio.*", "text")


@query(
    t.with_sql(
        "corpus",
        """SELECT language, original_split, count(*)::VARCHAR AS rows FROM corpus GROUP BY ALL""",
    )
)
def result_table_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "counts")
    counts = profile.counts_by(t.corpus(spark, sf), "language", "original_split")
    tables.write_table(counts, path, single_file=True)
    return tables.read_table(spark, path)


def _read_aloud_sql(where: str = "") -> str:
    return f"SELECT {t.PAGE_ID_SQL} AS ID, {t.norm_sql('url')} AS prediction FROM pages {where}"


def read_aloud():
    """A stand-in recogniser: reads the path of each recording aloud."""

    def recognise(batch: pd.DataFrame) -> Sequence[str]:
        return [record["path"].upper() for record in batch["audio"]]

    return recognise


@query(_read_aloud_sql())
def raw_predictions(spark: SparkSession, sf: str) -> DataFrame:
    store = t.recordings(spark, sf)
    rows = prediction.prediction_rows(
        store, "test", [*LANGUAGES, "de"], wanted=t.pages_asked(spark, sf)
    )
    path = scratch_path(spark, "raw")
    made = prediction.predict_split(rows, read_aloud, batch_size=16)
    tables.write_table(predict.raw_predictions(made), path)
    return tables.read_table(spark, path)


_FILLED = t.with_sql(
    "template",
    """SELECT template.ID, coalesce(prediction, '') AS Target
    FROM template LEFT JOIN said ON template.ID = said.ID""",
    said=_read_aloud_sql(),
)


@query(_FILLED)
def template_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = prediction.prediction_rows(t.recordings(spark, sf), "test", [*LANGUAGES, "de"])
    return predict.fill_template(
        t.template(spark, sf), prediction.predict_split(rows, read_aloud, batch_size=16)
    )


@query(
    t.with_sql(
        "template",
        """SELECT row_number() OVER (ORDER BY md5(template.ID), template.ID) AS place, template.ID,
            coalesce(prediction, '') AS Target
        FROM template LEFT JOIN said ON template.ID = said.ID""",
        said=_read_aloud_sql(),
    )
)
def template_fill_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """A stored template in an order of its own, filled and read back with its row numbers."""
    given, filled = scratch_path(spark, "template"), scratch_path(spark, "filled")
    asked = t.template(spark, sf).withColumn("order", F.md5("ID"))
    ordered.write_ordered(asked, given, "order", "ID", drop=["order"])
    template = ordered.read_ordered(spark, given).na.fill("")
    rows = prediction.prediction_rows(t.recordings(spark, sf), "test", [*LANGUAGES, "de"])
    made = prediction.predict_split(rows, read_aloud, batch_size=16)
    ordered.write_ordered(predict.fill_template(template, made), filled, "place", drop=["place"])
    back = ordered.read_ordered(spark, filled).na.fill("")
    return back.select((F.col("place") + 1).alias("place"), "ID", "Target")


@query(_FILLED)
def batch_prediction_job(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job; returns the submission as it was stored."""
    output, book = scratch_path(spark, "submission"), scratch_path(spark, "ledger")
    prediction.batch_prediction(
        t.recording_store(spark, sf),
        read_aloud,
        prediction.Run("Read aloud", model="path reader"),
        output=output,
        languages=[*LANGUAGES, "de"],
        test=t.pages_asked(spark, sf),
        template=t.template(spark, sf),
        ledger=book,
        batch_size=16,
    )
    return tables.read_table(spark, output).na.fill("")


@query(
    f"""SELECT event_type AS experiment_id, {', '.join(f"'' AS {c}" for c in
        ledger.LEDGER_COLUMNS if c not in ('experiment_id', 'stage', 'local_wer'))},
        user_id::VARCHAR AS stage, value::VARCHAR AS local_wer
    FROM (SELECT event_type, user_id, max(value) AS value FROM events GROUP BY ALL)"""
)
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    """Appends one record per event type and user, in two steps."""
    events = t.read(spark, sf, "events")
    records = events.groupBy(
        F.col("event_type").alias("experiment_id"), F.col("user_id").alias("stage")
    ).agg(F.max("value").alias("local_wer"), F.count(F.lit(1)).alias("not_a_ledger_column"))
    path = scratch_path(spark, "ledger")
    clicks = F.col("experiment_id") == "click"
    ledger.append_ledger(records.where(clicks), path)
    ledger.append_ledger(records.where(~clicks), path)
    return tables.read_table(spark, path, columns=ledger.LEDGER_COLUMNS).na.fill("")


FILES_A_SOURCE = 4


@query(
    f"""SELECT source, (doc_id // 20 % {FILES_A_SOURCE})::VARCHAR AS part, true AS "exists",
        sum(strlen(text) + 1)::BIGINT AS bytes,
        sha256(string_agg(text || chr(10), '' ORDER BY doc_id))[1:16] AS sha256
    FROM documents GROUP BY ALL
    UNION ALL SELECT 'absent', '', false, NULL, NULL"""
)
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of several text files a source, and of one that is not there."""
    path = scratch_path(spark, "texts")
    part = F.pmod(F.floor(F.col("doc_id") / 20), F.lit(FILES_A_SOURCE))
    texts = t.read(spark, sf, "documents").select("source", part.alias("part"), "doc_id", "text")
    (
        texts.repartition("source", "part")
        .sortWithinPartitions("source", "part", "doc_id")
        .select("source", "part", "text")
        .write.partitionBy("source", "part")
        .text(path)
    )
    names = spark.read.format("binaryFile").load(path).select("path").collect()
    asked = [row.path for row in names] + [f"{path}/source=absent/part-0.txt"]
    prints = fp.fingerprint(spark, asked)
    return prints.select(
        F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"),
        F.regexp_extract("path", "/part=([^/]*)/", 1).alias("part"),
        "exists",
        "bytes",
        "sha256",
    )


@query(
    t.with_sql(
        "corpus test_ids",
        "SELECT id, transcription FROM corpus WHERE id IN (SELECT ID FROM test_ids)",
    )
)
def wanted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return selection.only_ids(t.corpus(spark, sf), canonical(t.test_ids(spark, sf))).select(
        "id", "transcription"
    )


@query(
    t.with_sql(
        "corpus",
        """SELECT id, transcription FROM corpus
        WHERE original_split = 'validation' AND language IN ('en', 'fr', 'es')""",
    )
)
def split_and_language_filter(spark: SparkSession, sf: str) -> DataFrame:
    chosen = guards.in_languages(guards.in_split(t.corpus(spark, sf), "validation"), LANGUAGES)
    return guards.with_rows(chosen, "validation").select("id", "transcription")


@query(
    t.with_sql(
        "corpus finer",
        """SELECT c.id, coalesce(f.language, c.language) AS language
        FROM corpus c LEFT JOIN finer f ON c.id = f.id""",
    )
)
def language_override(spark: SparkSession, sf: str) -> DataFrame:
    return selection.override_language(
        t.corpus(spark, sf).select("id", "language"), t.finer(spark, sf)
    )


@query(
    """SELECT conv_id::VARCHAR AS id, arg_max(text, turn) AS text FROM conversations
    WHERE conv_id IN (SELECT doc_id FROM documents) GROUP BY conv_id"""
)
def relabel_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Documents take the last turn of the conversation with their number as text."""
    rows = t.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    labels = t.read(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), F.col("text").alias("label"), "turn"
    )
    return selection.relabel(rows, labels, order="turn")


@query(
    t.with_sql(
        "corpus test_ids",
        "SELECT id FROM corpus WHERE id NOT IN (SELECT ID FROM test_ids) ORDER BY id LIMIT 10",
    )
)
def first_missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    absent = ids.missing_ids(t.corpus(spark, sf), canonical(t.test_ids(spark, sf)))
    return ids.first_sorted(absent, 10)


@query(t.with_sql("corpus", "SELECT id, language FROM corpus ORDER BY id LIMIT 20"))
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return selection.first_n(t.corpus(spark, sf), 20).select("id", "language")


@query(
    t.with_sql(
        "corpus", "SELECT id, language FROM corpus ORDER BY md5('13:' || id), id LIMIT 100"
    )
)
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sample_n(t.corpus(spark, sf), 100).select("id", "language")


@query(
    t.with_sql(
        "corpus",
        """SELECT id, language FROM (SELECT *, row_number() OVER (ORDER BY md5('13:' || id), id) AS nr,
            count(*) OVER () AS n FROM corpus) WHERE nr <= n // 2""",
    )
)
def seeded_sample_half(spark: SparkSession, sf: str) -> DataFrame:
    corpus = t.corpus(spark, sf)
    return selection.sample_n(corpus, corpus.count() // 2).select("id", "language")


_FACTORS = """SELECT language, count(*) AS rows,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM corpus GROUP BY language))::DOUBLE
    / count(*)::DOUBLE AS copies FROM corpus GROUP BY language"""


@query(t.with_sql("corpus", _FACTORS))
def balance_factors(spark: SparkSession, sf: str) -> DataFrame:
    return selection.balance_factors(t.corpus(spark, sf))


@query(
    t.with_sql(
        "corpus",
        """SELECT id, language, unnest(range(1, times + 1))::INTEGER AS copy FROM (
            SELECT c.id, c.language, floor(copies)::INTEGER + (
                ('0x' || md5('13:' || c.id)[1:8])::BIGINT::DOUBLE / 4294967296.0::DOUBLE
                < copies - floor(copies))::INTEGER AS times
            FROM corpus c JOIN factors f ON c.language = f.language)""",
        factors=_FACTORS,
    )
)
def oversampled(spark: SparkSession, sf: str) -> DataFrame:
    return selection.oversample(t.corpus(spark, sf)).select("id", "language", "copy")
