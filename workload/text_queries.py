"""Queries on row-local text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions import distance, roles, text
from scribelake.operators import profile
from workload import tables as t
from workload.registry import query

NORM = t.norm_sql("transcription")


@query(t.with_sql("corpus", f"SELECT id, {NORM} AS normalised FROM corpus"))
def normalised_text(spark: SparkSession, sf: str) -> DataFrame:
    return t.corpus(spark, sf).select("id", text.normalise("transcription").alias("normalised"))


@query(t.with_sql("corpus", f"SELECT id, {NORM} AS normalised FROM corpus"))
def normalised_text_arrow(spark: SparkSession, sf: str) -> DataFrame:
    return t.corpus(spark, sf).select(
        "id", text.normalise("transcription", engine="arrow").alias("normalised")
    )


@query(
    t.with_sql(
        "corpus", f"SELECT id, {t.norm_sql('strip_accents(transcription)')} AS normalised FROM corpus"
    )
)
def accents_stripped(spark: SparkSession, sf: str) -> DataFrame:
    return t.corpus(spark, sf).select(
        "id", text.normalise("transcription", strip_accents=True).alias("normalised")
    )


@query(
    f"SELECT conv_id, turn, {t.norm_sql('text')} AS cleaned FROM conversations"
)
def submission_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "conversations").select(
        "conv_id", "turn", text.clean_prediction("text").alias("cleaned")
    )


@query(
    t.with_sql(
        "corpus",
        f"""SELECT id, len({t.tokens_sql(NORM)}) AS tokens,
               array_to_string({t.tokens_sql(NORM)}, '|') AS token_text FROM corpus""",
    )
)
def tokenised_text(spark: SparkSession, sf: str) -> DataFrame:
    clean = t.corpus(spark, sf).select("id", text.normalise("transcription").alias("n"))
    return clean.select("id", text.tokens("n").alias("w")).select(
        "id", F.size("w").alias("tokens"), F.array_join("w", "|").alias("token_text")
    )


@query(
    t.with_sql(
        "flagged",
        rf"""SELECT id, length(n) AS char_len, len({t.words_sql('n')}) AS word_len,
               len(list_distinct({t.words_sql('n')})) AS unique_word_len,
               len(raw) - len(replace(raw, ',', '')) AS comma_count,
               len(raw) - len(replace(raw, '"', '')) AS quote_count,
               len(raw) - len(replace(raw, '''', '')) AS apostrophe_count,
               len(regexp_extract_all(raw, '\d')) AS digit_count,
               len(regexp_extract_all(raw, '[!-/:-@\[-`{{-~]')) AS punct_count
        FROM (SELECT id, {NORM} AS n, coalesce(transcription, '') AS raw FROM flagged)""",
    )
)
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    return profile.text_features(t.flagged(spark, sf)).drop(
        "transcription", "language", "original_split"
    )


@query(
    t.with_sql(
        "corpus",
        f"""SELECT id, n AS words, CASE WHEN n <= 5 THEN '00_05' WHEN n <= 10 THEN '06_10'
               WHEN n <= 20 THEN '11_20' ELSE '21_plus' END AS length_bucket
        FROM (SELECT id, len({t.words_sql(NORM)}) AS n FROM corpus)""",
    )
)
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    clean = t.corpus(spark, sf).select("id", text.normalise("transcription").alias("n"))
    counted = clean.select("id", text.word_count("n").alias("words"))
    return counted.select("id", "words", text.length_bucket("words").alias("length_bucket"))


@query(
    """SELECT value, CASE WHEN contains(value, '_') THEN split_part(value, '_', 1) ELSE '' END
           AS id_prefix, split_part(value, '_', 1) AS id_group
    FROM (SELECT lang || '_' || doc_id AS value FROM documents
          UNION ALL SELECT source FROM documents)"""
)
def id_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    documents = t.read(spark, sf, "documents")
    values = t.corpus(spark, sf).select(F.col("id").alias("value")).unionByName(
        documents.select(F.col("source").alias("value"))
    )
    return values.select(
        "value", text.id_prefix("value").alias("id_prefix"), text.id_group("value").alias("id_group")
    )


@query(
    r"""SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' ||
           CASE WHEN s = '' THEN 'experiment' ELSE s END AS run_id,
           strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc_text
    FROM (SELECT event_id, ts, trim(regexp_replace(lower(event_type || ' ' || props),
              '[^\p{L}\p{N}]+', '_', 'g'), '_') AS s FROM events)"""
)
def run_ids(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "events").select(
        "event_id",
        text.run_id(F.concat_ws(" ", "event_type", "props"), "ts").alias("run_id"),
        text.utc_text("ts").alias("utc_text"),
    )


@query(t.with_sql("recordings", "SELECT id, path, bytes_present FROM recordings"))
def audio_pointers(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.recordings(spark, sf)
    return rows.select("id", roles.audio_pointer(rows, "audio").alias("a")).select("id", "a.*")


_PAIRS = f"""SELECT u.id, {t.norm_sql('transcription')} AS r, {t.norm_sql('prediction')} AS p
    FROM utterances u JOIN model_a m ON u.id = m.ID"""


def _clean_pairs(spark: SparkSession, sf: str, forms: str = "arrow") -> DataFrame:
    transcripts = t.utterances(spark, sf)
    heard = t.model_a(transcripts).select(F.col("ID").alias("id"), "prediction")
    return transcripts.join(heard, "id").select(
        "id",
        text.normalise("transcription", engine=forms).alias("r"),
        text.normalise("prediction", engine=forms).alias("p"),
    )


_CHARS = t.with_sql(
    "utterances model_a",
    f"SELECT id, {t.chars_distance_sql('r', 'p')}::INTEGER AS edits FROM ({_PAIRS})",
)
_WORDS = t.with_sql(
    "utterances model_a",
    f"""SELECT id, {t.words_distance_sql('a', 'b')}::INTEGER AS edits
    FROM (SELECT id, {t.words_sql('r')} AS a, {t.words_sql('p')} AS b FROM ({_PAIRS}))""",
)


@query(_CHARS)
def char_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _clean_pairs(spark, sf).select("id", distance.char_edits("r", "p").alias("edits"))


@query(_CHARS)
def char_edit_distance_builtin(spark: SparkSession, sf: str) -> DataFrame:
    return _clean_pairs(spark, sf, "jvm").select(
        "id", distance.char_edits("r", "p", "jvm").alias("edits")
    )


@query(_WORDS)
def word_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _clean_pairs(spark, sf).select("id", distance.word_edits("r", "p").alias("edits"))


@query(_WORDS)
def word_edit_distance_builtin(spark: SparkSession, sf: str) -> DataFrame:
    return _clean_pairs(spark, sf, "jvm").select(
        "id", distance.word_edits("r", "p", "jvm").alias("edits")
    )
