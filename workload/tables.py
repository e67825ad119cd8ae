"""The transcript tables of the workload, derived from the given tables.

Each is defined twice: as a DataFrame and, in ``SQL``, as a common table expression
of the same name for the oracle.  All of them keep every row and the whole of every
text; long documents are cut into utterances of ``WORDS`` words, none left out.

=============  ==================================================================
corpus         documents as labelled transcripts; two sources are held out as the
               validation split
flagged        corpus with the defects that the integrity checks look for
utterances     documents cut into consecutive utterances
model_a/b      what two imagined recognisers make of each utterance
pages_asked    ids of the pages, to be predicted
test_ids       pages_asked and, as a leak to be found, the labelled documents
template       the pages and, never predicted, the benchmark items
finer          a finer language code for labelled documents
=============  ==================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions import text
from scribelake.session import scratch_path

WORDS = 30
VALIDATION_SOURCES = ("src0", "src1")
# tables whose rows cost enough to be worth spreading when they come in one piece
LONG_TEXTS = ("documents", "conversations")


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows out to all cores where the scan has fewer tasks than there are cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in LONG_TEXTS else scan


def _split(source: str = "source") -> Column:
    held_out = F.col(source).isin(*VALIDATION_SOURCES)
    return F.when(held_out, "validation").otherwise("train")


def _document_id() -> Column:
    return F.concat_ws("_", "lang", F.col("doc_id").cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        _document_id().alias("id"),
        F.col("text").alias("transcription"),
        F.col("lang").alias("language"),
        _split().alias("original_split"),
    )


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, raw = F.col("source"), F.col("text")
    return read(spark, sf_dir, "documents").select(
        # one source repeats the ids of its language
        F.when(source == "src2", F.concat(F.col("lang"), F.lit("_x")))
        .otherwise(_document_id())
        .alias("id"),
        F.when(source == "src3", F.lit(None).cast("string"))
        .when(source == "src4", "!!!")
        .when(source == "src5", F.concat(F.lit("l'"), raw))
        .when(source == "src6", "")
        .otherwise(raw)
        .alias("transcription"),
        F.col("lang").alias("language"),
        _split().alias("original_split"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one linear scan per document; up to WORDS words and the gaps after them
    pieces = F.regexp_extract_all(
        "text", F.lit(rf"(?:[^ \n]++[ \n]*+){{1,{WORDS}}}+"), F.lit(0)
    )
    cut = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.posexplode(pieces).alias("k", "piece")
    )
    # most pieces have single spaces already, which a plain search tells
    line = F.replace(F.col("piece"), F.lit("\n"), F.lit(" "))
    single = F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " {2,}", " ")).otherwise(line)
    return cut.select(
        F.concat_ws("_", _document_id(), F.col("k").cast("string")).alias("id"),
        F.trim(single).alias("transcription"),
        F.col("lang").alias("language"),
        _split().alias("original_split"),
    )


def _heard(transcripts: DataFrame, dropped: int, changes: dict[str, str]) -> DataFrame:
    kept = F.filter(text.normalised_words("transcription"), lambda w: F.char_length(w) != dropped)
    heard = F.array_join(kept, " ")
    for old, new in changes.items():
        heard = F.replace(heard, F.lit(old), F.lit(new))
    return transcripts.select(F.col("id").alias("ID"), heard.alias("prediction"))


def model_a(transcripts: DataFrame) -> DataFrame:
    """Drops two-letter words and mishears ``en``."""
    return _heard(transcripts, 2, {"en": "an"})


def model_b(transcripts: DataFrame) -> DataFrame:
    """Drops three-letter words, mishears ``er`` and splits words at ``eau``."""
    return _heard(transcripts, 3, {"er": "ar", "eau": "e au"})


def page_id() -> Column:
    return F.concat(
        F.regexp_extract("url", "/([a-z][a-z])/", 1), F.lit("_p"), F.col("page_id").cast("string")
    )


def pages_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(page_id().alias("ID"))


def test_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaked = read(spark, sf_dir, "documents").join(
        read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    return pages_asked(spark, sf_dir).unionByName(leaked.select(_document_id().alias("ID")))


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("ID")
    )
    return pages_asked(spark, sf_dir).unionByName(items).select("ID", F.lit("").alias("Target"))


def finer(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return (
        read(spark, sf_dir, "documents")
        .join(labels, "doc_id")
        .select(
            _document_id().alias("id"),
            F.concat(F.col("lang"), F.lit("_q"), F.col("quality").cast("string")).alias("language"),
        )
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (train, validation) and pages (test) as a recording store."""
    documents = read(spark, sf_dir, "documents").select(
        _document_id().alias("id"),
        F.struct(
            F.concat(F.lit("clips/"), _document_id(), F.lit(".wav")).alias("path"),
            F.when(F.col("source") != "src7", F.encode("text", "UTF-8")).alias("bytes"),
            F.coalesce(F.col("source") != "src7", F.lit(False)).alias("bytes_present"),
        ).alias("audio"),
        F.lower("text").alias("transcription"),
        F.col("lang").alias("language"),
        _split().alias("split"),
    )
    pages = read(spark, sf_dir, "pages").select(
        page_id().alias("id"),
        F.struct(
            F.col("url").alias("path"),
            F.lit(None).cast("binary").alias("bytes"),
            F.lit(False).alias("bytes_present"),
        ).alias("audio"),
        F.lit(None).cast("string").alias("transcription"),
        F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("language"),
        F.lit("test").alias("split"),
    )
    return documents.unionByName(pages)


def recording_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written to scratch storage in folders by language and split."""
    path = scratch_path(spark, "recordings")
    rows = recordings(spark, sf_dir)
    rows.hint("rebalance", "language", "split").write.partitionBy("language", "split").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# ---------------------------------------------------------------- the same in SQL

SPLIT_SQL = "CASE WHEN source IN ('src0', 'src1') THEN 'validation' ELSE 'train' END"
PAGE_ID_SQL = "regexp_extract(url, '/([a-z][a-z])/', 1) || '_p' || page_id"


def norm_sql(expression: str) -> str:
    """Normalised text; no given text changes under NFKC."""
    return (
        f"trim(regexp_replace(lower(coalesce({expression}, '')), "
        r"'[\s!-/:-@\[-`{-~’]+', ' ', 'g'))"
    )


def words_sql(normalised: str) -> str:
    return f"list_filter(string_split({normalised}, ' '), lambda x: x <> '')"


def tokens_sql(normalised: str) -> str:
    return rf"regexp_extract_all({normalised}, '[\p{{L}}\p{{N}}_]+')"


def chars_distance_sql(a: str, b: str) -> str:
    """The oracle's function counts bytes: map the accents of the data to control characters."""
    accents = "äöüßçèéêíñóÄÖÜÇÈÉÊÍÑÓ"
    spare = [*range(1, 9), *range(14, 14 + len(accents) - 8)]
    to = " || ".join(f"chr({c})" for c in spare)

    def one_byte(e: str) -> str:
        return f"translate({e}, '{accents}', {to})"

    return f"levenshtein({one_byte(a)}, {one_byte(b)})"


def words_distance_sql(a: str, b: str) -> str:
    """Words as one byte each; an utterance pair has too few distinct words to run out."""

    def coded(side: str) -> str:
        vocabulary = f"list_distinct(list_concat({a}, {b}))"
        return (
            f"coalesce(array_to_string(list_transform({side}, "
            f"lambda w: chr((list_position(list_sort({vocabulary}), w) + 20)::INTEGER)), ''), '')"
        )

    return f"levenshtein({coded(a)}, {coded(b)})"


def _heard_sql(dropped: int, changes: dict[str, str]) -> str:
    kept = (
        f"list_filter({words_sql(norm_sql('transcription'))}, lambda x: length(x) <> {dropped})"
    )
    heard = f"coalesce(array_to_string({kept}, ' '), '')"
    for old, new in changes.items():
        heard = f"replace({heard}, '{old}', '{new}')"
    return f"SELECT id AS ID, {heard} AS prediction FROM utterances"


SQL: dict[str, str] = {
    "corpus": f"""
        SELECT lang || '_' || doc_id AS id, text AS transcription, lang AS language,
               {SPLIT_SQL} AS original_split
        FROM documents""",
    "flagged": f"""
        SELECT CASE WHEN source = 'src2' THEN lang || '_x' ELSE lang || '_' || doc_id END AS id,
               CASE source WHEN 'src3' THEN NULL WHEN 'src4' THEN '!!!'
                    WHEN 'src5' THEN 'l''' || text WHEN 'src6' THEN '' ELSE text
               END AS transcription,
               lang AS language, {SPLIT_SQL} AS original_split
        FROM documents""",
    "utterances": rf"""
        SELECT lang || '_' || doc_id || '_' || k AS id,
               array_to_string(w[k * {WORDS} + 1 : k * {WORDS} + {WORDS}], ' ') AS transcription,
               lang AS language, {SPLIT_SQL} AS original_split
        FROM (SELECT *, unnest(range(0, (len(w) - 1) // {WORDS} + 1)) AS k
              FROM (SELECT *, list_filter(string_split_regex(text, '[ \n]'), lambda x: x <> '') AS w
                    FROM documents)
              WHERE len(w) > 0)""",
    "model_a": _heard_sql(2, {"en": "an"}),
    "model_b": _heard_sql(3, {"er": "ar", "eau": "e au"}),
    "pages_asked": f"SELECT {PAGE_ID_SQL} AS ID FROM pages",
    "test_ids": f"""
        SELECT {PAGE_ID_SQL} AS ID FROM pages
        UNION ALL SELECT lang || '_' || doc_id FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "template": f"""
        SELECT {PAGE_ID_SQL} AS ID, '' AS Target FROM pages
        UNION ALL SELECT 'item_' || item_id, '' FROM benchmark""",
    "finer": """
        SELECT lang || '_' || d.doc_id AS id, lang || '_q' || quality AS language
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "recordings": f"""
        SELECT lang || '_' || doc_id AS id, 'clips/' || lang || '_' || doc_id || '.wav' AS path,
               source <> 'src7' AS bytes_present, lower(text) AS transcription,
               lang AS language, {SPLIT_SQL} AS split
        FROM documents
        UNION ALL SELECT {PAGE_ID_SQL}, url, false, NULL,
               regexp_extract(url, '/([a-z][a-z])/', 1), 'test' FROM pages""",
}

_NEEDS = {"model_a": ("utterances",), "model_b": ("utterances",)}


def with_sql(names: str, body: str, **more: str) -> str:
    """A query over the named derived tables, plus any further ones given as SQL."""
    ordered: list[str] = []
    for name in names.split():
        for each in (*_NEEDS.get(name, ()), name):
            if each not in ordered:
                ordered.append(each)
    tables = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in ordered]
    tables += [f"{n} AS MATERIALIZED ({s})" for n, s in more.items()]
    return f"WITH {', '.join(tables)} {body}"
