import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scribelake.operators import ids, profile, vocabulary
from scribelake.plans import corpus as corpus_plan

SCHEMA = "id string, transcription string, language string, original_split string"
ROWS = [
    ("a_1", "one two, three!", "a", "train"),
    ("a_2", "one two two", "a", "validation"),
    ("a_3", "new words two new", "a", "validation"),
    ("b_1", 'a "quote" 12', "b", "train"),
    ("b_2", "", "b", "train"),
    ("b_3", "!!!", "b", "train"),
    ("b_4", None, "b", "validation"),
    ("b_4", "one two, three!", "b", "train"),
    ("c_1", "!?", "c", "train"),
    ("d_1", "lost", None, "train"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_quantiles_match_linear_interpolation(spark, corpus):
    features = profile.text_features(corpus)
    frame = features.toPandas()
    for row in profile.length_quantiles(features).collect():
        part = frame[(frame.language == row.language) & (frame.original_split == row.original_split)]
        assert row["rows"] == len(part)
        for feature in profile.QUANTILE_FEATURES:
            for name, q in profile.QUANTILES.items():
                assert row[f"{feature}_{name}"] == pytest.approx(part[feature].quantile(q))


def test_quantiles_of_many_rows(spark):
    frame = pd.DataFrame({"n": [(i * 37) % 101 for i in range(2000)]})
    df = spark.createDataFrame(frame).selectExpr(
        "'x' as language", "'train' as original_split",
        *[f"cast(n as int) as {f}" for f in profile.QUANTILE_FEATURES],
    )
    row = profile.length_quantiles(df).first()
    for name, q in profile.QUANTILES.items():
        assert row[f"char_len_{name}"] == pytest.approx(frame.n.quantile(q))


def brute_drift(rows):
    out = {}
    for language in sorted({r[2] for r in rows if r[2]}):
        seen, tested = Counter(), Counter()
        for _, text, lang, split in rows:
            if lang == language and text:
                (seen if split == "train" else tested).update(re.findall(r"\w+", text.lower()))
        unseen = {t: n for t, n in tested.items() if t not in seen}
        out[language] = (
            len(seen), len(tested), sum(tested.values()), len(unseen), sum(unseen.values()),
            sum(unseen.values()) / max(sum(tested.values()), 1),
        )
    return out


def test_drift_keeps_languages_without_tokens(corpus):
    got = {r.language: tuple(r)[1:] for r in vocabulary.vocabulary_drift(corpus).collect()}
    assert got == brute_drift(ROWS)
    assert got["c"] == (0, 0, 0, 0, 0, 0.0)


def test_top_tokens_break_ties_by_token(spark):
    df = spark.createDataFrame([("b a b c a d", "x"), ("z", "y"), ("q", None)], "transcription string, language string")
    top = vocabulary.top_tokens(df, 3).orderBy("language", "rank").collect()
    assert [(r.language, r.token, r["count"]) for r in top] == [
        ("x", "a", 2), ("x", "b", 2), ("x", "c", 1), ("y", "z", 1)
    ]


def test_spelling_variants_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(150)})
    counts = spark.createDataFrame(
        [("x", w, i % 2, (i + 1) % 2) for i, w in enumerate(words)],
        "language string, token string, known_count long, checked_count long",
    )

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    known, new = words[1::2], words[0::2]
    expected = {(u, k) for u in new for k in known if near(u, k)}
    got = {(r.unseen, r.known) for r in vocabulary.spelling_variants(counts).collect()}
    assert got == expected and len(expected) > 50


def test_quality_flags(spark, corpus):
    test = spark.createDataFrame([("a_1",), ("t_1",), ("t_1",), ("t_2",)], "id string")
    template = spark.createDataFrame([("t_1",), ("t_3",)], "id string")
    rows = profile.quality_flags(corpus, test, template).collect()
    assert {r.check: r.value for r in rows} == {
        "duplicate_train_ids": 1,
        "duplicate_test_ids": 1,
        "train_test_id_overlap": 1,
        "test_sample_id_symmetric_difference": 3,
        "empty_train_transcriptions": 2,
        "normalized_empty_train_transcriptions": 4,
        "repeated_transcriptions": 1,
        "transcriptions_with_digits": 1,
        "transcriptions_with_quotes": 1,
    }
    assert {r.check: r.severity for r in rows} == profile.SEVERITY


def test_empty_tables_give_zero_flags(spark, corpus):
    nothing = corpus.where("false")
    rows = profile.quality_flags(nothing, nothing.select("id"), nothing.select("id")).collect()
    assert len(rows) == 9 and all(r.value == 0 for r in rows)


def test_repeats_count_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "t string")
    assert ids.repeat_count(df, "t").first().repeated == 2
    assert profile.distinct_count(df, "t").first().distinct_values == 2
    assert profile.distinct_count(df, "t", relative_error=0.05).first().distinct_values == 2


def test_counts_and_null_keys(spark, corpus):
    assert "d_1" not in [r.language for r in profile.counts_by(corpus, "language").collect()]
    assert [(r.language, r["rows"]) for r in profile.value_counts(corpus, "language", "language").collect()] == [
        ("b", 5), ("a", 3), ("c", 1)
    ]
    assert (None, 1) in [tuple(r) for r in profile.language_profile(corpus).collect()]
    assert profile.language_profile(corpus.select("id")) is None


def test_table_profile(spark):
    df = spark.createDataFrame([("1", "x", None), ("1", None, None), (None, "y", "z")], "ID string, Sentence string, id string")
    rows = {r.column: r for r in profile.table_profile(df, "p").collect()}
    assert rows["ID"].distinct_ids == 1 and rows["ID"].nulls == 1 and rows["ID"].roles == "id"
    assert rows["Sentence"].roles == "text" and rows["id"].nulls == 2
    assert rows["Sentence"].distinct_ids is None
    unnamed = profile.table_profile(spark.createDataFrame([(1,)], "x int")).first()
    assert unnamed["rows"] == 1 and unnamed.roles == ""


def test_report_tables_agree_with_their_operators(spark, corpus, tmp_path):
    test = spark.createDataFrame([("a_9",), ("b9",)], "ID string")
    template = spark.createDataFrame([("a_9", "")], "ID string, Target string")
    source = tmp_path / "f.bin"
    source.write_bytes(b"abc")
    tables = corpus_plan.corpus_profile(corpus, test, template, top_n=2, files=[str(source)])

    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(tables["language_counts"]) == rows(profile.value_counts(corpus, "language", "language"))
    assert rows(tables["language_split_counts"]) == rows(
        profile.counts_by(corpus, "language", "original_split")
    )
    assert rows(tables["transcript_length_by_language_split"]) == rows(
        profile.length_quantiles(profile.text_features(corpus))
    )
    assert rows(tables["validation_oov_by_language"]) == rows(vocabulary.vocabulary_drift(corpus))
    assert rows(tables["top_tokens"]) == rows(vocabulary.top_tokens(corpus, 2))
    assert {r.id_prefix for r in tables["test_id_prefix_counts"].collect()} == {"a", ""}
    assert tables["dataset_fingerprint"].first().bytes == 3
    corpus_plan.write_corpus_profile(tables, str(tmp_path / "out"))
    top = spark.read.csv(str(tmp_path / "out" / "top_tokens"), header=True)
    assert top.where(F.col("language") == "a").count() == 2


def test_overview(spark, corpus):
    row = profile.overview(corpus, corpus.select("id"), corpus.limit(2)).first()
    assert (row.train_rows, row.test_rows, row.sample_rows, row.validation_rows) == (10, 10, 2, 3)
    assert row.languages == "a, b, c"


def test_spelling_variants_of_long_tokens_and_single_letters(spark):
    long = "ab" * 25_000
    rows = [("x", long, 1, 0), ("x", long + "c", 0, 1)]
    rows += [("x", chr(0x4E00 + i), i % 2, (i + 1) % 2) for i in range(3000)]
    counts = spark.createDataFrame(rows, "language string, token string, checked_count long, known_count long")
    found = vocabulary.spelling_variants(counts).collect()
    assert [(len(r.unseen), len(r.known)) for r in found] == [(50_000, 50_001)]
