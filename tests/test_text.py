import re
import string
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scribelake.functions import roles, text
from workload import tables


def expected(value, strip=False):
    """Plain statement of the normalisation rules."""
    value = unicodedata.normalize("NFKC", value or "").lower()
    if strip:
        value = unicodedata.normalize("NFD", value)
        value = "".join(c for c in value if unicodedata.category(c) != "Mn")
    spaced = "".join(" " if c in string.punctuation or c == "’" else c for c in value)
    return " ".join(spaced.split())


CASES = [
    "  Good,   Morning!  ",
    None,
    "",
    "!!!",
    "n'omukazi n’abaana `bano`",
    "ﬁancé Ⅷ ｆｕｌｌ　width",
    "étude",
    "tab\tnew\nline\x1cfile\x85next\xa0hard sep　wide",
    "ctrl\x01kept",
    "İstanbul ΣΊΣΥΦΟΣ",
    "x≠y",
    "a_b-c",
    "𝔘𝔫𝔦 𝄞",
    "日本語。テスト",
]


@pytest.mark.parametrize("engine", ["jvm", "arrow"])
@pytest.mark.parametrize("strip", [False, True])
def test_normalise(spark, engine, strip):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string")
    out = df.select("i", text.normalise("t", strip_accents=strip, engine=engine).alias("n"))
    got = {r.i: r.n for r in out.collect()}
    for i, case in enumerate(CASES):
        assert got[i] == expected(case, strip), case
    assert got[0] == "good morning"


def test_unicode_forms_agree_with_the_standard_tables(spark):
    # code points whose decomposition predates both libraries' Unicode versions
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    points = [c for c in points if unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    out = df.select(
        "c", text.unicode_form("t", "NFKC").alias("k"), text.unicode_form("t", "NFD").alias("d")
    )
    for row in out.collect():
        assert row.k == unicodedata.normalize("NFKC", chr(row.c))
        assert row.d == unicodedata.normalize("NFD", chr(row.c))


def test_words_tokens_and_counts(spark):
    raw = ["", "a b  a", "n'ente, 3 \"x\" é", "½ ² x", None, "_a_ b-c", "٣ arabic"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, t string")
    out = df.withColumn("n", text.normalise("t")).select(
        "i",
        text.words("n").alias("words"),
        text.word_count("n").alias("count"),
        text.tokens("n").alias("tokens"),
        text.comma_count("t").alias("commas"),
        text.quote_count("t").alias("quotes"),
        text.apostrophe_count("t").alias("apostrophes"),
        text.digit_count("t").alias("digits"),
        text.punctuation_count("t").alias("punct"),
    )
    for row in out.collect():
        value = raw[row.i] or ""
        clean = expected(value)
        assert row.words == clean.split()
        assert row["count"] == len(clean.split())
        assert row.tokens == re.findall(r"\b\w+\b", clean)
        assert row.commas == value.count(",")
        assert row.quotes == value.count('"')
        assert row.apostrophes == value.count("'")
        assert row.digits == len(re.findall(r"\d", value))
        assert row.punct == sum(c in string.punctuation for c in value)


def test_length_buckets(spark):
    edges = {
        0: "00_05",
        5: "00_05",
        6: "06_10",
        10: "06_10",
        11: "11_20",
        20: "11_20",
        21: "21_plus",
    }
    df = spark.createDataFrame([(n,) for n in edges], "n int")
    for row in df.select("n", text.length_bucket("n").alias("b")).collect():
        assert row.b == edges[row.n]


def test_id_prefix_forms(spark):
    df = spark.createDataFrame([("lug_1_2",), ("plain",), ("_x",)], "id string")
    out = df.select(text.id_prefix("id").alias("p"), text.id_group("id").alias("g")).collect()
    assert [(r.p, r.g) for r in out] == [("lug", "lug"), ("", "plain"), ("", "")]


def test_run_ids(spark):
    moment = datetime(2026, 1, 2, 3, 4, 5)
    df = spark.createDataFrame(
        [("  My Run: v2! ", moment), ("!!", moment), ("Éa__b", moment)], "n string, at timestamp"
    )
    rows = df.select(
        text.slug("n").alias("s"), text.run_id("n", "at").alias("r"), text.utc_text("at").alias("u")
    ).collect()
    assert [r.s for r in rows] == ["my_run_v2", "experiment", "éa_b"]
    assert rows[0].r == "20260102_030405_my_run_v2"
    assert rows[0].u == "2026-01-02T03:04:05Z"


def test_roles_prefer_order_then_exact_name():
    assert roles.find_role(["Text", "sentence"], "text") == "sentence"
    assert roles.find_role(["ID", "id"], "id") == "ID"
    assert roles.find_role(["Uid"], "id") == "Uid"
    assert roles.find_role(["x"], "language") is None
    with pytest.raises(roles.MissingColumnError, match="no text column"):
        roles.need_role(["x"], "text")
    with pytest.raises(roles.MissingColumnError, match=r"\['a', 'b'\]"):
        roles.need_columns(["c"], ["b", "a"])
    assert roles.languages_or_default([" en ", " "]) == ["en"]
    assert roles.languages_or_default([" "]) == list(roles.DEFAULT_LANGUAGES)
    assert roles.languages_or_default(None) == list(roles.DEFAULT_LANGUAGES)


def test_canonical_survives_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, 2, "t")], ["ID", "id", "Transcription"])
    row = roles.canonical(df, text="text").first()
    assert row.asDict() == {"id": "1", "text": "t"}


def test_bytes_without_a_flag_are_not_read(spark):
    df = spark.createDataFrame([(("a.wav", bytearray(b"x")),)], "audio struct<path:string,bytes:binary>")
    with pytest.raises(roles.MissingColumnError, match="flag"):
        roles.audio_pointer(df, "audio")


def test_audio_pointer(spark):
    df = spark.createDataFrame(
        [(("a.wav", bytearray(b"x")), "b.wav"), (("c.wav", None), None)],
        "audio struct<path:string,bytes:binary>, plain string",
    )
    rows = df.select(
        roles.audio_pointer(df, "audio", read_bytes=True).alias("a"), roles.audio_pointer(df, "plain").alias("p")
    ).collect()
    assert [tuple(r.a) for r in rows] == [("a.wav", True), ("c.wav", False)]
    assert tuple(rows[0].p) == ("b.wav", False)
    stored = df.select(
        F.struct(F.col("audio.path").alias("path"), F.lit(True).alias("bytes_present")).alias("audio")
    )
    plan = stored.select(roles.audio_pointer(stored, "audio"))._jdf.queryExecution().toString()
    assert "bytes" not in plan.split("Optimized Logical Plan")[1].replace("bytes_present", "")


def test_words_without_collapsing_spaces(spark):
    values = [None, "", "  Hello,   Waxal! ", "l’eau\u3000ﬁn", "...", "a\x1fb", "ÉTÉ à\nla"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    out = df.select(text.normalised_words("t").alias("w"), text.words(text.normalise("t")).alias("n"))
    for value, row in zip(values, out.collect()):
        assert row.w == row.n == expected(value).split(), value


def test_utterances_have_single_spaces(spark, tmp_path):
    """All words of a text, 30 an utterance; lines and runs of gaps become one space."""
    texts = ["a\nb", " \n a  b\n\n\nc \n", "", None, "\tx \t y", "w \n" * 65, " \n ", "one"]
    rows = [(k, t, None if k == 1 else "en", "src0", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.id, r.transcription) for r in tables.utterances(spark, str(tmp_path)).collect())
    wanted = []
    for k, t, lang, *_ in rows:
        words = [w for w in re.split("[ \n]+", t or "") if w]
        cut = [words[i : i + 30] for i in range(0, len(words), 30)]
        wanted += [("_".join([*([lang] if lang else []), str(k), str(i)]), " ".join(c)) for i, c in enumerate(cut)]
    assert found == sorted(wanted)
    plan = tables.utterances(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "[ \n]+" not in plan.replace("\\n", "\n")  # no match is made for every single gap
