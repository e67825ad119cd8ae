import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty and long texts, repeats, and columns with clashing names."""
    long_text = " ".join(f"Word{k % 97} x{k % 13}" for k in range(40_000))
    rows = [
        (1, "a b c", "en", "s1", 5),
        (2, "a b c", "en", "s1", 5),
        (2, "a b c", "en", "s1", 5),
        (3, "", None, None, None),
        (4, None, "fr", "s2", None),
        (None, "a b c", "de", "s2", 1),
        (None, None, None, None, None),
        (5, long_text, "en", "s1", len(long_text)),
        (6, long_text + " z", "en", None, 1),
        (7, "!!! 123", "en", "s3", 7),
        (8, "x" * 20_000, "de", "s3", 1),
        (-9, "Über den Wolken", "de", "s3", 1),
    ]
    extra = [(*r, "e", 0, 0.5, 1, "k", "r") for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "digest string, shard int, score double, size int, content string, row string"
    return spark.createDataFrame(extra, f"{names}, {clash}")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
