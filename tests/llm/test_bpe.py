import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scribelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def spelling():
    with open(PATH, "rb") as file:
        return bpe.Spelling(file.read())


def ids(vocabulary, texts):
    flat, ends = vocabulary.encode(texts)
    return [x.tolist() for x in np.split(flat, ends[:-1])]


PIECES = [
    " ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "1", "²", "'s", "'ll", "!", "<|endoftext|>", "<|endo",
    "\u00a0", "\u3000", "日本", "\x1c", "\x85", "😀", "_", "-", "the", " quick", "e\u0301", "\x00",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=12))
def test_equals_the_library(vocabulary, library, spelling, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(vocabulary, [text])[0] == want
    assert spelling.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_words_and_batches(vocabulary, library):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (60, 63, 64, 65, 66, 300, 5000)]
    texts = ["", " ", *words, " ".join(words), "a " * 50, "", "x<|endoftext|>y z"]
    assert ids(vocabulary, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_any_ids_decode_as_the_library_does(spelling, library):
    rnd = random.Random(4)
    for _ in range(500):
        some = [rnd.randrange(50257) for _ in range(4)]
        assert spelling.decode(some) == library.decode(some, skip_special_tokens=False)
    assert spelling.decode([None, 60_000, 50_256]) == "<|endoftext|>"


def test_whole_table_round_trip(documents, library):
    coded = bpe.decode(bpe.encode(documents, PATH), PATH).collect()
    assert len(coded) == documents.count()
    for r in coded:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert sorted(bpe.round_trip(documents, PATH).collect()) == sorted(coded)


def test_portions_do_not_matter(documents, monkeypatch):
    want = {r.doc_id: r.ids for r in bpe.encode(documents, PATH).collect()}
    monkeypatch.setattr(bpe, "_CHARS_AT_ONCE", 500)
    monkeypatch.setattr(bpe, "_RUNS_AT_ONCE", 7)
    monkeypatch.setattr(bpe, "_WORDS_AT_ONCE", 5)
    assert {r.doc_id: r.ids for r in bpe.encode(documents, PATH).collect()} == want


def test_long_texts_are_cut_at_word_ends(vocabulary, library, monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(bpe, "_CHARS_AT_ONCE", 40)
    texts = ["".join(rnd.choice(PIECES + ["word", " of", " it"]) for _ in range(n)) for n in range(120)]
    texts += ["x" * 500, " " * 200, "a" + "  b" * 100, None, "a b " * 40]
    got = bpe.encode_all(vocabulary, pa.array(texts)).to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_odd_rows(spark, odd_documents, no_documents, library):
    rows = bpe.decode(bpe.encode(odd_documents, PATH), PATH).collect()
    assert [r.decoded for r in rows] == [r.text or "" for r in rows]
    assert bpe.encode(odd_documents, PATH).columns == [*odd_documents.columns, "ids"]
    assert bpe.encode(no_documents, PATH).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([None, 1],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(nulls, PATH).collect()] == ["", "", '"']


def test_a_large_file_is_refused(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError, match="above"):
        bpe.read_vocabulary(spark, PATH)
