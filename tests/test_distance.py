import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scribelake.functions import distance, text


def plain(a, b):
    """Textbook dynamic programme."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def random_pairs():
    rng = random.Random(5)
    pairs = [(None, "a b"), ("", ""), ("abc", None), ("a" * 64, "a" * 63 + "b"), ("x" * 128, "y" * 129)]
    pairs += [("same text", "same text"), ("p" * 2000, "q" + "p" * 1990)]
    for k in range(700):
        letters = rng.choice(["ab ", "abé𝄞 ñc", " abcdefghij"])
        size = rng.choice([0, 1, 5, 40, 63, 64, 65, 130, 200])
        a = [rng.choice(letters) for _ in range(size)]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", letters[0], "zz", " "])
        pairs.append((" ".join("".join(a).split()), " ".join("".join(b).split())))
    return pairs


def test_distances_are_exact(spark):
    pairs = random_pairs()
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string"
    )
    out = df.select(
        "i", distance.char_edits("a", "b").alias("c"), distance.word_edits("a", "b").alias("w")
    )
    for row in out.collect():
        a, b = (x or "" for x in pairs[row.i])
        assert row.c == plain(a, b), (a, b)
        assert row.w == plain(a.split(), b.split()), (a, b)


def test_many_scripts_in_one_batch(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(400):
        a = "".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(30))
        pairs.append((a, a[:10] + "x" + a[12:]))
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    for row in df.select("a", "b", distance.char_edits("a", "b").alias("c")).collect():
        assert row.c == plain(row.a, row.b)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc ", max_size=60), st.text("abc ", max_size=60)), min_size=1, max_size=40))
def test_properties(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    both = df.select(
        "a", "b", distance.char_edits("a", "b").alias("d"), distance.char_edits("b", "a").alias("e")
    )
    for row in both.collect():
        assert row.d == row.e == plain(row.a, row.b)
        assert abs(len(row.a) - len(row.b)) <= row.d <= max(len(row.a), len(row.b))


def test_engines_agree(spark):
    rng = random.Random(7)
    pairs = random_pairs()[:150] + [("", "a b"), ("a" * 1024, "b" * 1024), ("ab " * 400, "ba " * 390)]
    # more words than letters of the short code, and few of many repeated
    many = " ".join(f"w{k}" for k in range(150))
    pairs += [(many, many.replace("w7", "v")), (" ".join(rng.choices("abc", k=200)), "a b c a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", *(
        f("a", "b", e).alias(f"{n}_{e}")
        for n, f in (("c", distance.char_edits), ("w", distance.word_edits)) for e in ("arrow", "jvm")
    ))
    for row in out.collect():
        a, b = row.a or "", row.b or ""
        assert row.c_arrow == row.c_jvm == plain(a, b), (a, b)
        assert row.w_arrow == row.w_jvm == plain(a.split(), b.split()), (a, b)


def test_pairs_are_counted_side_by_side(spark):
    """By batches, not by one call of the built-in a pair."""
    df = spark.createDataFrame([("a b", "b")], "a string, b string")
    plan = df.select(distance.char_edits("a", "b"), distance.word_edits("a", "b"))
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    for f in (distance.char_edits, distance.word_edits):
        plan = df.select(f("a", "b", "jvm"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan


def test_the_narrow_band_is_tried_once(spark):
    df = spark.createDataFrame([("a b", "b")], "a string, b string")
    plan = df.select(distance.char_edits("a", "b", "jvm").alias("d"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("levenshtein(") == 2  # within the band, and without


def test_most_pairs_are_decided_near_the_diagonal():
    """By one word a column, however long they are; what 64 diagonals cannot tell is left."""
    rng = random.Random(8)
    a = [rng.randrange(30) for _ in range(900)]
    near = a[:100] + [31] + a[103:500] + [32] * 9 + a[500:]
    pairs = [(a, near), (a, a), (a, a[70:]), (a[:300], a[::-1]), ([], a[:40]), (a[:63], []), (a, a[63:])]
    pairs.sort(key=lambda p: -len(p[1]))
    texts = [x for x, _ in pairs] + [y for _, y in pairs]
    codes = np.array([c for x in texts for c in x] + [99], np.uint8)
    lengths = np.array([len(x) for x in texts])
    (n, m), (at_a, at_b) = np.split(lengths, 2), np.split(np.cumsum(lengths) - lengths, 2)
    found, sure = distance._near_diagonal(codes, n, m, at_a, at_b)
    for (x, y), d, exact in zip(pairs, found, sure):
        assert d == plain(x, y) if exact else d >= plain(x, y) or abs(len(x) - len(y)) > 63
    assert [exact for (x, y), exact in zip(pairs, sure) if (x, y) in ((a, near), (a, a), (a, a[63:]))] == [True] * 3
    assert not any(exact for (x, y), exact in zip(pairs, sure) if y in (a[70:], a[::-1]))
    assert list(distance._distances(codes[:-1], lengths)) == [plain(x, y) for x, y in pairs]


def test_common_ends_do_not_reach_the_builtin(spark):
    """What both texts begin and end with is cut off, without cutting a character twice."""
    rng = random.Random(4)
    long = "".join(rng.choice("abé ") for _ in range(200))
    pairs = [(long, long[:120] + "x" + long[123:]), ("a" * 90, "a" * 70), ("", long), (long, ""), ("é" * 8, "é" * 9)]
    pairs += [("".join(rng.choices("aé", k=rng.randrange(40))), "".join(rng.choices("aé", k=rng.randrange(40)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rest = df.select(distance._trimmed(df.a, df.b).alias("t")).select("t.*").collect()
    assert max(len(rest[0].a), len(rest[0].b)) < 20 and {len(rest[1].a), len(rest[1].b)} == {26, 6}
    found = df.select("a", "b", distance.char_edits("a", "b", "jvm").alias("d")).collect()
    assert [r.d for r in found] == [plain(r.a, r.b) for r in found]


def test_words_are_split_once_a_text(spark):
    df = spark.createDataFrame([("a b", "b")], "a string, b string")
    plan = df.select(distance.word_edits("a", "b", "jvm").alias("d"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("split(") == 2


def test_pairs_are_tried_by_words_that_reach_their_ends(monkeypatch):
    """32 diagonals first, then 64; what is left of all pairs is counted together."""
    rng = random.Random(9)
    a = [rng.randrange(40) for _ in range(120)]
    pairs = [(a, a[:50] + [41] + a[50:]), (a, a[::-1]), (a, a[40:]), (a, a[90:]), (a[:20], a), ([], []), ([], a[:5])]
    pairs += [(a[: rng.randrange(120)], a[rng.randrange(40) :]) for _ in range(40)]
    tried, near = [], distance._near_diagonal

    def watched(codes, n, m, at_a, at_b, kind):
        tried.append((kind, len(n), int(abs(n - m).max())))
        return near(codes, n, m, at_a, at_b, kind)

    monkeypatch.setattr(distance, "_near_diagonal", watched)
    monkeypatch.setattr(distance, "ROWS", 8)
    texts = [x for x, _ in pairs] + [y for _, y in pairs]
    found = distance._distances(np.array([c for x in texts for c in x], np.uint8), np.array([len(x) for x in texts]))
    assert list(found) == [plain(x, y) for x, y in pairs]
    assert {k for k, _, _ in tried} == {np.uint32, np.uint64}
    assert all(rows <= 8 and gap < 8 * kind().itemsize for kind, rows, gap in tried)


def test_words_of_raw_texts(spark):
    """Split at any whitespace there is, in Python as in the JVM, long and equal texts too."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    split = pc.utf8_split_whitespace(pa.array([f"a{chr(c)}b" for c in points]))
    lengths = pc.list_value_length(split).to_pylist()
    assert {chr(c) for c, n in zip(points, lengths) if n == 2} == set(text.WHITESPACE)
    odd = [" \ta　b\x85\n", "a  b", "", None, " ", "a,B c", "a b " * 300, "\xa0x", "x"]
    pairs = [(a, b) for a in odd for b in odd]
    edits, total = distance.raw_word_edits("a", "b")
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", edits.alias("e"), total.alias("n"))
    for row in rows.collect():
        a, b = (row.a or "").split(), (row.b or "").split()
        assert (row.e, row.n) == (plain(a, b), len(a)), (row.a, row.b)
