"""Merkle manifests against a plain tree built in Python."""

import math
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from scribelake.llm import merkle
from scribelake.llm.queries import bucket


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][k : k + 8]) for k in range(0, len(found[-1]), 8)])
    return found


def path(levels, k):
    """(nodes to the left, nodes to the right) by level."""
    for nodes in levels[:-1]:
        begin = k - k % 8
        yield nodes[begin:k], nodes[k + 1 : begin + 8]
        k //= 8


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text, presented text)."""
    groups = {}
    for row in rows:
        stored, shown = (digest(*map(written, (*row[:4], text))) for text in row[4:])
        groups.setdefault(row[2], []).append((row[0], stored, shown))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = levels_of([r[1] for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    found = []
    for at, g in enumerate(order):
        for k, (doc_id, stored, shown) in enumerate(groups[g]):
            steps = [*path(trees[g], k), *path(top, at)]
            node = shown
            for left, right in steps:
                node = digest(*left, node, *right)
            proof = digest(*(x for left, right in steps for x in left + right))
            root = top[-1][0]
            found.append((doc_id, stored, trees[g][-1][0], root, proof, node, node == root))
    return sorted(map(str, found))


def run(frame, depth, presented=None):
    found = merkle.manifest(frame, presented=presented, depth=depth)
    assert found.columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    ]
    return sorted(str(tuple(r)) for r in found.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_documents_as_by_hand(spark, documents, depth):
    lower = F.when(bucket("doc_id", 3) == 0, F.lower("text")).otherwise(F.col("text"))
    rows = documents.select("doc_id", "source", "lang", "n_chars", "text", lower).collect()
    found = run(documents, depth, {"text": lower})
    assert found == expected([tuple(r) for r in rows])
    assert any(r.endswith("False)") for r in found) and any(r.endswith("True)") for r in found)


def test_odd_rows(spark, odd_documents):
    rows = odd_documents.select("doc_id", "source", "lang", "n_chars", "text", "text").collect()
    assert run(odd_documents, 1) == expected([tuple(r) for r in rows])


def test_groups_of_all_sizes_and_many_groups(spark):
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 130, 513, *([1] * 70), *([3] * 20)]
    rows = [
        (2**60 + 7 * i, f"s{i % 3}", f"g{g:03}", i, f"text {i} of Gé {g}")
        for g, n in enumerate(sizes)
        for i in range(n)
    ]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert run(frame, 1) == expected([(*r, r[4]) for r in rows])


def test_repeated_rows_have_places_of_their_own(spark):
    rows = [(1, "s", "en", 1, "same")] * 100 + [(k, "s", "en", 1, "x") for k in range(30)]
    found = run(spark.createDataFrame(rows, SCHEMA).repartition(4), 1)
    assert found == expected([(*r, r[4]) for r in rows])


def test_any_change_of_a_field_is_found(spark):
    frame = spark.createDataFrame([(k, "s", "en", k, "t") for k in range(20)], SCHEMA)
    changed = F.when(F.col("doc_id") == 7, F.lit(None)).otherwise(F.col("source"))
    found = merkle.manifest(frame, presented={"source": changed}, depth=1).where("NOT verified")
    assert [r.doc_id for r in found.collect()] == [7]


def test_height_is_that_of_the_tree():
    assert [merkle._height(n) for n in (1, 2, 8, 9, 64, 65)] == [0, 1, 1, 2, 2, 3]
    assert merkle._height(8**5) == round(math.log(8**5, 8))


def test_no_rows(spark, no_documents):
    found = merkle.manifest(no_documents)
    assert found.count() == 0 and dict(found.dtypes)["doc_id"] == "bigint"
