"""Hard negatives against all pairs; what the tree's ranges leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelake.llm import hard_negatives as H

DIM = 6
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, is_anchor, positives=5, negatives=5, percent=(80, 100), scale=256):
    """rows: (id, vector, label)."""
    usable = sorted(
        {
            (i, label, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v))
            for i, v, label in rows
            if i is not None and label is not None and v is not None and len(v) == DIM
            and all(x is not None and np.isfinite(x) for x in v)
        }
    )
    found = []
    for a, label, v in usable:
        if not is_anchor(a):
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in usable if i != a)
        )
        for s, p, same in [x for x in scored if x[2]][:positives]:
            top = -s
            fits = [
                (-t, n) for t, n, same in scored
                if not same and percent[0] * top <= percent[1] * -t <= percent[1] * top
            ][:negatives]
            found.extend((a, p, rank, n, top, t) for rank, (t, n) in enumerate(fits, 1))
    return sorted(found)


def run(spark, rows, is_anchor, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = H.mine(frame, is_anchor, DIM, **options)
    assert found.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    return sorted(map(tuple, found.collect()))


def clusters(n, dim, groups=12, spread=0.15, seed=5):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, dim))
    return centres[random.integers(groups, size=n)] + spread * random.normal(size=(n, dim))


SMALL = {"sample": 200, "leaf": 20, "fanout": 3, "block": 50}


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_equals_all_pairs(spark, spread):
    vectors = clusters(600, DIM, spread=spread)
    rows = [(k, v.tolist(), int(k * 7 % 4)) for k, v in enumerate(vectors)]
    found = run(spark, rows, F.col("id") % 15 == 0, **SMALL)
    assert found == brute_force(rows, lambda i: i % 15 == 0) and found


def test_ties_repeats_and_a_common_vector(spark):
    same = [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]
    rows = [(k, same, k % 3) for k in range(300)]
    rows += [(1000 + k, [0.5, 0.25 - k / 256, 0.0, 0.0, 0.0, 0.0], k % 3) for k in range(60)]
    rows += rows[:50]
    found = run(spark, rows, F.col("id") % 20 == 0, **SMALL)
    assert found == brute_force(rows, lambda i: i % 20 == 0) and found


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [1.0] * DIM, 1),
        (1, None, 1),
        (2, [1.0] * DIM, None),
        (3, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
        (4, [nan] * DIM, 1),
        (5, [inf] + [0.0] * 5, 1),
        (6, [1.0] * 3, 1),
        (7, [], 1),
        (8, [0.0] * DIM, 1),
        (9, [0.0] * DIM, 2),
        (10, [-1.0] * DIM, 1),
        (11, [1.0] * DIM, 1),
        (12, [0.9] * DIM, 2),
        (13, [1.0] * DIM, 1),
        (13, [0.5] * DIM, 2),
        (-14, [0.95] * DIM, 3),
    ]
    found = run(spark, rows, F.lit(True))
    assert found == brute_force(rows, lambda i: True)
    assert {f[0] for f in found} >= {8, 11}


def test_very_large_components_are_bounded(spark):
    rows = [(k, [float(10 ** (6 * k))] + [0.0] * 5, k % 2) for k in range(6)]
    found = run(spark, rows, F.lit(True))
    assert all(abs(f[4]) < 2**63 and f[5] <= f[4] for f in found)


def test_fewer_rows_than_asked_for_and_none(spark):
    rows = [(1, [1.0] * DIM, 1), (2, [1.0] * DIM, 1), (3, [0.9] * DIM, 2)]
    assert run(spark, rows, F.lit(True)) == brute_force(rows, lambda i: True)
    assert run(spark, rows, F.lit(False)) == []
    assert run(spark, rows[:1], F.lit(True)) == []
    assert H.mine(spark.createDataFrame([], SCHEMA), F.lit(True), DIM).count() == 0


def test_clashing_columns_and_other_numbers_asked_for(spark):
    vectors = clusters(150, DIM)
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("entry", "ids", "vector", "block", "leaf", "id", "tops", "score"):
        frame = frame.withColumn(name, F.lit("x"))
    found = H.mine(frame, F.col("id") % 10 == 0, DIM, positives=2, negatives=7, percent=(50, 100))
    assert sorted(map(tuple, found.collect())) == brute_force(rows, lambda i: i % 10 == 0, 2, 7, (50, 100))


def test_ranges_drop_subtrees_and_never_an_answer():
    """On clusters the windows leave most rows out; on vectors without structure few."""
    for spread, dim, most in ((0.05, 16, 0.1), (5.0, 16, 1.0)):
        rows = np.floor(256 * clusters(8000, dim, groups=40, spread=spread))
        longest = float((rows**2).sum(axis=1).max())
        lifted = H._lift(rows, longest)
        tree = H.grow(lifted[::4], longest, 25)
        leaves = H.file_vectors(tree, lifted)
        H.widen(tree, lifted, leaves)
        sizes = np.bincount(leaves, minlength=len(tree.paths))
        queries = rows[::100]
        scores = queries @ rows.T
        tops = np.sort(scores, axis=1)[:, -30]
        least, compared = np.ceil(0.98 * tops), 0
        window, leaf = H.leaves_near(tree, queries, least, tops)
        near = np.zeros((len(queries), len(tree.paths)), dtype=bool)
        near[window, leaf] = True
        for q in range(len(queries)):
            inside = (scores[q] >= least[q]) & (scores[q] <= tops[q])
            assert near[q, leaves[inside]].all()
            compared += sizes[near[q]].sum()
        assert compared <= most * len(queries) * len(rows)
        assert len(tree.paths) > 20


def test_parts_of_large_leaves_have_blocks_of_their_own(spark):
    sizes = {0: 10, 1: 500, 2: 30, 3: 260, 4: 5, 5: 49, 6: 51}
    filed = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "leaf long")
    held = {}
    for row in H._layout(filed, 50).collect():
        for part in range(row.parts):
            held.setdefault(row.block + part, []).append((row.leaf, -(-sizes[row.leaf] // row.parts)))
    assert all(sum(n for _, n in leaves) <= 101 for leaves in held.values())
    assert sum(len(v) for v in held.values()) == sum(max(1, -(-n // 50)) for n in sizes.values())
