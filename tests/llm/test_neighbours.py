import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelake.llm import neighbours
from scribelake.llm.queries import QUERIES


def brute(ids, vectors, queries, k):
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    found = {}
    for q in queries:
        score = vectors @ vectors[q] / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != ids[q]]
        found[ids[q]] = [(ids[i], score[i]) for i in order[:k]]
    return found


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall(spark, scale):
    path = f"/root/testdata/{scale}"
    table = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), dtype=np.float64)
    want = brute(ids, vectors, np.flatnonzero(ids % 50 == 0), 5)
    rows = QUERIES["op1_hilbert_neighbours"](spark, path).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, found in got.items():
        exact = {i: s for i, s in brute(ids, vectors, [int(np.flatnonzero(ids == q)[0])], len(ids))[q]}
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in found)


def test_small_table_is_exact_with_copies_and_ties(spark):
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(120, 4))
    vectors[20:90] = vectors[20]
    rows = [(int(i), v.tolist(), 0, 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    found = neighbours.nearest(frame, F.col("id") % 10 == 0, dim=4, curves=2, block=16, window=1.0)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(120), vectors, range(0, 120, 10), 5)
    assert got == {q: [i for i, _ in v] for q, v in want.items()}


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [0.0, 1e-30]),
    ]
    schema = "vec_id long, embedding array<double>"
    found = neighbours.nearest(spark.createDataFrame(rows, schema), F.lit(True), dim=2).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in found}
    assert got == {(0, 1): (1, 1.0), (0, 2): (8, 0.0), (1, 1): (0, 1.0), (1, 2): (8, 0.0), (8, 1): (0, 0.0), (8, 2): (1, 0.0)}
    assert neighbours.nearest(spark.createDataFrame([], schema), F.lit(True), dim=2).count() == 0


def test_hilbert_curves_visit_every_cell_by_single_steps():
    for n, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * n), axis=-1).reshape(-1, n)
        place = neighbours.hilbert(cells, bits)
        assert sorted(place) == list(range(side**n))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def nearest_ids(spark, ids, vectors, asks, **options):
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame, asks, dim=vectors.shape[1], **options).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("spread", [1e-2, 1e-5])
def test_recall_with_a_third_of_all_rows_about_one_centre(spark, spread):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(6000, 16))
    vectors[::3] = vectors[0] + spread * rnd.normal(size=(2000, 16))
    vectors[::6] *= 3.7  # scaled as well
    ids = rnd.permutation(6000)
    crowd = set(ids[::3])
    got = nearest_ids(spark, ids, vectors, F.col("id") % 20 == 0, block=32)
    want = brute(ids, vectors, np.flatnonzero(ids % 20 == 0), 5)
    # as brute() takes cosines for ties that differ by less than 1e-12, by distance
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in want:
        gap = np.square(unit - unit[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        want[q] = [i for i in ids[np.argsort(gap)] if i != q][:5]
    asked = [q for q in want if q in crowd]
    hits = sum(len(set(got[q]) & set(want[q])) for q in asked)
    assert len(asked) > 50 and hits / (5 * len(asked)) >= 0.9


def test_multiples_of_a_vector_are_ties(spark):
    rnd = np.random.default_rng(4)
    vectors = rnd.normal(size=(400, 8))
    vectors[100:300] = np.outer(np.arange(1, 201), np.round(vectors[100] * 64))
    ids = rnd.permutation(400)
    got = nearest_ids(spark, ids, vectors, F.lit(True), curves=2, block=16, window=1.0)
    group = sorted(ids[100:300])
    for q in group:
        # cosines of 1 that differ in the last digit order the smallest six
        assert len(got[q]) == 5 and set(got[q]) <= set(group[:6]) - {q}
    powers = np.outer(2.0 ** np.arange(40), np.round(vectors[100] * 64))
    got = nearest_ids(spark, np.arange(40)[::-1], powers, F.lit(True), curves=1, window=1.0)
    assert all(got[q] == [i for i in range(40) if i != q][:5] for q in got)


def test_scores_are_of_the_vectors_as_given(spark):
    rnd = np.random.default_rng(6)
    vectors = rnd.normal(size=(60, 16)).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(frame, F.lit(True), dim=16).collect()
    wide = vectors.astype(np.float64)
    for r in found:
        dot = aa = bb = 0.0
        for x, y in zip(wide[r.query_id].tolist(), wide[r.vec_id].tolist()):
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
        assert r.score == dot / (aa**0.5 * bb**0.5)
    assert len(found) == 300
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e300, 1e300])], "vec_id long, embedding array<double>")
    assert [round(r.score, 9) for r in neighbours.nearest(huge, F.lit(True), dim=2).collect()] == [0.707106781] * 2


def looked_at(vectors, asks, curves=neighbours.CURVES, window=neighbours.WINDOW):
    """Recall of the five nearest and share of all pairs compared, by the module's own curves."""
    n, dim = vectors.shape
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    reach = max(neighbours.LEAST, int(np.ceil(window * n)))
    seen = np.zeros((len(asks), n), dtype=bool)
    pairs = 0
    for c in range(curves):
        rotation, shift = neighbours._orders(c, dim, min(neighbours.DIRECTIONS, dim))
        wide = neighbours._REACH
        grid = ((unit * np.sqrt(dim)) @ rotation + wide + shift) / (2 * wide + 1) * (1 << neighbours.BITS)
        cells = np.clip(grid, 0, (1 << neighbours.BITS) - 1).astype(np.int64)
        packed = np.packbits(neighbours._digits(cells, neighbours.BITS), axis=1)
        order = np.lexsort(packed.T[::-1])
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        for row, q in enumerate(asks):
            near = order[max(0, place[q] - reach) : place[q] + reach + 1]
            seen[row, near] = True
            pairs += len(near)
    hits = 0
    for row, q in enumerate(asks):
        score = unit @ unit[q]
        score[q] = -2
        hits += seen[row, np.argpartition(-score, 5)[:5]].sum()
    return hits / (5 * len(asks)), pairs / (len(asks) * n)


def test_recall_and_work_beyond_brute_force():
    """20,000 vectors: without structure well below all pairs, in clusters far below."""
    rnd = np.random.default_rng(7)
    asks = np.arange(0, 20_000, 100)
    recall, share = looked_at(rnd.normal(size=(20_000, 64)), asks)
    assert recall >= 0.9 and share <= 0.65
    centres = rnd.normal(size=(200, 64))
    clustered = centres[rnd.integers(200, size=20_000)] + 0.3 * rnd.normal(size=(20_000, 64))
    recall, share = looked_at(clustered, asks, curves=8, window=0.005)
    assert recall >= 0.9 and share <= 0.1


def test_a_block_with_many_equal_cosines_yields_the_smallest_ids(spark):
    vectors = np.vstack([np.eye(40), -np.eye(40)])
    ids = np.random.default_rng(5).permutation(80)
    got = nearest_ids(spark, ids, vectors, F.lit(True), curves=1, block=128, window=1.0)
    for q, found in got.items():
        opposite = ids[(np.flatnonzero(ids == q)[0] + 40) % 80]
        assert found == [i for i in range(80) if i not in (q, opposite)][:5]
