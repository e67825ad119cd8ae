"""Hard negatives of anchors, found exactly through a multiway hyperplane tree (Brin, 1995).

Vectors are brought to whole numbers; a score is an inner product.  Vectors ``x`` are lifted
by one coordinate, ``sqrt(M - x.x)`` with ``M`` the largest ``x.x``, to one length: then the
squared distance of two is ``2 M - 2 lift.lift - 2 x.y``, so that for a query, which gets the
coordinate 0, a window of scores is an annulus about it.

**Tree.**  Each node has up to ``FANOUT`` split points, chosen far apart; a vector goes to the
nearest, which cuts space by hyperplanes.  Split points are chosen from at most ``SAMPLE``
vectors, drawn by a hash; then every vector goes down the tree, and each split point
stores the range of its distances to each subtree beside it, of all vectors.  A search
drops a subtree if, for any split point, that range misses the query's annulus widened by
the query's distance to the split point.  Leaves that remain are compared in full.

**Search.**  The sample, whose rows are rows of the table, first gives a query a score that
its answers reach in any case.  Positives are sought within the ball of that score; each
positive's score then opens a window for negatives, narrowed in the same way.  Leaves
lie in blocks of about ``BLOCK`` vectors; a query goes, with its vector and the leaves it
wants, to the blocks that hold them.  Rows of a block stream past in sorted order, so a
task holds one block however many queries there are.

Vectors alike with equal labels are one entry, with as many of their smallest ids as can be
among the answers; a vector that a third of all rows share is one row and one query.
A leaf of more entries than a block is cut by a hash of the entry.

Defined results: rows whose id, label or vector is NULL, whose vector has another length
than ``dim`` or a NULL or non-finite component take no part.  Components become
``floor(scale * x)``, in double precision, at most 2^27 in size (less beyond 64 dimensions),
so that scores fit a long.  Rows that repeat id, label and vector count once; an id listed
with several is an anchor, and a row, for each.  Ties go to the smaller id.  With a
positive of negative score the window is empty.  Fewer answers than asked for are all
returned; without anchors or rows there are none.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribelake.operators.selection import sample_n
from scribelake.session import materialise

SAMPLE = 20_000
FANOUT = 32
LEAF = 512
BLOCK = 8_192
_LARGEST = 27  # bits of a component
_SLACK = 1e-6  # of a length; far more than rounding makes
_QUERIES = 256

_ENTRY = "entry long, label long, vector array<int>, ids array<long>"


@dataclass
class Node:
    """Split points, their subtrees (nodes, or numbers of leaves) and the ranges of distances.

    ``low[i, j]`` and ``high[i, j]`` are over all vectors of subtree ``j``, from split point ``i``.
    """

    points: np.ndarray
    children: list
    low: np.ndarray
    high: np.ndarray


@dataclass
class Tree:
    """The tree over lifted vectors; ``top`` is a node, or 0 if there is but one leaf.

    ``paths`` has for each leaf the subtrees that lead to it, from the top.
    """

    top: object
    nodes: list[Node]
    paths: list[tuple[int, ...]]
    longest: float  # the largest square of a length


def _lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.hstack([vectors, np.sqrt(np.maximum(longest - squares, 0))[:, None]])


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (
        np.einsum("ij,ij->i", rows, rows)[:, None]
        + np.einsum("ij,ij->i", points, points)
        - 2 * (rows @ points.T)
    )
    return np.sqrt(np.maximum(squares, 0))


def _far_apart(rows: np.ndarray, wanted: int) -> np.ndarray:
    """Rows each of which is the farthest from those before it."""
    chosen = [0]
    nearest = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < wanted:
        far = int(nearest.argmax())
        if nearest[far] <= 0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, _distances(rows, rows[far : far + 1])[:, 0])
    return rows[chosen]


def grow(sample: np.ndarray, longest: float, leaf: float, fanout: int = FANOUT) -> Tree:
    """A tree whose leaves hold about ``leaf`` of the ``sample``, lifted vectors; no ranges yet."""
    tree = Tree(0, [], [], longest)

    def split(rows: np.ndarray, path: tuple[int, ...]):
        if len(rows) > max(leaf, 2 * fanout):
            # far apart among some of the rows, or outliers alone would be chosen
            points = _far_apart(rows[:: max(1, len(rows) // (3 * fanout))], fanout)
            if len(points) > 1:
                nearest = _distances(rows, points).argmin(axis=1)
                if np.bincount(nearest).max() < len(rows):
                    none = np.full((len(points), len(points)), np.inf)
                    node = Node(points, [], none, -none)
                    tree.nodes.append(node)
                    node.children = [split(rows[nearest == j], (*path, j)) for j in range(len(points))]
                    return node
        tree.paths.append(path)
        return len(tree.paths) - 1

    tree.top = split(sample, ())
    return tree


def file_vectors(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of each lifted vector."""
    leaves = np.zeros(len(rows), dtype=np.int64)

    def down(node, places: np.ndarray) -> None:
        if not isinstance(node, Node):
            leaves[places] = node
            return
        nearest = _distances(rows[places], node.points).argmin(axis=1)
        for j, child in enumerate(node.children):
            if (here := nearest == j).any():
                down(child, places[here])

    down(tree.top, np.arange(len(rows)))
    return leaves


def widen(tree: Tree, rows: np.ndarray, leaves: np.ndarray) -> None:
    """Make the ranges hold the distances of lifted vectors that lie in the given leaves.

    The way down is the leaf's, not found anew: rounding could lead a vector that is as
    far from two split points elsewhere than where it was filed.
    """

    def down(node, places: np.ndarray, depth: int) -> None:
        if not isinstance(node, Node):
            return
        apart = _distances(rows[places], node.points)
        taken = np.array([tree.paths[leaf][depth] for leaf in leaves[places]])
        for j, child in enumerate(node.children):
            if (here := taken == j).any():
                node.low[:, j] = np.minimum(node.low[:, j], apart[here].min(axis=0))
                node.high[:, j] = np.maximum(node.high[:, j], apart[here].max(axis=0))
                down(child, places[here], depth + 1)

    down(tree.top, np.arange(len(rows)), 0)


def leaves_near(tree: Tree, queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) for every leaf that can hold a vector whose score is in the window."""
    flat = np.hstack([queries, np.zeros((len(queries), 1))])
    base = np.einsum("ij,ij->i", queries, queries) + tree.longest
    slack = _SLACK * np.sqrt(tree.longest + base)
    with np.errstate(invalid="ignore"):
        inner = np.sqrt(np.maximum(base - 2 * most, 0)) - slack
        outer = np.sqrt(np.maximum(base - 2 * least, 0)) + slack
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def down(node, places: np.ndarray) -> None:
        if not isinstance(node, Node):
            found.append((places, np.full(len(places), node)))
            return
        apart = _distances(flat[places], node.points)
        near, far = inner[places, None], outer[places, None]
        closest, farthest = np.maximum(near - apart, apart - far), apart + far
        for j, child in enumerate(node.children):
            meets = (closest <= node.high[:, j]) & (farthest >= node.low[:, j])
            if (alive := meets.all(axis=1)).any():
                down(child, places[alive])

    open_windows = np.flatnonzero(least <= most)
    if len(open_windows):
        down(tree.top, open_windows)
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles while sums stay below 2^53."""
    largest = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    if largest * largest * max(1, queries.shape[1]) < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _entries(
    rows: DataFrame, dim: int, scale: float, most_ids: int, id_col: str, vector_col: str, label: Column
) -> tuple[DataFrame, DataFrame]:
    """(label, vector, ids): equal vectors and labels as one, with their smallest ids; and
    the single rows (id, label, vector).

    Ranks are limited in each task before rows meet, so a common vector is no load.
    """
    bound = 2.0 ** min(_LARGEST, (62 - max(1, dim).bit_length()) // 2)
    whole = F.transform(
        F.col("given"),
        lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-bound)), F.lit(bound))).cast("int"),
    )
    finite = F.forall(
        F.col("given"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = (
        rows.select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            label.cast("long").alias("label"),
            F.col(f"`{vector_col}`").cast("array<double>").alias("given"),
        )
        .where("id IS NOT NULL AND label IS NOT NULL")
        .where((F.size("given") == dim) & finite)
        .select("id", "label", whole.alias("vector"))
        .distinct()
    )
    same = Window.partitionBy("vector", "label").orderBy("id")
    smallest = usable.withColumn("nr", F.row_number().over(same)).where(F.col("nr") <= most_ids)
    grouped = smallest.groupBy("vector", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return grouped, usable


def _plant(
    entries: DataFrame, dim: int, sample: int, leaf: int, fanout: int
) -> tuple[Tree, dict[str, np.ndarray], DataFrame]:
    """The tree with the ranges of all entries' distances, the sample it was grown from, and
    the entries with their leaf."""
    chosen = entries.select(F.col("ids")[0].alias("first"), "label", "vector")
    drawn = sample_n(chosen, sample, key="first").toArrow()
    # entries may come in any order; sorting makes reruns agree on the tree
    drawn = drawn.sort_by([("first", "ascending"), ("label", "ascending")]).combine_chunks()
    n = entries.count()
    vectors = _matrix(drawn.column("vector").combine_chunks(), dim) if len(drawn) else np.empty((0, dim))
    norm = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    longest = float(entries.agg(F.max(norm)).first()[0] or 0)
    tree = grow(_lift(vectors, longest), longest, leaf * len(vectors) / max(1, n), fanout)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = file_vectors(tree, _lift(_matrix(batch.column(2), dim), longest))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves)], names=[*batch.schema.names, "leaf"]
            )

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the function comes with a tree without ranges, its own in every task
        for batch in batches:
            widen(tree, _lift(_matrix(batch.column(0), dim), longest), batch.column(1).to_numpy())
        for k, node in enumerate(tree.nodes):
            if np.isfinite(node.low).any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * node.low.size, pa.int32()),
                        pa.array(np.arange(node.low.size, dtype=np.int32)),
                        pa.array(node.low.ravel()),
                        pa.array(node.high.ravel()),
                    ],
                    names=["node", "cell", "low", "high"],
                )

    filed = materialise(entries.mapInArrow(file, f"{_ENTRY}, leaf long"), "filed")
    # nodes times fanout squared cells, made one in each task first; bounded by the sample
    cells = (
        filed.select("vector", "leaf")
        .mapInArrow(ranges, "node int, cell int, low double, high double")
        .groupBy("node", "cell")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .toArrow()
    )
    for k, cell, low, high in zip(*(cells.column(c).to_pylist() for c in ("node", "cell", "low", "high"))):
        tree.nodes[k].low.flat[cell], tree.nodes[k].high.flat[cell] = low, high
    return tree, {"vectors": vectors, "labels": drawn.column("label").to_numpy()}, filed


def _best_known(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Of each row the ``k``-th largest of the allowed scores, or minus infinity."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    held = np.where(allowed, scores.astype(np.float64), -np.inf)
    return np.partition(held, -k, axis=1)[:, -k]


def _wanted_leaves(
    queries: DataFrame, tree: Tree, known: dict, layout: dict[str, np.ndarray], dim: int, k: int, low: float
) -> DataFrame:
    """(entry, block, leaves) to be compared for each of ``queries`` (entry, label, vector, tops).

    With ``tops`` NULL the ``k`` best of the query's label are sought; else, for each score
    in it, the ``k`` best of other labels from ``low`` times that score up to it.
    """

    # tree, sample and layout, of bounded size, travel with the function
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _QUERIES):
                part = batch.slice(at, _QUERIES)
                vectors = _matrix(part.column(2), dim)
                labels = part.column(1).to_numpy(zero_copy_only=False)
                scores = _scores(vectors, known["vectors"])
                same = labels[:, None] == known["labels"][None, :]
                tops = part.column(3).to_pylist()
                owner, least, most = [], [], []
                for q, of_query in enumerate(tops):
                    if of_query is None:
                        owner.append(q)
                        least.append(_best_known(scores[q : q + 1], same[q : q + 1], k)[0])
                        most.append(np.inf)
                    for top in of_query or ():
                        inside = ~same[q : q + 1] & (scores[q : q + 1] <= top)
                        reached = _best_known(scores[q : q + 1], inside, k)[0]
                        owner.append(q)
                        least.append(max(reached, np.ceil(low * top - 1e-6 * abs(top))))
                        most.append(top)
                owner = np.array(owner, dtype=np.int64)
                window, leaf = leaves_near(
                    tree, vectors[owner], np.array(least, dtype=np.float64), np.array(most, dtype=np.float64)
                )
                # a leaf lies in one block, or, if it is larger, in several
                query, leaf = np.unique(np.stack([owner[window], leaf]), axis=1)
                parts = layout["parts"][leaf]
                offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                query, leaf = np.repeat(query, parts), np.repeat(leaf, parts)
                block = layout["block"][leaf] + offset
                order = np.lexsort((leaf, block, query))
                query, leaf, block = query[order], leaf[order], block[order]
                new = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                ends = np.append(new, len(leaf)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(query[new])),
                        pa.array(block[new]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf)),
                    ],
                    names=["entry", "block", "leaves"],
                )

    return queries.select("entry", "label", "vector", "tops").mapInArrow(
        run, "entry long, block long, leaves array<long>"
    )


def _compare(batches: Iterator[pa.RecordBatch], dim: int, k: int, percent: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, entries before queries; yields each query's best of the block."""
    block, held, leaf_rows = None, [], None
    names = ["entry", "top", "score", "ids"]
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
        for begin, end in zip([0, *edges], [*edges, len(blocks)]):
            part = batch.slice(begin, end - begin)
            if not part.num_rows:
                continue
            if blocks[begin] != block:
                block, held, leaf_rows = blocks[begin], [], None
            if not asks[begin]:
                held.append(part)
                leaf_rows = None
                continue
            if not held:
                continue
            if leaf_rows is None:
                whole = pa.Table.from_batches(held).combine_chunks()
                rows = _matrix(whole.column("vector").combine_chunks(), dim)
                labels = whole.column("label").to_numpy()
                ids = whole.column("ids").combine_chunks()
                # every entry has ids, the smallest first
                firsts = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
                leaf_rows = whole.column("leaf").to_numpy()
            for at in range(0, part.num_rows, _QUERIES):
                asked = part.slice(at, _QUERIES)
                queries = _matrix(asked.column("vector"), dim)
                own = asked.column("label").to_numpy()
                tops = asked.column("tops").to_pylist()
                wanted = asked.column("leaves").to_pylist()
                entries = asked.column("entry").to_numpy()
                scores = _scores(queries, rows)
                found: list[tuple[int, int | None, int, int]] = []
                for q in range(len(queries)):
                    open_rows = np.isin(leaf_rows, wanted[q])
                    same = labels == own[q]
                    if tops[q] is None:
                        choices = [(None, open_rows & same)]
                    else:
                        # 100 * score within percent of the top, in whole numbers
                        choices = [
                            (
                                top,
                                open_rows & ~same & (scores[q] <= top)
                                & (scores[q] >= -((-percent[0] * top) // percent[1])),
                            )
                            for top in tops[q]
                        ]
                    for top, allowed in choices:
                        places = np.flatnonzero(allowed)
                        best = places[np.lexsort((firsts[places], -scores[q, places]))[:k]]
                        found.extend((entries[q], top, scores[q, b], b) for b in best)
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(columns[0], pa.int64()),
                            pa.array(columns[1], pa.int64()),
                            pa.array(columns[2], pa.int64()),
                            ids.take(pa.array(columns[3])),
                        ],
                        names=names,
                    )


def _search(
    queries: DataFrame, filed: DataFrame, wanted: DataFrame, dim: int, k: int, percent: tuple[int, int]
) -> DataFrame:
    """(entry, top, score, ids) of the entries among each query's ``k`` best of any block."""
    asking = wanted.join(queries, "entry").select(
        "block", F.lit(True).alias("asks"), "entry", "label", "vector",
        F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("long").alias("leaf"), "leaves", "tops",
    )
    members = filed.select(
        "block", F.lit(False).alias("asks"), "entry", "label", "vector", "ids", "leaf",
        F.lit(None).cast("array<long>").alias("leaves"), F.lit(None).cast("array<long>").alias("tops"),
    )
    return (
        members.unionByName(asking)
        .repartition("block")
        .sortWithinPartitions("block", "asks")
        .mapInArrow(lambda b: _compare(b, dim, k, percent), "entry long, top long, score long, ids array<long>")
    )


def _layout(filed: DataFrame, block: int) -> DataFrame:
    """(leaf, block, parts): leaves side by side up to ``block`` entries; large ones in parts.

    One row a leaf, of which there are no more than the sample has vectors.
    """
    sizes = filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
    # blocks are spaced so that the parts of a large leaf get numbers of their own
    before = Window.partitionBy(F.lit(0)).orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum("n").over(before), F.lit(0))
    large_before = F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("parts") + 1).otherwise(0)).over(before), F.lit(0))
    placed = sizes.withColumn("parts", parts).withColumn(
        "block", (F.floor(ended / block) + large_before).cast("long")
    )
    return materialise(placed.select("leaf", "block", "parts"), "leaf-blocks")


def _places(layout: DataFrame, n_leaves: int) -> dict[str, np.ndarray]:
    """``layout`` by leaf, no more rows than the sample has; a leaf without entries has no part."""
    found = {"block": np.zeros(n_leaves, dtype=np.int64), "parts": np.zeros(n_leaves, dtype=np.int64)}
    table = layout.toArrow()
    for name, values in found.items():
        values[table.column("leaf").to_numpy()] = table.column(name).to_numpy()
    return found


def mine(
    rows: DataFrame,
    is_anchor: Column,
    dim: int,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    sample: int = SAMPLE,
    leaf: int = LEAF,
    fanout: int = FANOUT,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor``, over id, holds; positives their best
    others of the same label; negatives, for each positive, the best of other labels whose
    score is at most the positive's and at least ``percent`` (a fraction) of it.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    ids_kept = max(positives + 1, negatives)
    grouped, usable = _entries(rows, dim, scale, ids_kept, id_col, vector_col, label)
    # entries are told apart by a number of their own, which writing them fixes
    entries = materialise(
        grouped.select(F.monotonically_increasing_id().alias("entry"), "label", "vector", "ids"), "entries"
    )
    anchors = usable.where(is_anchor).withColumnRenamed("id", "anchor_id")
    anchors = materialise(
        anchors.join(entries.select("entry", "label", "vector"), ["label", "vector"]).select("anchor_id", "entry"),
        "anchors",
    )
    tree, known, filed = _plant(entries, dim, sample, leaf, fanout)
    layout = _layout(filed, block)
    places = _places(layout, len(tree.paths))
    filed = filed.join(layout, "leaf").withColumn(
        "block", F.col("block") + F.pmod(F.xxhash64("entry"), F.col("parts"))
    )
    asked = entries.join(anchors.select("entry").distinct(), "entry").select(
        "entry", "label", "vector", F.lit(None).cast("array<long>").alias("tops")
    )
    asked = materialise(asked, "queries")

    def answers(queries: DataFrame, k: int, by: list[str]) -> DataFrame:
        wanted = _wanted_leaves(queries, tree, known, places, dim, k, percent[0] / percent[1])
        best = _search(queries, filed, wanted, dim, k, percent)
        ranked = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
        listed = best.select("entry", "top", "score", F.explode("ids").alias("id"))
        return listed.withColumn("nr", F.row_number().over(ranked)).where(F.col("nr") <= k)

    # a query is among its own best, so one more is sought and each anchor leaves itself out
    near = materialise(answers(asked, positives + 1, ["entry"]), "positives")
    lists = near.groupBy("entry").agg(
        F.sort_array(F.collect_list(F.struct("nr", "id", "score"))).alias("near"),
        F.collect_set("score").alias("tops"),
    )
    pairs = anchors.join(lists, "entry").select(
        "anchor_id", "entry",
        F.explode(F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)).alias("p"),
    ).select("anchor_id", "entry", F.col("p.id").alias("positive_id"), F.col("p.score").alias("top"))
    windows = materialise(
        asked.drop("tops").join(lists.select("entry", "tops"), "entry").select("entry", "label", "vector", "tops"),
        "windows",
    )
    hard = answers(windows, negatives, ["entry", "top"]).select(
        "entry", "top", F.col("nr").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return pairs.join(hard, ["entry", "top"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("top").alias("positive_score"), "negative_score",
    )
