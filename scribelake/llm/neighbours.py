"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are brought to length one and projected, once per curve, on a few random
orthogonal directions; a random shift and a grid turn the projection into a place on a
Hilbert curve.  The grid is about as fine as single precision, so that vectors crowded about
one point are still ordered by position.  Spark sorts all curves' places by range, which gives
every vector a position on every curve.  A query looks at the positions around its own,
``window`` of all rows on either side but ``LEAST`` at least, on every curve; what it finds
is merged per query, and the shortlist is ranked anew by the cosine, in double precision,
of the vectors as they were given.

Each curve is stored in blocks of ``BLOCK`` positions, which have nothing to do with what is
compared: a query goes to the blocks that its window touches and compares there the part
of the block inside its window.  Rows of a block stream past its queries in sorted order, so
a task holds one block however many queries there are.

Vectors of one direction are one entry of the index that carries its smallest ids, as many
as can be among the answers; so a vector that a third of all rows share, or multiples of
it, is one row of the curves and one query.

How near a neighbour lies on a curve depends on the data.  Where vectors have no structure
at all, as random ones in many dimensions, any curve keeps neighbours only a little closer
than chance, so the window is a share of the rows, not a number of them; many curves with
narrow windows find more for the same work than few with wide ones.

Defined results: rows whose vector is NULL, of another length than ``dim``, all zero, or
has a NULL or non-finite component take no part, nor do rows without id.  Rows that repeat
id and direction count once, with the smallest of their vectors.  Ties go to the smaller
id; cosines with multiples of a vector may differ in their last digits, and then do not tie.
Where squares leave the range of a double the cosine is taken of the vectors by their
largest component.  With fewer candidates than ``k`` all are returned; a query is never its
own answer.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribelake.session import materialise

CURVES = 32
WINDOW = 0.01
LEAST = 32
BLOCK = 1024
DIRECTIONS, BITS = 8, 24
_NOISE = 1e-9  # far more than a matrix product differs from a single pair's
_REACH = 3.5  # grids end at so many standard deviations of a random direction


def _usable(vector: Column, dim: int) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def _direction(vector: Column) -> Column:
    """The vector by its largest component: alike, to the last digit, for all its multiples."""
    largest = F.array_max(F.transform(vector, F.abs))
    # repeated beside the vector, as a lambda would look for it anew at each component
    return F.zip_with(vector, F.array_repeat(largest, F.size(vector)), lambda x, m: x / m)


def _orders(curve: int, dim: int, directions: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(curve)
    rotation = np.linalg.qr(random.normal(size=(dim, dim)))[0][:, :directions]
    return rotation, random.uniform(0, 1, directions)


def _digits(cells: np.ndarray, bits: int) -> np.ndarray:
    """Row, level and dimension: the bits of each place on the Hilbert curve (Skilling, 2004)."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    levels = np.arange(bits - 1, -1, -1)
    return ((x.T[:, None, :] >> levels[:, None]) & 1).astype(np.uint8).reshape(len(cells), -1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers, as one number."""
    place = np.zeros(len(cells), dtype=np.int64)
    for digit in _digits(cells, bits).T:
        place = (place << 1) | digit
    return place


def _places(cells: np.ndarray, bits: int) -> pa.Array:
    """The same as bytes, which sort like the numbers and may be of any length."""
    packed = np.packbits(_digits(cells, bits), axis=1)
    ends = np.arange(len(packed) + 1, dtype=np.int32) * packed.shape[1]
    return pa.Array.from_buffers(
        pa.binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(packed.tobytes())]
    )


def _directions(blobs: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Packed vectors as rows, each divided by its largest component."""
    flat = np.frombuffer(blobs.buffers()[2] or b"", dtype=kind)
    begin = blobs.offset * dim
    rows = flat[begin : begin + len(blobs) * dim].reshape(-1, dim).astype(np.float64)
    return rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows


def _packed(entries: DataFrame, kind: type) -> DataFrame:
    """(entry, blob): the vector of each entry's smallest id, as bytes of its own precision."""
    width = np.dtype(kind).itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths * width)]).astype(np.int32)
            blobs = pa.Array.from_buffers(
                pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], names=["entry", "blob"])

    first = entries.select("entry", F.col("ids")[0]["given"].alias("given"))
    return materialise(first.mapInArrow(pack, "entry long, blob binary"), "packed")


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(entry, vector, ids): equal directions as one, with up to ``k + 1`` smallest ids.

    ``ids`` holds them with the vectors as they were given.  The ranking is limited in each
    task before rows meet, so a common vector is no load.
    """
    same = Window.partitionBy("vector").orderBy("id")
    smallest = rows.withColumn("nr", F.row_number().over(same)).where(F.col("nr") <= k + 1)
    return (
        smallest.groupBy("vector")
        .agg(F.sort_array(F.collect_list(F.struct("id", "given"))).alias("ids"))
        .select(F.col("ids")[0]["id"].alias("entry"), "vector", "ids")
    )


def _order(packed: DataFrame, dim: int, kind: type, curves: int) -> DataFrame:
    """(entry, nr): every entry's number in the long order of all curves."""
    directions = min(DIRECTIONS, dim)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = [_orders(c, dim, directions) for c in range(curves)]
        for batch in batches:
            unit = _directions(batch.column(1), dim, kind)
            unit *= np.sqrt(dim) / np.linalg.norm(unit, axis=1, keepdims=True)
            for c, (rotation, shift) in enumerate(drawn):
                grid = ((unit @ rotation + _REACH + shift) / (2 * _REACH + 1)) * (1 << BITS)
                cells = np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(unit), c, dtype=np.int32)),
                        _places(cells, BITS),
                        batch.column(0).cast(pa.int64()),
                    ],
                    names=["curve", "place", "entry"],
                )

    # written, as a sort by range looks at its rows twice
    placed = materialise(packed.mapInArrow(places, "curve int, place binary, entry long"), "places")
    # the sorted rows are written with their partition and row in it, which do not change then
    row = F.monotonically_increasing_id()
    in_order = materialise(
        placed.repartitionByRange("curve", "place", "entry")
        .sortWithinPartitions("curve", "place", "entry")
        .select("entry", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("row")),
        "order",
    )
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # one row per partition
    firsts = (
        in_order.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", (F.sum("n").over(before) - F.col("n")).alias("first"))
    )
    return in_order.join(firsts, "part").select("entry", (F.col("first") + F.col("row")).alias("nr"))


def _search_blocks(
    batches: Iterator[pa.RecordBatch], dim: int, kind: type, k: int, window: int
) -> Iterator[pa.RecordBatch]:
    """Rows come by block, entries before queries, each by position; yields what each query's
    window holds of the block, the nearest only."""
    block, held = None, []
    names = vectors = norms = places = None
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        is_query = batch.column(1).to_numpy(zero_copy_only=False)
        ids, positions = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        rows = _directions(batch.column(4), dim, kind)
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
        for begin, end in zip([0, *edges], [*edges, len(blocks)]):
            if begin == end:
                continue
            if blocks[begin] != block:
                block, held, vectors = blocks[begin], [], None
            if not is_query[begin]:
                held.append((ids[begin:end], positions[begin:end], rows[begin:end]))
                vectors = None
                continue
            if not held:
                continue
            if vectors is None:
                names, places, vectors = (np.concatenate([h[c] for h in held]) for c in range(3))
                norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            lengths = np.sqrt(np.einsum("ij,ij->i", rows[begin:end], rows[begin:end]))
            lows = np.searchsorted(places, positions[begin:end] - window)
            highs = np.searchsorted(places, positions[begin:end] + window, side="right")
            for q in range(end - begin):
                low, high = lows[q], highs[q]
                if low >= high:
                    continue
                query, length = rows[begin + q], lengths[q]
                near = vectors[low:high] @ query / (length * norms[low:high])
                # an entry of several ids fills k places alone, so k + 1 entries are enough
                few = min(k + 1, high - low)
                least = np.partition(near, -few)[-few]
                at = low + np.flatnonzero(near >= least - _NOISE)
                # as one would compute a single pair, so that blocks agree to the last digit
                score = np.einsum("ij,j->i", vectors[at], query) / (length * norms[at])
                # ties go to the smaller id here as well
                best = np.lexsort((names[at], -score))[:few]
                found.append((np.full(len(best), ids[begin + q]), names[at[best]], score[best]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[c] for f in found])) for c in range(3)],
                    names=["query", "entry", "score"],
                )


def _cosine(a: Column, b: Column) -> Column:
    """In double precision, term by term; NULL where a square leaves its range."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((lengths > 0) & (lengths < F.lit(float("inf"))), dot(a, b) / F.nullif(lengths, F.lit(0.0)))


def nearest(
    rows: DataFrame,
    is_query: Column,
    dim: int,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    window: float = WINDOW,
    block: int = BLOCK,
    least: int = LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``is_query``, over id, holds."""
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, element = (np.float32, "float") if single else (np.float64, "double")
    given = F.col(f"`{vector_col}`").cast(f"array<{element}>")
    usable = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), given.alias("given")).where(
        F.col("id").isNotNull() & _usable(F.col("given"), dim)
    )
    usable = usable.groupBy("id", _direction(F.col("given").cast("array<double>")).alias("vector")).agg(
        F.min("given").alias("given")
    )
    entries = materialise(_distinct(usable, k), "entries")
    # which entry each query is; entries without a query are only looked at
    asking = usable.where(is_query).select(F.col("id").alias("query_id"), "vector", F.col("given").alias("own"))
    asking = materialise(
        asking.join(entries.select("entry", "vector"), "vector").select("query_id", "entry", "own"), "asking"
    )
    packed = _packed(entries, kind)
    order = materialise(_order(packed, dim, kind, curves), "numbers")
    # every curve holds every entry once
    n = entries.count()
    per_curve = max(1, -(-n // block))
    reach = max(least, int(np.ceil(window * n)))
    curve = F.floor(F.col("nr") / max(1, n)).cast("long")
    order = order.select(
        "entry", (curve * per_curve).alias("base"), (F.col("nr") - curve * n).alias("position")
    )

    def block_of(position: Column) -> Column:
        return F.floor(position / block).cast("long")

    members = order.select(
        (F.col("base") + block_of(F.col("position"))).alias("block"), F.lit(False).alias("asks"), "entry", "position"
    ).join(packed, "entry")
    first = F.greatest(block_of(F.col("position") - reach), F.lit(0))
    last = F.least(block_of(F.col("position") + reach), F.lit(per_curve - 1))
    queries = (
        order.join(asking.select("entry").distinct(), "entry")
        .select("entry", "base", "position", F.explode(F.sequence(first, last)).alias("other"))
        .select((F.col("base") + F.col("other")).alias("block"), F.lit(True).alias("asks"), "entry", "position")
        .join(packed, "entry")
    )
    columns = ("block", "asks", "entry", "position", "blob")
    found = (
        members.select(*columns).unionByName(queries.select(*columns))
        .repartition("block")
        .sortWithinPartitions("block", "asks", "position")
        .mapInArrow(
            lambda batches: _search_blocks(batches, dim, kind, k, reach),
            "query long, entry long, score double",
        )
        .groupBy("query", "entry")
        .agg(F.max("score").alias("score"))
    )
    # a query's own entry answers with its other ids; its score is its own cosine, 1
    answers = found.join(entries.select("entry", "ids"), "entry").select(
        "query", "score", F.explode("ids").alias("found")
    )
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("found.id"))
    shortlist = answers.withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= k + 1)
    listed = shortlist.groupBy(F.col("query").alias("entry")).agg(
        F.collect_list(F.struct("score", "found.id", "found.given")).alias("found")
    )
    others = F.filter("found", lambda f: f["id"] != F.col("query_id"))
    exact = F.transform(
        others,
        lambda f: F.struct(
            (-F.coalesce(_cosine(F.col("own"), f["given"]), f["score"])).alias("far"), f["id"].alias("id")
        ),
    )
    return (
        asking.join(listed, "entry")
        .select("query_id", F.posexplode(F.slice(F.sort_array(exact), 1, k)).alias("at", "f"))
        .select(
            "query_id",
            (F.col("at") + 1).alias("rank"),
            F.col("f.id").alias("vec_id"),
            (-F.col("f.far")).alias("score"),
        )
    )
