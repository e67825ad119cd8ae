"""Merkle manifest of a table: a tree of digests per group, and one over the groups' roots.

A leaf is the digest of a row's fields.  The leaves of a group, in order, are joined eight
at a time, level by level, until one node is left, the group's subroot; the subroots, in
the order of their groups, are joined in the same way to the root.  A row's proof is the
list of the other nodes of its runs, from its leaf to the root.

Spark numbers the leaves by a sort by range.  ``8**LEVELS`` (4096) consecutive leaves of a
group are a superblock; going up, each superblock is reduced to its root in one task, and the roots,
4096 times fewer, are the leaves of the next tier, until every group has one node.  Going
down, the nodes of each tier are cogrouped by superblock with the outer part of their
proofs; one function finishes the local reduction, joins the local part of each proof to
the outer part, and, at the leaves, folds what is presented up to the root.  Groups of
fewer rows than a superblock share one, so a task is neither huge nor tiny.

Rows presented for verification may differ from the stored ones; their fold, with the
stored proof, equals the root only if their leaf is the stored one.

Defined results: a NULL field counts as ``-``, so it differs from every text; NULL is a
group of its own, the first, and a NULL order value comes first.  Rows alike in group and
order are ordered by their leaf; rows alike in all fields have equal leaves at neighbouring
places, with proofs of their own.  A single leaf is its group's subroot; a run of one node
is hashed alone.  A table without rows gives none.  Columns that are not named as fields
take no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scribelake.session import materialise

RUN = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree long, n long, pos long, hash binary"
_OUTER = "tree long, pos long, lefts array<binary>, rights array<binary>, subroot binary, root binary"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest, as bytes, of fields each written as ``-`` or byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    written = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.unhex(F.sha2(F.concat(*written).cast("binary"), 256))


def _join(nodes: Sequence[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in nodes).encode()).digest()


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def _reduce(hashes: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a superblock, the given one first."""
    found = [hashes]
    for _ in range(levels):
        last = found[-1]
        found.append([_join(last[k : k + RUN]) for k in range(0, len(last), RUN)])
    return found


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``nr``, their number from 0 in the given order; written once.

    The last key of the sort only parts rows that are alike, so that many of them are no
    single task's load.  It follows from the place in a stored table, hence is repeatable.
    """
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    row = F.monotonically_increasing_id()
    in_order = materialise(
        salted.repartitionByRange(*order, "_salt")
        .sortWithinPartitions(*order, "_salt")
        .drop("_salt")
        .withColumn("_part", F.shiftright(row, 33))
        .withColumn("_row", row.bitwiseAND((1 << 33) - 1)),
        "merkle-order",
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # one row per partition
    firsts = in_order.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    firsts = firsts.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_first"))
    return in_order.join(firsts, "_part").withColumn("nr", F.col("_first") + F.col("_row")).drop(
        "_part", "_row", "_first"
    )


def _superblock(block: int, shared: int, place: Column) -> list[Column]:
    """The key of a superblock: of the tree alone, or one of ``shared`` for small trees."""
    small = F.col("n") <= block
    return [
        F.when(small, F.lit(-1)).otherwise(F.col("tree")).alias("_tree"),
        F.when(small, F.pmod(F.xxhash64("tree"), F.lit(shared))).otherwise(place).cast("long").alias("_block"),
    ]


def _pieces(frame: pd.DataFrame):
    """(tree, first place, rows in order) of each tree's piece in a superblock."""
    for tree, piece in frame.groupby("tree", sort=False):
        piece = piece.sort_values("pos", kind="stable")
        yield tree, int(piece["pos"].iloc[0]), piece


def _up(frame: pd.DataFrame, depth: int) -> pd.DataFrame:
    found = []
    for tree, first, piece in _pieces(frame):
        n = int(piece["n"].iloc[0])
        top = _reduce(list(piece["hash"]), min(depth, _height(n)))[-1][0]
        found.append((tree, -(-n // RUN**depth), first // RUN**depth, top))
    return pd.DataFrame(found, columns=["tree", "n", "pos", "hash"])


def _proofs(piece: pd.DataFrame, depth: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For each node of a superblock the nodes beside it, to the left and right, by level."""
    levels = _reduce(list(piece["hash"]), min(depth, _height(int(piece["n"].iloc[0]))))
    found = []
    for k in range(len(piece)):
        lefts, rights = [], []
        for nodes in levels[:-1]:
            begin = k - k % RUN
            lefts.append(b"".join(nodes[begin:k]))
            rights.append(b"".join(nodes[k + 1 : begin + RUN]))
            k //= RUN
        found.append((lefts, rights))
    return found


def _joined(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int):
    """(row, lefts, rights, subroot, root) of every node, its proof whole."""
    above = {(t, p): (list(x), list(y), s, r) for t, p, x, y, s, r in outer.itertuples(index=False)}
    for tree, first, piece in _pieces(nodes):
        outer_lefts, outer_rights, subroot, root = above[(tree, first // RUN**depth)]
        for row, (lefts, rights) in zip(piece.itertuples(index=False), _proofs(piece, depth)):
            yield row, lefts + outer_lefts, rights + outer_rights, subroot, root


def _down(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    return pd.DataFrame(
        [(row.tree, row.pos, x, y, s, r) for row, x, y, s, r in _joined(nodes, outer, depth)],
        columns=["tree", "pos", "lefts", "rights", "subroot", "root"],
    )


def _fold(node: bytes, lefts: list[bytes], rights: list[bytes]) -> bytes:
    for left, right in zip(lefts, rights):
        node = sha256((left.hex() + node.hex() + right.hex()).encode()).digest()
    return node


def _verified(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    found = []
    for row, lefts, rights, subroot, root in _joined(nodes, outer, depth):
        proof = sha256("".join(x.hex() + y.hex() for x, y in zip(lefts, rights)).encode()).hexdigest()
        folded = _fold(row.presented, lefts, rights)
        found.append(
            (row.id, row.hash.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root)
        )
    return pd.DataFrame(
        found, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    )


def _size(tier: int, block: int) -> Column:
    """How many nodes of a tree of ``n`` leaves are left in a tier."""
    n = F.col("n")
    for _ in range(tier):
        n = F.ceil(n / block)
    return n.cast("long")


def _climb(
    nodes: DataFrame, trees: DataFrame, depth: int
) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The tiers of nodes, leaves first, each with the number of superblocks that its small
    trees share; and the top, one node a tree.

    There are as many tiers as the logarithm of the largest tree to the base of a superblock.
    """
    block = RUN**depth
    largest, n_tiers = trees.agg(F.max("n")).first()[0], 1
    while largest > block:
        largest, n_tiers = -(-largest // block), n_tiers + 1
    sizes = [_size(t, block) for t in range(n_tiers)]
    small = trees.agg(*(F.sum(F.when(n <= block, n)) for n in sizes)).first()
    tiers = []
    for tier in range(n_tiers):
        shared = max(1, -(-(small[tier] or 0) // block))
        here = nodes.select(*_superblock(block, shared, F.floor(F.col("pos") / block)), *nodes.columns)
        tiers.append((here, shared))
        lean = here.select("_tree", "_block", "tree", "n", "pos", "hash")
        reduced = lean.groupBy("_tree", "_block").applyInPandas(
            lambda frame: _up(frame[["tree", "n", "pos", "hash"]], depth), _NODES
        )
        nodes = materialise(reduced, "merkle-tier")
    return tiers, nodes


def _descend(
    tiers: list[tuple[DataFrame, int]],
    trees: DataFrame,
    outer: DataFrame,
    depth: int,
    last: Callable,
    schema: str,
) -> DataFrame:
    """From the proofs of the top nodes down to what ``last`` makes of leaves and proofs."""
    block = RUN**depth

    def work(of: Callable, kept: list[str], proof: list[str]) -> Callable:
        return lambda nodes, outer: of(nodes[kept], outer[proof], depth)

    for tier in range(len(tiers) - 1, -1, -1):
        nodes, shared = tiers[tier]
        # an outer node is the root of the superblock of its place in the tier below
        sized = outer.join(trees.select("tree", _size(tier, block).alias("n")), "tree")
        above = sized.select(*_superblock(block, shared, F.col("pos")), *outer.columns)
        kept = [c for c in nodes.columns if not c.startswith("_")]
        joined = nodes.groupBy("_tree", "_block").cogroup(above.groupBy("_tree", "_block"))
        if tier:
            proofs = joined.applyInPandas(work(_down, kept, outer.columns), _OUTER)
            outer = materialise(proofs, "merkle-proofs")
    return joined.applyInPandas(work(last, kept, outer.columns), schema)


def prove(leaves: DataFrame, depth: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``leaves`` has ``group``, ``place``, ``id``, ``hash`` and ``presented``: the digests, as
    bytes, of the stored row and of the row that is presented with its proof.  A superblock
    is ``depth`` levels high.
    """
    spark = leaves.sparkSession
    kind = leaves.schema["id"].dataType.simpleString()
    schema = (
        "id string, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )
    own = F.col("id").cast(kind).alias("id")
    # ids go through Python as text, as a column of numbers and NULLs would lose digits
    lean = materialise(
        leaves.select("group", "place", F.col("id").cast("string").alias("id"), "hash", "presented"),
        "merkle-leaves",
    )
    if lean.isEmpty():
        return spark.createDataFrame([], schema).withColumn("id", own)
    numbered = materialise(_numbered(lean, ["group", "place", "hash"]).drop("place"), "merkle-numbers")
    # a tree is named by the number of its first leaf, which orders trees as well
    trees = materialise(
        numbered.groupBy("group").agg(F.min("nr").alias("tree"), F.count(F.lit(1)).alias("n")),
        "merkle-trees",
    )
    named = trees.withColumnRenamed("group", "_group")
    nodes = numbered.join(named, F.col("group").eqNullSafe(F.col("_group"))).select(
        "tree", "n", (F.col("nr") - F.col("tree")).alias("pos"), "hash", "id", "presented"
    )
    tiers, top = _climb(nodes, trees, depth)
    subroots = top.select("tree", "hash")

    # the tree over the subroots, in the order of their groups
    n_trees = subroots.count()
    ranked = _numbered(subroots, ["tree"])
    over = materialise(
        ranked.select(
            F.lit(0).cast("long").alias("tree"),
            F.lit(n_trees).cast("long").alias("n"),
            F.col("nr").alias("pos"),
            "hash",
            F.col("tree").alias("below"),
        ),
        "merkle-subroots",
    )
    one = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"))
    upper, top = _climb(over.drop("below"), one, depth)
    nothing = F.array().cast("array<binary>")
    root = top.select(
        "tree", "pos", nothing.alias("lefts"), nothing.alias("rights"),
        F.col("hash").alias("subroot"), F.col("hash").alias("root"),
    )
    to_root = materialise(_descend(upper, one, root, depth, _down, _OUTER), "merkle-root")
    outer = to_root.drop("tree", "subroot").join(
        over.select("pos", F.col("below").alias("tree"), F.col("hash").alias("subroot")), "pos"
    ).select("tree", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")
    outer = materialise(outer, "merkle-outer")
    return _descend(tiers, trees, outer, depth, _verified, schema).withColumn("id", own)


def manifest(
    rows: DataFrame,
    presented: dict[str, Column] | None = None,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    depth: int = LEVELS,
) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every row of a table.

    ``presented`` gives, by field, what is presented instead of the stored value.  Groups
    are ordered by ``group_col``, rows of a group by ``id_col``, NULL first.
    """
    presented = presented or {}
    stored = {c: F.col(f"`{c}`") for c in fields}
    shown = {c: presented.get(c, column) for c, column in stored.items()}
    leaves = rows.select(
        F.col(f"`{group_col}`").alias("group"),
        F.col(f"`{id_col}`").alias("place"),
        F.col(f"`{id_col}`").alias("id"),
        leaf_digest(list(stored.values())).alias("hash"),
        leaf_digest(list(shown.values())).alias("presented"),
    )
    return prove(leaves, depth).withColumnRenamed("id", id_col)
