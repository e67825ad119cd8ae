"""Near-duplicates by SimHash, found through bands and thinned by pivot distances.

*Fingerprint.*  Texts are lower-cased in A-Z and cut into words at ASCII white space;
every run of three words, repeats included, is hashed by XXH64 (seed 42), and a bit of
the fingerprint is 1 if it is set in over half of the hashes.  Texts of one or two words
are hashed whole; those of none, NULL included, have fingerprint 0 and link like others.

*Links.*  The pivot table holds, for each distinct fingerprint, its Hamming distances to
16 reference fingerprints, kept apart for the eight bands of eight bits.  Of two
fingerprints that differ in at most two bits, at most two bands differ; in the other six
all distances agree.  So every fingerprint is filed 28 times, under the table's columns
of each choice of six bands.  These columns tell all values of a band apart: candidates
thus come from banding, and pivots only discard pairs within a file.  Rows filed together have equal bits in six bands and hence
number at most 65,536, whatever the data.  Of the pairs in a file, those whose summed
distances to any reference differ by more than two bits are discarded, and the survivors
are verified bit by bit.  A fingerprint has at most 136 others in its file within two
bits, so links grow with the input even in a large group of near copies, and a pair is
reported from one file only.

*Components.*  The smallest id spreads along links, with pointer jumping, until nothing
changes; each round is a written table.

Exact copies share a fingerprint and never form pairs.  Defined results: rows without an
id are fingerprinted and connect others; a component of such rows alone has id NULL.
Rows that share an id share its fate in ``keep_one``, which keeps rows without id.
Columns besides id and text may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scribelake.session import materialise

SHINGLE = 3
MAX_BITS = 2
_SEED = 42
_BANDS = 8
_PIVOTS = 16
_SEGMENT = 1 << 20
_SHINGLES_AT_ONCE = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ------------------------------------------------------------------ fingerprints


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of about a megabyte."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + _SEGMENT)
        end = cut.start() if cut else len(text)
        yield text[start:end].lower().split()
        start = end


def _votes(hashes: bytes) -> np.ndarray:
    """How many of the 8-byte hashes have each of the 64 bits, highest first."""
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 255 * 256):
        bits = np.unpackbits(rows[at : at + 255 * 256], axis=1)
        whole = len(bits) // 255 * 255
        # 255 votes fit into a byte
        votes += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.uint8)
    return votes


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    votes, n, tail = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_digest
    for run in _word_runs(text or b""):
        words = tail + run
        for at in range(0, len(words) - shingle + 1, _SHINGLES_AT_ONCE):
            part = words[at : at + _SHINGLES_AT_ONCE + shingle - 1]
            joined = b" ".join(part)
            lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: len(part) - shingle + 1].tolist()
            hashes = [digest(joined[i:j], _SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist())]
            votes += _votes(b"".join(hashes))
            n += len(hashes)
        tail = words[max(0, len(words) - shingle + 1) :]
    if n == 0 and tail:
        votes, n = _votes(digest(b" ".join(tail), _SEED)), 1
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def with_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text")
    )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            fps = pa.array(found, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    schema = StructType([rows.schema["doc_id"], StructField("fp", LongType())])
    return rows.mapInArrow(of_batches, schema)


# ------------------------------------------------------------------ links


class PivotTable:
    """Distances of every value of every band to the references."""

    def __init__(self) -> None:
        pivots = [xxhash.xxh64_intdigest(str(j), seed=j) for j in range(_PIVOTS)]
        pivot_bytes = np.array(pivots, dtype="<u8").view(np.uint8).reshape(_PIVOTS, _BANDS)
        values = np.arange(256, dtype=np.uint8)
        differing = values[None, None, :] ^ pivot_bytes.T[:, :, None]
        #: band, value, pivot
        self.distances = np.bitwise_count(differing).transpose(0, 2, 1).astype(np.int8)
        nibbles = self.distances.astype(np.uint64) << (4 * np.arange(_PIVOTS, dtype=np.uint64))
        #: band, value: the 16 distances, none above 8, in one number
        self.columns = np.bitwise_or.reduce(nibbles, axis=2)
        self.pairs = [(i, j) for i in range(_BANDS) for j in range(i + 1, _BANDS)]
        odd = [xxhash.xxh64_intdigest(f"band {b}") | 1 for b in range(_BANDS)]
        self.factors = np.array(odd, dtype=np.uint64)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """Row, choice: a number of the columns of all bands but two, and which two."""
        bands = fps.view(np.uint8).reshape(-1, _BANDS)
        parts = np.stack([self.columns[b][bands[:, b]] * self.factors[b] for b in range(_BANDS)], axis=1)
        total = parts.sum(axis=1, dtype=np.uint64)
        chosen = np.stack([total - parts[:, i] - parts[:, j] for i, j in self.pairs], axis=1)
        mixed = (chosen ^ (chosen >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed & ~np.uint64(31)) | np.arange(len(self.pairs), dtype=np.uint64)

    def totals(self, fps: np.ndarray) -> np.ndarray:
        """Row, pivot: the whole distances."""
        bands = fps.view(np.uint8).reshape(-1, _BANDS)
        return sum(self.distances[b][bands[:, b]] for b in range(_BANDS))

    def own_choice(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first choice of two bands that holds all differing bits of a pair."""
        differ = (a ^ b).view(np.uint8).reshape(-1, _BANDS) != 0
        first = np.full(len(a), -1)
        for k in reversed(range(len(self.pairs))):
            i, j = self.pairs[k]
            first[differ.sum(axis=1) == differ[:, i].astype(int) + differ[:, j]] = k
        return first


def _linked(table: PivotTable, keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """The verified pairs of rows with equal keys, which lie side by side."""
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1)
    last = np.repeat(ends, np.diff(ends, prepend=-1))
    rows = np.flatnonzero(last > np.arange(len(keys)))
    if not len(rows):
        return np.empty((0, 2), dtype=np.int64)
    totals = table.totals(fps)
    found, step = [], 1
    while len(rows):
        other = rows + step
        near = np.ones(len(rows), dtype=bool)
        for p in range(_PIVOTS):
            # each reference looks only at what the ones before it left
            left = np.flatnonzero(near)
            gap = totals[rows[left], p] - totals[other[left], p]
            near[left[np.abs(gap) > bits]] = False
        a, b = fps[rows[near]], fps[other[near]]
        close = np.bitwise_count(a ^ b) <= bits
        a, b, choice = a[close], b[close], (keys[rows[near]] & np.uint64(31))[close]
        own = table.own_choice(a, b) == choice
        found.append(np.stack([a[own], b[own]], axis=1).view(np.int64))
        step += 1
        rows = rows[rows + step <= last[rows]]
    return np.concatenate(found)


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): the pairs of distinct fingerprints of ``fps`` (fp) within ``bits`` bits."""
    if not 0 < bits <= MAX_BITS:
        raise ValueError(f"the files are laid out for one or {MAX_BITS} bits")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PivotTable()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = table.keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]))],
                names=["key", "fp"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PivotTable()
        keys = fps = np.empty(0, dtype=np.uint64)

        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            pairs = _linked(table, keys, fps, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
            )

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns]
            keys, fps = np.concatenate([keys, columns[0]]), np.concatenate([fps, columns[1]])
            # the last key may go on in the next batch
            done = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1])) if len(keys) else 0
            if done:
                yield out(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            yield out(keys, fps)

    filed = fps.select("fp").mapInArrow(file, "key long, fp long")
    return filed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "a long, b long")


# ------------------------------------------------------------------ components


def _smallest_ids(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, low): for each linked fingerprint the smallest id in its component.

    ``nodes`` has fp and the smallest id among its own documents; ``best`` is that id
    together with the fingerprint that holds it, so that it can be looked up again.
    """
    both = materialise(pairs.union(pairs.select("b", "a")).toDF("src", "dst"), "links")
    # ids order by being there first: a component's NULLs give way to any id
    own = F.struct(F.col("low").isNull().alias("none"), F.col("low"), F.col("fp").alias("at"))
    labels = materialise(
        nodes.join(both.select(F.col("src").alias("fp")).distinct(), "fp").select(
            "fp", own.alias("best"), F.lit(True).alias("changed")
        ),
        "labels",
    )
    while not labels.where("changed").isEmpty():
        heard = (
            both.join(labels.select(F.col("fp").alias("src"), "best"), "src")
            .groupBy(F.col("dst").alias("fp"))
            .agg(F.min("best").alias("heard"))
        )
        told = labels.join(heard, "fp").select(
            "fp", F.col("best").alias("was"), F.least("best", "heard").alias("best")
        )
        told = materialise(told, "told")
        # pointer jumping: what the holder of my id has heard meanwhile
        holders = told.select(F.col("fp").alias("at"), F.col("best").alias("held"))
        labels = materialise(
            told.withColumn("at", F.col("best.at"))
            .join(holders, "at")
            .select(
                "fp",
                F.least("best", "held").alias("best"),
                (F.least("best", "held") < F.col("was")).alias("changed"),
            ),
            "labels",
        )
    return labels.select("fp", F.col("best.low").alias("low"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    prints = materialise(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    pairs = materialise(links(nodes, bits), "pairs")
    linked = _smallest_ids(nodes, pairs).withColumnRenamed("low", "component_id")
    merged = nodes.join(linked, "fp", "left").select(
        "fp",
        F.when(F.col("component_id").isNull(), F.col("low"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )
    return prints.join(merged, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of the smallest id of each component, and those without an id."""
    labels = near_duplicates(docs, id_col, text_col, shingle, bits)
    stays = F.max(F.col("doc_id") == F.col("component_id")).alias("stays")
    drop = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(stays).where("NOT stays")
    # stored, so that Spark knows how few ids go before it decides how to join
    dropped = materialise(drop.select("doc_id"), "dropped")
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.struct("*").alias("row")).join(
        dropped, "doc_id", "left_anti"
    )
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
