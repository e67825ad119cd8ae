import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scribelake.llm import simhash


def fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    """doc_id, fingerprint pairs: by comparing all."""
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= bits:
                parent[root(i)] = root(j)
    lowest = {}
    for k, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            lowest[root(k)] = min(doc_id, lowest.get(root(k), doc_id))
    return sorted(((d, lowest.get(root(k))) for k, (d, _) in enumerate(prints)), key=str)


def test_query_equals_brute_force(documents):
    prints = [(r.doc_id, fingerprint(r.text)) for r in documents.collect()]
    rows = simhash.near_duplicates(documents).collect()
    assert sorted((r.doc_id, r.fp & (2**64 - 1)) for r in rows) == sorted(prints)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == components(prints)


def test_odd_rows(odd_documents, no_documents):
    prints = [(r.doc_id, fingerprint(r.text)) for r in odd_documents.collect()]
    rows = simhash.near_duplicates(odd_documents).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == components(prints)
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 4 not in ids and ids.count(None) == 2
    assert simhash.keep_one(no_documents).count() == 0


def test_segments_do_not_matter(monkeypatch):
    text = " ".join(f"w{k * k % 91}" for k in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_SEGMENT", 64)
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 5)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (2**64 - 1) == fingerprint(text)


def planted(seed, groups=30, size=12, singles=300):
    rnd, prints = random.Random(seed), []
    for _ in range(groups):
        centre = rnd.getrandbits(64)
        for _ in range(size):
            # chains: each a few bits from the one before
            for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 2, 3])):
                centre ^= 1 << b
            prints.append(centre)
    return prints + [rnd.getrandbits(64) for _ in range(singles)]


def test_links_and_components_of_planted_fingerprints(spark):
    prints = sorted(set(planted(5)))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(7)
    found = {frozenset((r.a, r.b)) for r in simhash.links(frame).collect()}
    want = {
        frozenset((signed[i], signed[j]))
        for i in range(len(prints))
        for j in range(i)
        if bin(prints[i] ^ prints[j]).count("1") <= 2
    }
    assert found == want and simhash.links(frame).count() == len(want)
    nodes = frame.withColumn("low", F.xxhash64("fp"))
    pairs = simhash.links(frame)
    rows = simhash._smallest_ids(nodes, pairs).collect()
    low = {r.fp: r.low for r in nodes.collect()}
    by_all = dict(components([(low[s], p) for s, p in zip(signed, prints)]))
    assert all(r.low == by_all[low[r.fp]] for r in rows)


def test_a_large_group_of_near_copies_makes_few_rows(spark):
    """All values of 13 bits: every one has neighbours, none more than 13 + 78."""
    frame = spark.range(1 << 13).toDF("fp")
    links = simhash.links(frame)
    assert links.count() == (1 << 13) * (13 + 78) // 2


def test_references_tell_all_values_of_a_band_apart():
    table = simhash.PivotTable()
    assert all(len(set(table.columns[b].tolist())) == 256 for b in range(8))
    a = np.array([0x0123456789ABCDEF], dtype=np.uint64)
    b = a ^ np.uint64(0b101 << 30)
    assert (np.abs(table.totals(a) - table.totals(b)) <= 2).all()
