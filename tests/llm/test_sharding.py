import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from scribelake.llm import sharding


def jump(key, shards):
    """The published function."""
    key, b, j = key & (2**64 - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_function(spark):
    keys = spark.range(-500, 500).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.xxhash64("id")).alias("key")
    )
    for shards in (1, 2, 40, 1000):
        rows = sharding.with_owner(keys, "key", shards).select("key", "chain.owner", "chain.grown").collect()
        for r in rows:
            assert (r.owner, r.grown) == (jump(r.key, shards), jump(r.key, shards + 1))


def test_long_chains_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_USUAL_JUMPS", 2)
    rows = sharding.with_owner(spark.range(300).toDF("key"), "key", 40).select("key", "chain.owner").collect()
    assert all(r.owner == jump(r.key, 40) for r in rows)


def check_slots(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_sizes_and_checksums(odd_documents):
    rows = sharding.assign_shards(odd_documents, 3).collect()
    check_slots(rows, 3)
    want = sorted(
        (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd_documents.collect()
    )
    assert sorted((r.size, r.text_crc32) for r in rows) == want


def test_one_key_with_most_rows(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2900, 7).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.col("id").cast("string").alias("text"),
    )
    rows = sharding.assign_shards(docs, 5).collect()
    check_slots(rows, 5)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1


def test_text_keys_and_files(spark, documents, no_documents, tmp_path):
    named = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("shard"))
    check_slots(sharding.assign_shards(named, 4).collect(), 4)
    sharding.write_shards(documents, f"{tmp_path}/shards", 4)
    stored = spark.read.parquet(f"{tmp_path}/shards")
    assert stored.count() == documents.count()
    assert all(r.shard == jump(r.doc_id, 4) for r in stored.select("doc_id", "shard").collect())
    assert sharding.assign_shards(no_documents, 4).count() == 0


def test_no_python(documents):
    plan = sharding.assign_shards(documents, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
