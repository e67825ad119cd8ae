from pyspark.sql import functions as F

from scribelake.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    found = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        found.append((doc_id, keep, len(ids), doc_id == keep))
    return sorted(found, key=str)


def labelled(docs, **options):
    labels = exact_dedup.label_copies(docs, **options).drop("digest").collect()
    return sorted(map(tuple, labels), key=str)


def test_odd_rows(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert labelled(odd_documents) == brute(rows)
    kept = exact_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [(r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in rows})
    ids = {r.doc_id for r in kept.collect() if r.text == "a b c"}
    assert ids == {2}


def test_a_weak_digest_merges_nothing_that_differs(documents, odd_documents):
    def weak(content):
        return F.substring(exact_dedup.sha256(content), 1, 1)

    for docs in (documents, odd_documents):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert labelled(docs, digest=weak, salts=2) == brute(rows)
        assert exact_dedup.keep_one(docs, digest=weak).count() == len({t or "" for _, t in rows})


def test_a_group_with_nearly_all_rows(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 4900, "same").otherwise(F.col("id").cast("string")).alias("text")
    )
    labels = exact_dedup.label_copies(docs).where("group_size > 1")
    assert labels.count() == 4900 and labels.where("kept").collect()[0].doc_id == 4899


def test_empty_table(no_documents):
    assert exact_dedup.label_copies(no_documents).count() == 0
    assert exact_dedup.keep_one(no_documents).count() == 0


def test_stages_compare_content_and_have_no_python(documents):
    plan = exact_dedup.keep_one(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("keys=[digest") + plan.count("key=[digest") == 4  # partial and final, twice
