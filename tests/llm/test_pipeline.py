import zlib
from collections import Counter

import corpus_pipeline as C
from tests.llm.test_decontamination import brute as brute_items
from tests.llm.test_neardup import brute as brute_components
from trialstats.llm import decontamination, mixing, neardup

SF = "/root/testdata/sf0.001"


def test_stages_follow_brute_force(spark, documents):
    columns = documents.columns
    docs = documents
    seen = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = out.collect()
        seen[name] = (docs.collect(), rows)
        docs = spark.createDataFrame(rows, documents.schema)
    before, after = seen["near_duplicates"]
    want = {i for i, _, root in brute_components([(r.doc_id, r.text) for r in before]) if i == root}
    assert {r.doc_id for r in after} == want and len(after) == len(want) < len(before)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in brute_items([(r.doc_id, r.text) for r in before], items) if not hit}
    assert {r.doc_id for r in after} == clean and len(clean) < len(before)
    before, after = seen["mixing"]
    assert 0 < len(after) < len(before) and set(after) <= set(before)
    shards = C.shard(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in docs.collect())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in shards)


def test_odd_rows_pass_every_stage(spark, odd_documents, no_documents):
    for name, stage in C.STAGES:
        assert stage(spark, no_documents, SF).count() == 0, name
        assert stage(spark, odd_documents, SF).count() <= odd_documents.count(), name


def test_one_row_of_each_component(spark, odd_documents):
    kept = sorted((r.doc_id for r in neardup.one_of_each(odd_documents).collect()), key=str)
    # 1 twice and the null id share a set; 2, 3 and 5 have no words
    assert kept == [1, 2, 3, 4, 5, 6, 7]


def test_run(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 50


def test_clean_documents_pass(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} " * 3, "en", "s", 60) for i in range(20)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, "something else entirely")], "item_id long, text string")
    assert decontamination.clean(docs, items).count() == 20
    assert mixing.sample(docs, keep=1.0).count() == 20
