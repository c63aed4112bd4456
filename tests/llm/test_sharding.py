import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from trialstats.llm import sharding as S


def place(frame, **options):
    return S.shard(frame, S.document_dimensions(frame), **options).collect()


def check(frame, rows, shards):
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
                  for r in frame.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return by


def test_bytes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = place(docs, shards=16)
    by = check(docs, rows, 16)
    sums = [sum(r.size for r in own) for own in by.values()]
    assert len(by) == 16 and max(sums) - min(sums) < 0.06 * sum(sums) / 16
    homes, weight = defaultdict(set), defaultdict(int)
    for r in rows:
        homes[r.text_crc32, r.size].add(r.shard)
        weight[r.text_crc32, r.size] += r.size
    assert all(len(h) == 1 for k, h in homes.items() if weight[k] < S.GROUP * sum(sums) / 17)


def test_one_text_with_half_of_all_rows_is_spread(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "hot text").otherwise(F.hex("id")).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(8).alias("n_chars"))
    by = check(docs, place(docs, shards=16), 16)
    sums = [sum(r.size for r in own) for own in by.values()]
    assert len(by) == 16 and max(sums) < 1.1 * sum(sums) / 16


def test_equal_texts_share_a_shard_whatever_their_other_columns(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.sha2((F.col("id") % 3000).cast("string").cast("binary"), 512).alias("text"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("l"), F.col("id") % 5)).alias("lang"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").alias("n_chars"))
    homes = defaultdict(set)
    for own in check(docs, place(docs, shards=16), 16).values():
        for r in own:
            homes[r.text_crc32].add(r.shard)
    assert len(homes) == 3000 and all(len(h) == 1 for h in homes.values())


def test_odd_rows_other_counts_and_targets(odd_documents, no_documents, documents):
    check(odd_documents, place(odd_documents, shards=16), 16)
    assert place(no_documents, shards=16) == []
    by = check(documents, place(documents, shards=5), 5)
    sums = [sum(r.size for r in own) for own in by.values()]
    assert len(by) == 5 and max(sums) < 1.4 * sum(sums) / 5
    rows = place(documents, target=100_000)
    assert max(sum(r.size for r in own) for own in check(documents, rows, 10**6).values()) < 260_000
