import numpy as np
from pyspark.sql import functions as F

from trialstats.llm import mixing as M


def test_margins_hold_and_expected_tokens_reach_the_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"source": 0.5, "lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}, "topic": 1.0}
    rows = M.weighted(docs, targets=targets, keep=0.1).toPandas()
    rows["w"] = rows.tokens * rows.weight
    lang = rows.groupby("lang").w.sum() / rows.w.sum()
    assert np.allclose(lang, 0.25, atol=1e-6)
    share = rows.groupby("source").tokens.sum() / rows.tokens.sum()
    want = share**0.5 / (share**0.5).sum()
    assert np.allclose(rows.groupby("source").w.sum() / rows.w.sum(), want, atol=1e-6)
    topic = rows.groupby("topic").tokens.sum() / rows.tokens.sum()
    assert np.allclose(rows.groupby("topic").w.sum() / rows.w.sum(), topic, atol=1e-6)
    assert abs((rows.tokens * rows.probability).sum() / (0.1 * rows.tokens.sum()) - 1) < 1e-6
    assert 0.05 < (rows.tokens * rows.sampled).sum() / rows.tokens.sum() < 0.16
    again = M.sample(docs, targets=targets, keep=0.1)
    assert {r.doc_id for r in again.collect()} == set(rows[rows.sampled].doc_id)


def test_many_sources_share_the_rest(spark, monkeypatch):
    monkeypatch.setattr(M, "VALUES", 3)
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("s"), F.least(F.col("id") % 40, F.col("id"))).alias("source"), F.lit(7).alias("n_chars"))
    raked = M.mix(docs, {"source": 0.5}, 0.5)
    assert set(raked.factors["source"]) == {"s0", "s1", "s10", M.OTHER}
    assert M.weighted(docs).count() == 400


def test_odd_rows(odd_documents, no_documents):
    rows = M.weighted(odd_documents).collect()
    assert len(rows) == 9 and {r.source for r in rows} == {"s", "t", M.NULL}
    assert all(0 <= r.probability <= 1 for r in rows)
    assert M.weighted(no_documents).count() == 0
    tokens = {r.doc_id: r.tokens for r in rows}
    assert tokens[1] == 12 and tokens[2] == 0 and tokens[3] == 0


def test_raking_against_a_plain_loop():
    rng = np.random.default_rng(0)
    cells = rng.uniform(1, 5, (4, 3, 2))
    targets = [np.full(4, 0.25), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    f = M.rake(cells, targets)
    now = cells / cells.sum() * f[0][:, None, None] * f[1][None, :, None] * f[2]
    for axis in range(3):
        assert np.allclose(now.sum(tuple(a for a in range(3) if a != axis)), targets[axis], atol=1e-8)


def test_every_source_is_raked_to_its_own_target(spark, monkeypatch):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.expr("id div 1000") % 3 == 0, "en").otherwise("de").alias("lang"),
        F.concat(F.lit("s"), F.col("id") % 1000).alias("source"), F.lit(7).alias("n_chars"))
    rows = M.weighted(docs, targets={"source": 0.7}).toPandas()
    assert len(rows) == 6000 and np.allclose(rows.weight, 1)
    asked = {f"s{k}": 1.0 + k % 3 for k in range(1000)}
    rows = M.weighted(docs, targets={"source": asked}).toPandas()
    got = (rows.tokens * rows.weight).groupby(rows.source).sum() / (rows.tokens * rows.weight).sum()
    assert np.allclose(got, [asked[v] / sum(asked.values()) for v in got.index], rtol=1e-6)
    few = docs.where("id % 1000 < 12")
    asked = {f"s{k}": 1.0 + k % 3 for k in range(12)}
    options = {"targets": {"source": asked, "lang": 0.5}, "keep": 0.3}
    want = M.weighted(few, **options).toPandas().sort_values("doc_id")
    monkeypatch.setattr(M, "LOCAL_CELLS", 0)
    monkeypatch.setattr(M, "VALUES", 3)
    got = M.weighted(few, **options).toPandas().sort_values("doc_id")
    assert np.allclose(got.weight, want.weight) and np.allclose(got.probability, want.probability)
    assert {r.doc_id for r in M.sample(few, **options).collect()} == set(want[want.sampled].doc_id)


def test_blanks_are_no_tokens(spark):
    rows = spark.createDataFrame([("a  b\n\n\n  c\n",), ("\n x",), (" \t ",), (None,)], "text string")
    assert [r[0] for r in rows.select(M.token_count(F.col("text"))).collect()] == [3, 1, 0, 0]
