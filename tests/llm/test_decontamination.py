import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trialstats.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=10):
    """Hit words and items of each text by comparing every position with every window."""
    found = [("null" if i is None else str(i), WORD.findall(small(t))) for i, t in items]
    windows = {}
    for i, w in found:
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, who = WORD.findall(small(text)), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    who |= own
        out.append((doc_id, len(w), len(hit), sorted(who)))
    return out


def compare(docs, benchmark, **options):
    got = D.decontaminate(docs, benchmark, **options).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = brute(rows, items)
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=key) == sorted(want, key=key)
    return got


def test_given_tables(spark, documents):
    got = compare(documents, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert any(r.n_hit for r in got)


def test_blocks_and_small_shards_agree(spark, documents):
    compare(documents.limit(60), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), block_bytes=2000,
            shard_words=500)


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame(
        [(1, "a b c d e f g h i j k"), (2, "Word"), (3, None), (4, "..."), (None, "the lazy dog again"), (5, "é ß")],
        "item_id long, text string",
    )
    got = compare(odd_documents, items)
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    for r in got:
        for s in r.spans:
            assert texts[r.doc_id][s.start : s.end].strip()
    assert D.decontaminate(no_documents, items).count() == 0
    assert {r.n_hit for r in D.decontaminate(odd_documents, items.limit(0)).collect()} == {0}
    kept = D.clean(odd_documents, items)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5}


def test_spans_cut_out(spark):
    docs = spark.createDataFrame([(1, "keep, A b. C keep a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = D.decontaminate(docs, items)
    cut = docs.join(found, "doc_id").select(D.without_spans("text", "spans").alias("t")).first().t
    assert cut == "keep,  keep "


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=3),
                                                          min_size=1, max_size=5))
def test_index_finds_every_occurrence(symbols, patterns):
    text = np.array([*symbols, 0], dtype=np.int64)
    index = D.FMIndex(text, 3)
    alive, low, high = index.search(np.array(patterns))
    got = {k: sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(alive.tolist(), low, high)}
    for k, p in enumerate(patterns):
        assert got.get(k, []) == [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == p]
