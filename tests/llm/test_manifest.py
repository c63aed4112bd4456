import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trialstats.llm import manifest as M

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels of a list, and per node of the first its siblings before and after, level by level."""
    levels, steps = [nodes], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k in range(len(nodes)):
            at = k // 16 ** (len(levels) - 1)
            run = at // 16 * 16
            steps[k].append(("".join(now[run:at]), "".join(now[at + 1:run + 16])))
        levels.append([h("".join(now[k:k + 16])) for k in range(0, len(now), 16)])
    return levels[-1][0], steps


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for name in names:
        own = sorted(by[name], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        below[name] = own, *tree([leaf(r, r.text) for r in own])
    root, tops = tree([below[n][1] for n in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        own, subroot, steps = below[name]
        for r, mine in zip(own, steps, strict=True):
            path = mine + top
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            text = "".join(c.lower() if c.isascii() else c for c in r.text) if bad and r.text is not None else r.text
            folded = leaf(r, text)
            for before, after in path:
                folded = h(before + folded + after)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def check(spark, frame):
    got = M.op13_manifest(spark, "", frame).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(frame.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_documents(spark, documents):
    check(spark, documents)


def test_odd_rows(spark, odd_documents, no_documents):
    check(spark, odd_documents)
    assert M.op13_manifest(spark, "", no_documents).collect() == []
    check(spark, odd_documents.where("doc_id = 7"))


def test_sparse_negative_and_repeated_ids(spark):
    ids = F.when(F.col("id") % 3 == 0, F.lit(-5)).when(F.col("id") % 3 == 1, F.col("id") * F.lit(1 << 50) - F.lit(1 << 62))
    frame = spark.range(900).select(
        ids.otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("Text "), F.col("id") % 200).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit(3).cast("long").alias("n_chars"))
    check(spark, frame)


def test_words_are_compressed_bitmaps(spark):
    frame = spark.range(0, 6400, 2).select(F.lit("=a").alias("group"), F.col("id").alias("doc_id"), F.col("id").cast("string").cast("binary").alias("hash"), F.col("id").alias("row"))
    words = M._directory(frame.select("*", F.shiftright("doc_id", 6).alias("word"), F.expr("cast(doc_id & 63 as int)").alias("bit")))
    rows = sorted(words.collect(), key=lambda r: r.word)
    assert len(rows) == 100 and all(r.n == 32 and r.bits == 0x5555555555555555 and r.before == 32 * k for k, r in enumerate(rows))
    assert [r.pos for r in sorted(M.ranked(frame).collect(), key=lambda r: r.doc_id)] == list(range(3200))


@pytest.mark.parametrize("limit", [1, 7])
def test_hot_keys_are_dealt(spark, limit):
    from trialstats.llm.common import spread_join

    facts = spark.range(300).select((F.col("id") % 4 % 3).alias("k"), "id")
    lookup = facts.groupBy("k").agg(F.count("*").alias("n"))
    out = spread_join(facts, lookup, ["k"], "n", ["id"], limit).collect()
    assert sorted(r.id for r in out) == list(range(300)) and {r.n for r in out} == {75, 150}
