import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from trialstats.llm import neardup as N
from trialstats.llm.graph import components
from trialstats.session import release


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Component of every row by comparing all pairs of sets."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(k)
    seen = {(a, b) for own in index.values() for a in own for b in own if a < b}
    for a, b in seen:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)), key=str)


def got(frame):
    rows = N.near_duplicates(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_given_documents(documents):
    assert got(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_groups_around_the_threshold(spark):
    rng, rows = random.Random(3), []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [edited(base, rng.randrange(0, 9), rng) for _ in range(150)]
    for k in range(60):  # a chain: neighbours are near, ends are not
        rows.append(" ".join(f"c{j}" for j in range(k * 3, k * 3 + 60)))
    rows += ["one two", "one two", "Two words", "a b c d e", "A B\tC D E"]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd_documents, no_documents):
    assert got(odd_documents) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert got(no_documents) == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    parts = N.sketches([x[:2000], x[1000:], x, x[:0]])
    assert (np.maximum(parts[0], parts[1]) == parts[2]).all() and not parts[3].any()
    for shared in (1500, 2000, 2400):
        pair = N.sketches([x[:2500], x[2500 - shared : 5000 - shared]], 2048)
        j = N.joint_estimate(pair[:1], pair[1:], np.array([2500.0]), np.array([float(len(x[2500 - shared:5000 - shared]))]))
        true = len(np.intersect1d(x[:2500], x[2500 - shared : 5000 - shared])) / len(np.union1d(x[:2500], x[2500 - shared : 5000 - shared]))
        assert abs(j[0] - true) < 0.05


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 3)]
    found = components(spark.createDataFrame(links, "a long, b long")).groupBy("root").agg(F.count("*").alias("n"))
    assert {(r.root, r.n) for r in found.collect()} == {(0, 41), (100, 30)}


def test_rest_in_many_cells(spark, monkeypatch):
    """A group whose typical pair lies just below the threshold, dealt into blocks of a few rows."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    base = [f"g{k}" for k in range(150)]
    rows = [(k, edited(base, rng.randrange(2, 5), rng)) for k in range(120)]
    assert len({c for _, _, c in brute(rows)}) > 1
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rounds_leave_no_shuffles_behind(spark):
    import time

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).getName().endswith(".data") for k in range(files.size()))

    def settled():
        for _ in range(20):
            before = shuffles()
            time.sleep(0.5)
            if shuffles() == before:
                return before

    release(spark)
    start = settled()
    found = components(spark.createDataFrame([(k, k + 1) for k in range(3000)], "a long, b long"))
    left = settled() - start
    assert found.select("root").distinct().count() == 1
    assert left <= 16  # 8 were counted, 44 when rounds were left to the next collection
