import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trialstats.llm import search as S


def brute(ids, x, qids, q, k):
    out = []
    for i, v in zip(qids, q):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), int(j)) for j, w in zip(ids, x) if j != i)
        out += [(int(i), j, -s) for s, j in scored[:k]]
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 6), st.sampled_from([3, 1000, 2**28]))
def test_bounds_never_lose_a_winner(seed, n, dims, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size, (n, dims))
    x[: n // 3] = x[0]  # ties
    ids = rng.permutation(3 * n)[:n]
    q = np.concatenate([x[:2], rng.integers(-size, size, (3, dims))])
    qids = np.concatenate([ids[:2], [10**7 + j for j in range(5 - len(ids[:2]))]])[: len(q)]
    assert sorted(S.no_random_access(ids, x, qids, q, 10)) == brute(ids, x, qids, q, 10)


def test_stops_early_on_correlated_lists():
    rng = np.random.default_rng(5)
    x = (rng.exponential(100, (3000, 1)) * rng.uniform(0.8, 1, (3000, 4))).astype(np.int64)
    assert sorted(S.no_random_access(np.arange(3000), x, np.array([-1]), x[:1], 10)) == brute(range(3000), x, [-1], x[:1], 10)


def test_blocks_odd_rows_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(S, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(size=4)]) for i in range(150)]
    good = {i: v for i, v in rows}
    odd = [(300, None), (400, []), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (None, [1.0] * 4),
           (700, [float("inf")] * 4), (800, [1.0, 2.0]), (0, rows[0][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    vectors = S.integer_vectors(frame)
    got = S.top_k(vectors.where("_id % 20 = 0"), vectors).collect()
    ids = np.array(list(good))
    x = np.floor(1024 * np.array(list(good.values()))).astype(np.int64)
    mine = [i for i in good if i % 20 == 0]
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == brute(ids, x, mine, x[mine], 10)
    assert all(r["rank"] <= 10 for r in got)
    assert S.top_k(vectors.limit(0), vectors).count() == 0 == S.top_k(vectors, vectors.limit(0)).count()
