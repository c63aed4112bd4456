import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trialstats.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.lists(st.text("abc", min_size=4, max_size=11), min_size=1, max_size=6))
def test_automaton_finds_what_edit_distance_finds(word, terms):
    lexicon = X.Lexicon({t: 1.0 for t in terms})
    near = [edit_distance(word, t) for t in terms if edit_distance(word, t) <= X.edits_for(t)]
    got = lexicon.lookup(word)
    assert (got is None) == (not near)
    if got:
        assert got[2] == min(near)


def test_stems_and_misspellings():
    lexicon = X.Lexicon({"idiot": 5.0, "vile*": 4.0, "disgusting": 3.0})
    assert lexicon["vileness"][0] == "vile*" and lexicon["vile"] is None
    assert lexicon["idi0t"] == ("idiot", 5.0, 1) and lexicon["dsgustingg"] == ("disgusting", 3.0, 2)
    assert lexicon["pilot"] is None


def test_quotation_counts_less_than_abuse():
    abuse = "you are an idiot and more"
    quote = 'the critic wrote "such an idiot of a clerk" in a review'
    a, q = abuse.index("idiot"), quote.index("idiot")
    assert X.directness(abuse, a, a + 5) == 1.0 and X.directness(quote, q, q + 5) < 0.2


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.op4_toxicity(spark, SF).join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(rows.doc_id, rows.held_out))
    rows = rows[rows.held_out]
    hit = rows[rows.toxic == 1].predicted.mean()
    false = rows[rows.toxic == 0].predicted.mean()
    assert hit > 0.85 and false < 0.01 and rows.score.between(0, 1).all()


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    scored = odd_documents.select("doc_id", X.toxicity(odd_documents, labels).alias("s")).collect()
    assert len(scored) == 9 and all(0 <= r.s <= 1 for r in scored)
    assert no_documents.select(X.toxicity(no_documents, labels).alias("s")).count() == 0
    assert {r.s for r in odd_documents.select(X.toxicity(odd_documents, labels.limit(0)).alias("s")).collect()} == {0.0}


def test_logistic_against_its_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(x @ [1, -2, 0.5] + 0.3)))).astype(float)
    b = X.logistic(x, y)
    z = np.column_stack([x, np.ones(400)])
    p = 1 / (1 + np.exp(-z @ b))
    gradient = z.T @ (y - p) - np.array([X.RIDGE] * 3 + [1e-6]) * b
    assert np.abs(gradient).max() < 1e-6
