import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from trialstats.llm import repeats as R


def plain(rows, length, keep_first):
    """By a table of all windows."""
    least, texts = {}, {}
    for doc_id, text in rows:
        data = (text or "").encode()
        key = hashlib.sha256(data).digest()[:16]
        texts[key] = data
        if doc_id is not None:
            least[key] = min(least.get(key, doc_id), doc_id)
        else:
            least.setdefault(key, least.get(key))
    for doc_id, text in rows:  # a null id names a text only if no other does
        key = hashlib.sha256((text or "").encode()).digest()[:16]
        if least[key] is None and doc_id is not None:
            least[key] = doc_id
    copies = defaultdict(int)
    for _, text in rows:
        copies[hashlib.sha256((text or "").encode()).digest()[:16]] += 1
    order = sorted(texts, key=lambda k: (least[k] is not None, least[k] or 0, k))
    count, seen = defaultdict(int), set()
    for key in order:
        for s in range(len(texts[key]) - length + 1):
            count[texts[key][s:s + length]] += copies[key]
    kept = {}
    for key in order:
        gone = np.zeros(len(texts[key]), bool)
        for s in range(len(texts[key]) - length + 1):
            window = texts[key][s:s + length]
            if window in seen if keep_first else count[window] > 1:
                gone[s:s + length] = True
            seen.add(window)
        kept[key] = gone
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = hashlib.sha256(data).digest()[:16]
        gone = kept[key]
        if keep_first and doc_id != least[key] and len(data) >= length:
            gone = np.ones(len(data), bool)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return sorted(out, key=str)


def check(frame, length, keep_first=False, **options):
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    found = R.repeats(frame, length, keep_first, texts=True, **options).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in found]
    assert sorted(got, key=str) == plain(rows, length, keep_first)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)


def test_suffix_order_and_factors_against_definitions():
    random.seed(2)
    for letters in ("ab", "a", "abcd"):
        text = "".join(random.choice(letters) for _ in range(120)).encode()
        order, common = R.suffix_order(np.frombuffer(text, np.uint8).astype(np.int64), 128)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])

        def lcp(x, y):
            k = 0
            while max(x, y) + k < len(text) and text[x + k] == text[y + k]:
                k += 1
            return k
        assert common[1:].tolist() == [lcp(x, y) for x, y in zip(order, order[1:])]
        n = len(text)
        assert R.previous_factors(order, common).tolist() == [max((lcp(x, y) for y in range(x)), default=0) for x in range(n)]
        assert R.previous_factors(order, common, following=True).tolist() == [
            max((lcp(x, y) for y in range(x + 1, n)), default=0) for x in range(n)]


def test_only_suffixes_that_equal_another_are_sorted_again(monkeypatch):
    random.seed(4)
    data = np.array([random.randrange(256) for _ in range(5000)] * 2 + [0, 0, 256])
    sorted_, plain_sort = [], R.np.argsort
    monkeypatch.setattr(R, "np", type("Counting", (), {"__getattr__": lambda _, name: (
        lambda x, **k: sorted_.append(len(x)) or plain_sort(x, **k)) if name == "argsort" else getattr(np, name)})())
    order, common = R.suffix_order(data, 400)
    assert sorted_[0] == len(data) and sum(sorted_) < 9 * len(data)
    random_part, sorted_[:] = R.suffix_order(data[5000:], 400), []
    R.suffix_order(data[5000:], 400)
    assert len(sorted_) > 1 and sum(sorted_[1:]) < 100  # hardly anything is equal beyond seven values
    text = data.astype(np.uint16).astype(">u2").tobytes()
    assert random_part[0].tolist() == sorted(range(5003), key=lambda k: text[10000 + 2 * k:])
    for least in (0, 400):
        factors = R.previous_factors(order, common, least_asked=least)
        assert (factors >= 400).tolist() == [5000 <= k <= 9600 for k in range(len(data))]


def test_equal_windows_share_their_anchor():
    random.seed(3)
    shared = bytes(random.choice(b"abc ") for _ in range(900))
    data = bytes(random.choice(b"xyz") for _ in range(500)) + shared + bytes(random.choice(b"uvw") for _ in range(333)) + shared
    first, last, anchor, h = R.anchored(data, np.array([len(data)]), R.Grams(64), 400)
    home = {s: (a - s, x) for f, l, a, x in zip(first, last, anchor, h) for s in range(f, l + 1)}
    assert len(home) == len(data) - 399
    assert all(home[500 + k] == home[500 + 900 + 333 + k] for k in range(501))
    assert all(0 <= d <= 336 for d, _ in home.values())


@pytest.mark.parametrize("keep_first", [False, True])
def test_random_texts_and_hot_anchors(spark, keep_first):
    random.seed(7)
    hot = "".join(random.choice("abcdefgh ") for _ in range(26))
    rows = []
    for k in range(120):
        own = "".join(random.choice("ijklmnop é") for _ in range(random.randint(0, 30)))
        rows.append((k, own[:len(own) // 2] + (hot[random.randint(0, 2):] if k % 3 else "") + own[len(own) // 2:]))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (None, rows[1][1]), (202, "ab" * 60), (203, "a" * 70), (None, hot * 2), (204, None), (205, ""),
             (200, rows[1][1]), (206, hot[:19]), (207, hot[:20])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame, 20, keep_first)
    check(frame, 20, keep_first, group=3)


def test_documents(spark, documents):
    check(documents, 400)
    check(documents, 400, keep_first=True)


def test_odd_rows_and_very_long_texts(spark, odd_documents, no_documents, monkeypatch):
    check(odd_documents, 400)
    assert R.repeats(no_documents).collect() == []
    random.seed(9)
    data = bytes(random.choice(b"abcdef") for _ in range(4000)) * 2
    monkeypatch.setattr(R, "TOGETHER", 1 << 10)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([1]), pa.array([5]), pa.array([data])], ["key", "copies", "id", "text"])
    items = [r for b in R._items(400)([batch]) for r in b.to_pylist()]
    starts = sorted(s for r in items for s in range(r["first"], r["last"] + 1))
    assert starts == list(range(len(data) - 399))
