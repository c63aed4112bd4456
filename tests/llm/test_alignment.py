import hashlib
import json
import os
import random
from collections import Counter, defaultdict

import pytest

from trialstats.llm import alignment as A

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    return A.Pair(A.TOKENIZERS)


def token_bytes(pair):
    """Bytes of each token of both sides, read from the vocabularies by their rules."""
    with open(os.path.join(A.TOKENIZERS, A.A_FILE)) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    letters, other = {}, 256
    for b in range(256):
        letters[chr(b) if b in printable else chr(other)] = b
        other += b not in printable
    a = {i: bytes(letters[c] for c in piece) for piece, i in vocabulary.items() if all(c in letters for c in piece)}
    b = {}
    for i in range(pair.b.get_piece_size()):
        piece = pair.b.id_to_piece(i)
        b[i] = bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()
    return a, b


def groups(a_ids, b_ids, a_bytes, b_bytes, text):
    """Pairs of lists of ids between common ends, by walking both sides; None where the bytes differ."""
    whole = (" " + text).encode()
    if b"".join(a_bytes[i] for i in a_ids) != whole or b"".join(b_bytes[i] for i in b_ids) != whole:
        return None
    out, own, x, y = [], ([], []), 0, 0
    a_ids, b_ids = list(a_ids), list(b_ids)
    while a_ids or b_ids:
        if x <= y and a_ids:
            own[0].append(a_ids.pop(0))
            x += len(a_bytes[own[0][-1]])
        else:
            own[1].append(b_ids.pop(0))
            y += len(b_bytes[own[1][-1]])
        if x == y:
            out.append(own)
            own = ([], [])
    return out


def plain(pair, rows):
    a_bytes, b_bytes = token_bytes(pair)
    found, counts, memory = [], Counter(), {}
    for r in rows:
        text = r.text or ""
        if text not in memory:
            a = pair.a.encode(" " + text, add_special_tokens=False).ids
            memory[text] = (groups(a, pair.b.encode(text), a_bytes, b_bytes, text) if text else None) or []
        found.append(memory[text])
        counts.update((g[0][-1], g[1][-1]) for g in memory[text])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for r, own in zip(rows, found, strict=True):
        links = [(g[0][-1], g[1][-1]) for g in own]
        form = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in own)
        out.append((
            r.doc_id, sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(links),
            sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(form.encode()).hexdigest() if own else ""))
    return sorted(out, key=str)


def rows_of(frame, **options):
    return sorted(map(tuple, A.alignment(frame, **options).select(*COLUMNS).collect()), key=str)


def test_documents(spark, documents, pair):
    want = plain(pair, documents.select("doc_id", "text").collect())
    assert rows_of(documents) == want
    assert rows_of(documents, block=2000) == want  # counts in several blocks


def test_odd_rows(spark, odd_documents, no_documents, pair):
    assert rows_of(odd_documents) == plain(pair, odd_documents.select("doc_id", "text").collect())
    assert rows_of(no_documents) == []


def test_random_unicode(spark, pair):
    random.seed(5)
    letters = "ab  \n\té▁ <|>/s٣漢\U0001f600ﬁé\x00\r"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|> and <s> </s> <unk> <0x41>", " two  spaces", "▁", "x" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(pair, frame.collect())
    assert rows_of(frame) == want
    assert any(r[1] for r in want) and any(not r[1] for r in want)
