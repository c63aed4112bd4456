import re

from hypothesis import given, settings
from hypothesis import strategies as st

from trialstats.llm import personal as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        sums = [sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(sums) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [
        (k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])
    ]


def base(text):
    return [s for s in P.finder()(text) if s[0] in P.BASE]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789.@+-() aZé%İ", max_size=60))
def test_base_spans_are_the_regular_expressions(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "a.b@c.de", "@", ".", "1.2.3.4", "256.1.1.1",
                                 "+49 (30) 1234567", "+", " ", "x", "http://a.bc/d?e=f.", "-", "9"]), max_size=9))
def test_joined_parts(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_more_kinds():
    text = "see https://a.example.org/x?y=1, IBAN GB82 WEST 1234 5698 7654 32 and Account no: 99-1234-x ok http:// none"
    spans = [(k, text[a:b]) for k, a, b in P.finder()(text)]
    assert ("url", "https://a.example.org/x?y=1") in spans
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in spans
    assert ("account", "99-1234-x") in spans


def test_tables(documents, odd_documents, no_documents):
    for frame in (documents, odd_documents):
        texts = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
        got = P.personal_data(frame).collect()
        key = str
        want = sorted(((i, brute(t)) for i, t in texts), key=key)
        assert sorted(((r.doc_id, [tuple(s) for s in r.spans if s.kind in P.BASE]) for r in got), key=key) == want
    assert P.personal_data(no_documents).count() == 0
