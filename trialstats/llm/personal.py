"""Personal data by anchor expansion.

One Aho-Corasick automaton per task finds the anchors of every kind (at-signs, digits before a dot, plus signs, digit
pairs, URL schemes and account cues). A small deterministic parser per kind then expands each anchor to its left and
right border and validates what it found. Text without an anchor costs one pass of the automaton.

The base kinds are email, ip, card and phone. A parser resumes behind its last match, so the spans of a kind are the
leftmost non-overlapping ones; a match that fails validation is dropped and not retried. Beyond them come ``url``
(a scheme with a host), ``iban`` (two letters, check digits, mod 97) and ``account`` (the identifier behind a cue such
as "account no:"). Offsets are code points, ends are exclusive.

Cases: a null or empty text has no spans; texts of any length are read whole; repeated rows are handled row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import sha256_hex, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s?(?:no|number|nr|id)\b)?\.?\s?[:=#]\s?([A-Za-z0-9][A-Za-z0-9-]{4,33})(?![A-Za-z0-9])")
_DIGITS = "0123456789"
#: cues of an identifier that follows them
CUES = ("account", "acct", "konto", "cuenta", "compte", "passport", "customer id", "ssn")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def run_start(text: str, at: int, least: int, allowed) -> int:
    """Leftmost position of the run of ``allowed`` characters that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def email(text: str, at: int, least: int):
    start = run_start(text, at, least, _LOCAL)
    found = start < at and _DOMAIN.match(text, at + 1)
    return (start, found.end(), True) if found else None


def ip(text: str, at: int, least: int):
    if at < least:
        return None
    found = _IP.match(text, start := run_start(text, at, least, _DIGITS))
    return found and (start, found.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found[0].split(".")))


def card(text: str, at: int, least: int):
    found = _CARD.match(text, at) if at >= least else None
    if not found:
        return None
    digits = found[0].replace(" ", "").replace("-", "")
    return at, found.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, least: int):
    found = _PHONE.match(text, at) if at >= least else None
    return found and (at, found.end(), 9 <= sum(c in _DIGITS for c in found[0]) <= 15)


def url(text: str, at: int, least: int):
    end = text.index("://", at) + 3
    found = _URL.match(text, end) if at >= least else None
    return found and (at, at + len(text[at : found.end()].rstrip(".,;:!?)")), True)


def iban(text: str, at: int, least: int):
    found = _IBAN.match(text, at) if at >= least and not text[max(0, at - 1) : at].isalnum() else None
    if not found:
        return None
    code = found[0].replace(" ", "")
    return at, found.end(), int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def account(text: str, at: int, least: int):
    found = _ACCOUNT.match(text, at) if at >= least else None
    return found and (found.start(1), found.end(1), sum(c in _DIGITS for c in found[1]) >= 4)


PARSERS: dict[str, Callable] = {
    "email": email, "ip": ip, "card": card, "phone": phone, "url": url, "iban": iban, "account": account,
}


def anchors() -> list[tuple[str, list[tuple[str, int]]]]:
    """Anchor texts with the kinds they open and where, from the last character, the parser starts.

    A card starts at the first of two digits that may stand apart by one space or hyphen; the automaton reads lower
    case, so cues of any case are found.
    """
    out: dict[str, list[tuple[str, int]]] = {"@": [("email", 0)], "://": []}
    for d in _DIGITS:
        out["+" + d] = [("phone", -1)]
        out[d + "."] = [("ip", 0)]
        for e in _DIGITS:
            for gap in ("", " ", "-"):
                out[d + gap + e] = [("card", -1 - len(gap))] + [("iban", -3)] * (not gap)
    for scheme in ("http", "https", "ftp"):
        out[f"{scheme}://"] = [("url", -len(scheme) - 2)]
    for cue in CUES:
        out[cue] = [("account", 1)]
    return [(k, v) for k, v in out.items() if v]


def finder() -> Callable[[str], list[tuple[str, int, int]]]:
    """A function from a text to its spans, by kind in the order of ``KINDS``, then start."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, opens in anchors():
        automaton.add_word(text, opens)
    automaton.make_automaton()
    order = {k: n for n, k in enumerate(KINDS)}

    def find(text: str) -> list[tuple[str, int, int]]:
        least, spans = dict.fromkeys(KINDS, 0), []
        lower = text.lower()
        if len(lower) != len(text):  # a letter whose small form is longer
            lower = "".join(c.lower() if c < "\x80" else c for c in text)
        for at, opens in automaton.iter(lower):
            for kind, shift in opens:
                found = PARSERS[kind](text, at + shift, least[kind])
                if found:
                    start, least[kind], valid = found
                    if valid:
                        spans.append((kind, start, least[kind]))
        return sorted(spans, key=lambda s: (order[s[0]], s[1]))

    return find


@F.arrow_udf(SPANS)
def personal_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Spans of personal data of each text."""
    find = finder()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for texts in batches:
        yield pa.array(
            [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "")] for t in texts], kind
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row of ``docs``."""
    return docs.select("doc_id", personal_spans("text").alias("spans"))


def op10_personal(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    base = "filter(spans, s -> s.kind in ('" + "','".join(BASE) + "'))"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        sha256_hex(F.expr(joined.format(base))).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
