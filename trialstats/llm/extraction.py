"""Main text of web pages by equivalence classes of template tokens.

1. Every page is cut into tokens: tags qualified by their path (tag names with the first class or id), and blocks of
   text qualified by theirs. For each host and token one aggregation keeps the number of pages, the number of
   occurrences and a fingerprint of the occurrence vector (an xor over pages of a hash of page and count), so vectors
   are compared without being built and a host of any size is never gathered.
2. Tokens of one host with equal fingerprints share their occurrence vector and form an equivalence class. A class is
   large and frequent if it has at least ``LEAST_TOKENS`` tokens and stands on ``SUPPORT`` of the host's pages.
   It is valid if its tags nest: every path in it extends the path of another of its tokens or is a root.
   The valid classes, nested by path, are the host's template.
3. What the template leaves open are slots, named by their path. A slot is content or boilerplate by its container
   (elements and whole class or id names for navigation, notices, adverts, forms, comments); where the page has an
   article or main element, only slots inside it stay. An article inside a container that only its class names
   boilerplate is the main text if the page has no other. On pages without an article, text that repeats on most pages
   of the host and stands in a slot, or in an element right inside one, is template text and goes; in a place that does
   not nest in the template it is the page's own and stays. On pages whose host has no usable template the page's own
   containers decide.

Templates are small (bounded by a host's distinct paths); they are sent to all tasks while their measured size is
below ``BROADCAST_ROWS`` rows, and joined by host beyond.

Cases: a null or empty html gives an empty text; markup that is cut off or never closed is read as far as it goes; a
null url is a host of its own; repeated rows count as pages of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import table
from trialstats.session import cut

SUPPORT = 0.5
LEAST_TOKENS = 2
LEAST_PAGES = 3
#: longer paths are named by their hash
LONG_PATH = 1000
BROADCAST_ROWS = 200_000
#: share of a host's pages on which a text block outside the article is template text
REPEATED = 0.5

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr ins del label big".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form header html li main nav ol section table td th ul".split())

NEVER = frozenset(
    "head script style noscript template svg math iframe object canvas audio video title meta nav header footer aside "
    "form button select option textarea input fieldset menu dialog".split()
)
CONTENT = frozenset({"article", "main"})
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORDS = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar "
    "header masthead footer copyright colophon sidebar aside rail widget widgets "
    "notice notices cookie cookies consent gdpr alert popup modal overlay disclaimer "
    "form search login signin signup subscribe subscription newsletter "
    "comment comments reply replies discussion disqus respond "
    "share sharing social follow related recommended recommendations trending skip hidden"
)
BOILERPLATE = frozenset(_WORDS.split())
#: words that do not change what a class name with a boilerplate word names; any other word makes it a name of its own
PLACES = frozenset(
    "site top bottom left right primary secondary global mobile desktop list links link area box bar block slot unit "
    "item items button buttons icon icons posts".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Element:
    """An open element; ``home`` is the nearest one that is not inline."""

    __slots__ = ("tag", "path", "kind", "home")

    def __init__(self, tag: str, path: str, kind: str, home: Element | None = None):
        self.tag, self.path, self.kind, self.home = tag, path, kind, home or self


def names_boilerplate(name: str) -> bool:
    """Whether a class or id as a whole names boilerplate: ``site-header`` does, ``article-header`` does not."""
    words = [w.lower() for w in _NAME_PART.findall(_CAMEL.sub(" ", name))]
    return any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in PLACES for w in words)


def _kind(tag: str, attributes: dict[str, str], above: str) -> str:
    """Kind of an element inside one of kind ``above``.

    ``never``, ``content`` or ``plain``; ``named`` for boilerplate by class or id only, and ``doubt`` for an article in it.
    """
    if above == "never" or tag in NEVER or attributes.get("role", "").lower() in ROLES or "hidden" in attributes:
        return "never"
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return "never"
    named = tag not in ("body", "html") and any(
        names_boilerplate(n) for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split())
    if named and above in ("content", "doubt"):
        return "never"
    if tag in CONTENT or attributes.get("role", "").lower() == "main":
        return "doubt" if named or above in ("named", "doubt") else "content"
    return "named" if named else above


def parse(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Events of a page in order: ("tag", path, kind, "") and ("text", path, kind, block)."""
    stack = [Element("", "", "plain")]
    open_: Counter = Counter()
    parts: list[str] = []
    place = ("", "plain")
    at, end = 0, len(page)

    def block():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        return [("text", *place, text)] if text else []

    def shut(tag: str):
        if not open_[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                open_.subtract(e.tag for e in stack[k:])
                del stack[k:]
                return
            if tag in INLINE and stack[k].tag not in INLINE:
                return
            if stack[k].tag in SCOPES and tag == "p":
                return

    def take(text: str):
        nonlocal place
        if text.strip():
            inner = stack[-1]
            home = inner.home
            here = (home.path, inner.kind if inner.kind in ("never", "named") else home.kind)
            if here != place:
                yield from block()
                place = here
            parts.append(text)
        elif parts and text:
            parts.append(" ")

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            yield from take(page[at:])
            break
        if found.start() > at:
            yield from take(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag not in INLINE:
            yield from block()
        if found[1]:
            shut(tag)
            continue
        attributes = {
            k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(found[3])
        } if found[3].strip(" /\n") else {}
        if tag in CLOSES_P:
            shut("p")
        for other in SELF_CLOSING.get(tag, ()):
            if stack[-1].tag == other:
                open_[stack.pop().tag] -= 1
        above = stack[-1]
        named = attributes.get("class") or attributes.get("id") or ""
        label = tag + ("." + named.split()[0] if named.split() else "")
        path = above.path if tag in INLINE else f"{above.home.path}/{label}"
        if len(path) > LONG_PATH:
            path = "/" + xxhash.xxh3_64_hexdigest(path)
        kind = _kind(tag, attributes, above.kind)
        if tag not in INLINE:
            yield "tag", path, kind, ""
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not found[0].endswith("/>") or tag not in ("svg", "path", "use"):
            stack.append(Element(tag, path, kind, above.home if tag in INLINE else None))
            open_[tag] += 1
    yield from block()


def block_name(path: str, text: str) -> str:
    return f"{path}\t{xxhash.xxh3_64_hexdigest(text)}"


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task by host and token: pages, occurrences, fingerprint."""
    held: dict[tuple[str, str], list[int]] = {}

    def out():
        columns = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * 5
        got = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.string()] * 2 + [pa.int64()] * 3, strict=True)],
            ["host", "token", "pages", "total", "vector"])
        held.clear()
        return got

    for batch in batches:
        for host, salt, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own: dict[str, int] = {}
            for kind, path, _, text in parse(page.as_py() or ""):
                name = path if kind == "tag" else block_name(path, text)
                own[name] = own.get(name, 0) + 1
            own["\n"] = 1  # counts the pages of the host
            for name, n in own.items():
                row = held.setdefault((host, name), [0, 0, 0])
                row[0] += 1
                row[1] += n
                row[2] ^= xxhash.xxh3_64_intdigest(f"{salt}:{n}") >> 1
            if len(held) > 300_000:
                yield out()
    if held:
        yield out()


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, slots (paths of tags in valid classes) and repeated (names of text blocks that are template text)."""
    salt = F.xxhash64("page_id", "url", "html")
    rows = pages.select(_host(F.col("url")).alias("host"), salt.alias("salt"), "html")
    counts = rows.mapInArrow(_count_tokens, "host string, token string, pages long, total long, vector long")
    counts = counts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.expr("bit_xor(vector)").alias("vector"))
    counts = cut(counts.where("pages >= 2 or token = '\n'"))
    size = counts.where("token = '\n'").select("host", F.col("pages").alias("all"))
    tokens = counts.where("token <> '\n'").join(size, "host").where(
        (F.col("all") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("all")))
    tag = ~F.col("token").contains("\t")
    classes = tokens.groupBy("host", "vector").agg(
        F.count("*").alias("tokens"), F.collect_set(F.when(tag, F.col("token"))).alias("paths"),
        F.collect_set(F.when(~tag & (F.col("pages") >= REPEATED * F.col("all")), F.col("token"))).alias("repeated"))
    # a class nests if each of its paths but the shortest extends another token of the template
    valid = classes.where(F.col("tokens") >= LEAST_TOKENS)
    return valid.groupBy("host").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("slots"),
        F.array_distinct(F.flatten(F.collect_list("repeated"))).alias("repeated"))


def nested(slots: list[str]) -> set[str]:
    """Paths whose every ancestor is a template path too, so that they nest up to the root."""
    out: set[str] = set()
    for path in sorted(slots, key=lambda p: p.count("/")):
        above = path.rsplit("/", 1)[0]
        if not above or above in out:
            out.add(path)
    return out


def main_text(page: str, slots: set[str], repeated: set[str]) -> str:
    """Text of the content slots of a page, blocks joined by one space."""
    blocks = [(path, kind, text) for event, path, kind, text in parse(page) if event == "text" and kind != "never"]
    for article in ("content", "doubt"):
        if kept := [text for _, kind, text in blocks if kind == article]:
            return " ".join(kept)
    # a page without an article of its own, whatever the other pages of its host have
    return " ".join(text for path, kind, text in blocks
                    if kind == "plain" and not (block_name(path, text) in repeated and in_template(path, slots)))


def in_template(path: str, slots: set[str]) -> bool:
    """Whether a block stands in the nested template: in an element of it, or in one that repeats inside such an element."""
    return path in slots or path.rsplit("/", 1)[0] in slots


@F.arrow_udf(T.StringType())
def _extract(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    known: dict[int, tuple[set[str], set[str]]] = {}
    for pages, slots, repeated in batches:
        out = []
        for page, s, r in zip(pages, slots.to_pylist(), repeated.to_pylist(), strict=True):
            key = hash((tuple(s or ()), tuple(r or ())))
            if key not in known:
                if len(known) > 1000:
                    known.clear()
                known[key] = nested(s or []), set(r or [])
            out.append(main_text(page.as_py() or "", *known[key]))
        yield pa.array(out, pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of each row of ``pages``."""
    rows = pages.select("page_id", "url", "html")
    known = cut(templates(rows))
    if known.agg(F.coalesce(F.sum(F.size("slots") + F.size("repeated")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        known = F.broadcast(known)
    joined = rows.withColumn("host", _host(F.col("url"))).join(known, "host", "left")
    return joined.select("page_id", "url", _extract("html", "slots", "repeated").alias("text"))


def op2_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
