"""Repeated substrings by longest-previous-factor arrays over suffix order, in groups that a task can hold.

A window is ``length`` bytes of a text; a window that also starts elsewhere is repeated, and every byte of it goes.

1. Distinct texts are written once, in buckets by their digest, with the number of their copies.
2. Each window is dealt to an anchor: the least-hashed ``gram`` inside it (leftmost of equals), which depends on the window's
   bytes alone, so equal windows share anchor and distance to it. Successive windows with one anchor are an item: its
   bytes are some 570 for 170 windows.
3. Items of equal bytes are one class, counted by partial aggregation: all windows of a class of several are repeated.
   Anchors of one item are done. Of every other class one item goes on.
4. The bytes of these items are gathered by anchor and put into one suffix order (prefix doubling on numpy arrays, many
   anchors together). Previous and next smaller positions in that order, with the least common prefix on the way, give the
   longest previous factor of every position; on negated positions they give the longest next factor. A window whose
   factor reaches ``length`` is repeated: with ``keep_first`` only a previous one counts, so the first copy stays.
5. An anchor with more than ``GROUP`` classes is never gathered: its items are cut into cells of a seventh of the distances,
   regrouped by what all windows of a cell have in common (more than the anchor), and steps 3 to 5 are done again. The last
   cells are single windows, whose class is their whole content, so the rounds end after four.

Cases: a null text is empty; texts below ``length`` bytes have nothing to remove; equal texts repeat each other; matches
never cross texts, overlapping ones within a text count; ids may be null or repeated, each row is answered; an empty
table gives no rows; other columns play no part. Bytes are removed, so what is left may cut a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import RANGES, spread_join, table, utf8, work_tables
from trialstats.session import cut, release

LENGTH = 400
#: classes of one anchor that are put into one suffix order
GROUP = 1024
#: cells that a round cuts the distances into
CELLS = 7
#: bytes that are hashed, or put into one suffix order, at once
TOGETHER = 1 << 20
ORDERED = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15


def gram_of(length: int) -> int:
    """Bytes of an anchor."""
    return max(4, length * 4 // 25)


class Grams:
    """Hashes of all byte strings of one size in a buffer, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, size: int):
        self.size = size
        self.values = np.random.default_rng(20240311).integers(0, 1 << 64, 256, dtype=np.uint64)
        one = np.full(TOGETHER, _FACTOR, np.uint64)
        one[0] = 1
        self.powers = np.multiply.accumulate(one)
        one[1:] = pow(_FACTOR, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(one)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[self.size :] - sums[: -self.size]) * self.inverse[: len(data) - self.size + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def least_in_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash (its upper 44 bits, leftmost of equals) among each ``width`` successive ones."""
    key = (hashes & ~np.uint64(TOGETHER - 1)) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, ~np.uint64(0), np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(TOGETHER - 1)).astype(np.int64)


def anchored(data: bytes, ends: np.ndarray, grams: Grams, length: int) -> tuple[np.ndarray, ...]:
    """First and last window, anchor and its hash of every item of a buffer of texts that end at ``ends``."""
    hashes = grams(np.frombuffer(data, np.uint8))
    anchors = least_in_windows(hashes, length - grams.size + 1)
    starts = np.arange(len(anchors))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[text]
    starts, text = starts[inside], text[inside]
    anchors = anchors[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return starts[first], starts[last], anchors[first], hashes[anchors[first]]


_ITEM = "h long, full long, key binary, first long, last long, anchor long, copies long, id long"
_ITEM_NAMES = _ITEM.replace(",", "").split()[::2]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _items(length: int):
    """(key, copies, id, text) to items."""
    step = TOGETHER - length

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, copies, own, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for at in range(0, len(text) - length + 1, step + 1):  # parts of a very long text share no window
                    yield key, copies, own, at, text[at : at + TOGETHER]

    def emit(held: list[tuple], grams: Grams) -> pa.RecordBatch:
        data = b"".join(p[4] for p in held)
        ends = np.cumsum([len(p[4]) for p in held])
        first, last, anchor, h = anchored(data, ends, grams, length)
        of = np.searchsorted(ends, first, side="right")
        move = np.array([p[3] for p in held]) - (ends - np.array([len(p[4]) for p in held]))
        full = _signed([xxhash.xxh3_64_intdigest(data[x : y + length], z - x)
                        for x, y, z in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)])
        columns = [pa.array(h.view(np.int64)), pa.array(full), pa.array([p[0] for p in held], pa.binary()).take(pa.array(of)),
                   *(pa.array(c + move[of]) for c in (first, last, anchor)),
                   *(pa.array([p[k] for p in held], pa.int64()).take(pa.array(of)) for k in (1, 2))]
        return pa.RecordBatch.from_arrays(columns, _ITEM_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, size = Grams(gram_of(length)), [], 0
        for piece in pieces(batches):
            if size + len(piece[4]) > TOGETHER:
                yield emit(held, grams)
                held, size = [], 0
            held.append(piece)
            size += len(piece[4])
        if held:
            yield emit(held, grams)

    return run


def _packed(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value and those behind it in one number that sorts like them, and how many are in it."""
    bits = (int(values.max()) + 1).bit_length()
    size = max(1, 63 // bits)
    padded = np.concatenate((values + 1, np.zeros(size - 1, np.int64)))  # the end sorts before every value
    keys = values + 1
    for k in range(1, size):
        keys = (keys << bits) | padded[k : k + len(values)]
    return keys, size


def suffix_order(values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``length`` values at least, and common prefixes of neighbours, up to the same.

    Ranks, the places of the first suffix of equal ones, are doubled from the values that fit one number until ``length``
    is reached; only suffixes that still equal another are sorted again. Common prefixes come from the ranks.
    """
    n = len(values)
    keys, size = _packed(values)
    order, ranks, sizes = np.empty(n, np.int64), [np.full(n + 1, -1, np.int32)], [size]  # the end equals nothing
    open_, base = np.arange(n), np.zeros(n, np.int64)
    while True:
        by = np.argsort(keys)
        open_, base, keys = open_[by], base[by], keys[by]
        place = np.arange(len(by))
        new, other = np.ones(len(by), bool), np.ones(len(by), bool)
        new[1:] = keys[1:] != keys[:-1]
        other[1:] = base[1:] != base[:-1]
        group = np.maximum.accumulate(np.where(other, place, 0))
        first = np.maximum.accumulate(np.where(new, place, 0))
        order[base + place - group] = open_
        base = base + first - group
        ranks[-1][open_] = base
        if size >= length:
            break
        again = ~new
        again[:-1] |= ~new[1:]
        open_, base = open_[again], base[again]
        behind = open_ + size
        inside = behind < n
        keys = base * (n + 1)
        keys[inside] += ranks[-1][behind[inside]] + 1
        size *= 2
        ranks.append(ranks[-1].copy())
        sizes.append(size)
    one, two = order[:-1].copy(), order[1:].copy()
    single = np.append(values, -1)
    for own, size in [*zip(reversed(ranks), reversed(sizes), strict=True), *[(single, 1)] * (sizes[0] - 1)]:
        step = (own[one] == own[two]) * size
        one += step
        two += step
    common = np.zeros(n, np.int64)
    common[1:] = one - order[:-1]
    return order, common


def _before(values: np.ndarray, common: np.ndarray, least_asked: int = 0) -> np.ndarray:
    """Common prefix with the nearest earlier entry of a smaller value; 0 where there is none.

    One below ``least_asked`` may be given too long, but never as long as that.
    """
    at = np.arange(len(values)) - 1
    least = common.copy()
    active = np.flatnonzero((at >= 0) & (values[at] > values) & (least >= least_asked))
    while len(active):  # everything between an entry and ``at`` is larger, so whole stretches are passed over
        passed = at[active]
        least[active] = np.minimum(least[active], least[passed])
        at[active] = at[passed]
        active = active[(at[active] >= 0) & (values[at[active]] > values[active]) & (least[active] >= least_asked)]
    return np.where(at >= 0, least, 0)


def previous_factors(order: np.ndarray, common: np.ndarray, following: bool = False, least_asked: int = 0) -> np.ndarray:
    """Longest previous (or following) factor of every position: its longest match that starts earlier (later).

    Factors below ``least_asked`` are not followed up to their exact lengths; they stay below it.
    """
    place = -order if following else order
    smaller = _before(place, common, least_asked)
    behind = np.concatenate((common[1:], [0]))[::-1]
    larger = _before(place[::-1], behind, least_asked)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(smaller, larger)
    return out


def repeated_windows(texts: list[bytes], length: int, keep_first: bool) -> list[np.ndarray]:
    """Per text, whether each of its windows starts anywhere else (earlier, with ``keep_first``)."""
    sizes = [len(t) + 1 for t in texts]
    ends = np.cumsum(sizes)
    values = np.zeros(ends[-1], np.int64)
    for end, text in zip(ends, texts, strict=True):
        values[end - 1 - len(text) : end - 1] = np.frombuffer(text, np.uint8)
    values[ends - 1] = 256 + np.arange(len(texts))  # no match goes beyond a text
    order, common = suffix_order(values, length)
    factors = previous_factors(order, common, least_asked=length)
    if not keep_first:
        factors = np.maximum(factors, previous_factors(order, common, following=True, least_asked=length))
    return [factors[end - size : end - length] >= length for end, size in zip(ends, sizes, strict=True)]


def _marks(length: int, keep_first: bool):
    """(h, key, first, bytes), sorted by anchor, to the byte ranges (key, start, end) of repeated windows."""

    def emit(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (_, key, first, _), found in zip(held, repeated_windows([r[3] for r in held], length, keep_first), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
            rows += [(key, first + int(b), first + int(e) - 1 + length) for b, e in edges.reshape(-1, 2)]
        names, kinds = ("key", "start", "end"), (pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and row[0] != held[-1][0] and size >= ORDERED:  # between anchors only
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield emit(held)

    return run


def _cells(length: int, width: int):
    """Items of hot anchors to those of their cells: ``width`` distances, keyed by the bytes that all their windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, key, first, data, last, anchor, own in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                for cell in range((anchor - last) // width, (anchor - first) // width + 1):
                    near, far = cell * width, cell * width + width - 1
                    # windows of the cell start at anchor - far .. anchor - near
                    x, y = max(first, anchor - far), min(last, anchor - near)
                    common = data[anchor - near - first : anchor - far - first + length]
                    rows.append((
                        xxhash.xxh3_64_intdigest(common, (h ^ cell) & 0xFFFFFFFFFFFFFFFF),
                        xxhash.xxh3_64_intdigest(data[x - first : y - first + length], anchor - x), key, x, y, anchor, 1, own))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [None, None, pa.binary(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(c)) if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _ITEM_NAMES)

    return run


def _bytes_of(asked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """h, key, first, bytes, last, anchor and id of items; only the items move, texts lie in buckets."""
    lists = asked.groupBy("key").agg(F.collect_list(F.struct("h", "first", "last", "anchor", "id")).alias("own"))
    rows = texts.join(lists, "key").select("key", "text", F.explode("own").alias("x"))
    part = F.expr(f"substring(text, cast(x.first + 1 as int), cast(x.last - x.first + {length} as int))")
    return rows.select("x.h", "key", "x.first", part.alias("bytes"), "x.last", "x.anchor", "x.id")


def _widths(length: int) -> list[int]:
    out, width = [], length - gram_of(length) + 1
    while width > 1:
        width = -(-width // CELLS)
        out.append(width)
    return out


def _write(frame: DataFrame, name: str) -> DataFrame:
    frame.write.saveAsTable(name)
    return frame.sparkSession.table(name)


def _spans(texts: DataFrame, database: str, length: int, keep_first: bool, group: int) -> DataFrame:
    """key, start and end (exclusive) of byte ranges to remove; ranges may overlap."""
    source = texts.select("key", "copies", "id", F.col("text"))
    items = _write(source.mapInArrow(_items(length), _ITEM), f"{database}.items")
    out = []
    for round_, width in enumerate([*_widths(length), 0]):
        least = F.min(F.struct("id", "key", "first", "last", "anchor")).alias("least")
        classes = cut(items.groupBy("h", "full").agg(F.sum("copies").alias("n"), F.count("*").alias("members"), least))
        anchors = cut(classes.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1"))
        classes = cut(spread_join(classes, anchors, ["h"], "kinds", ["full"]).where("kinds > 1 or n > 1"))
        several = classes.where("members > 1" if keep_first else "n > 1").select("h", "full", "members", "least")
        again = spread_join(items, cut(several), ["h", "full"], "members", ["key", "first"])
        if keep_first:
            again = again.where((F.col("key") != F.col("least.key")) | (F.col("first") != F.col("least.first")))
        out.append(cut(again.select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))))
        release(texts.sparkSession)
        asked = classes.select("h", "kinds", "least.*")
        few = _bytes_of(asked.where(f"kinds between 2 and {group}"), texts, length).select("h", "key", "first", "bytes", "id")
        few = few.repartition("h").sortWithinPartitions("h", "id", "key", "first").select("h", "key", "first", "bytes")
        out.append(cut(few.mapInArrow(_marks(length, keep_first), "key binary, start long, end long")))
        many = asked.where(f"kinds > {group}")
        if not width or many.isEmpty():
            break
        items = _write(_bytes_of(many, texts, length).mapInArrow(_cells(length, width), _ITEM), f"{database}.items{round_}")
    return reduce(DataFrame.unionByName, out)


_OUTCOME = "key binary, spans array<struct<start:int,end:int>>, n_removed long, kept_sha256 string, kept binary"


def _remove(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                spans: list[dict] = []
                for s in sorted(found, key=lambda s: s["start"]):
                    if spans and s["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], s["end"])
                    else:
                        spans.append(dict(s))
                edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((key, spans, len(text) - len(kept), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.binary(), span, pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], ["key", "spans", "n_removed", "kept_sha256", "kept"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, texts: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept (bytes, with ``texts``) of every row of ``docs``.

    With ``keep_first`` the first copy of a window stays, in the order of ids and, within a text, of places; rows of equal id
    and text are one copy.
    """
    data = utf8(F.col("text"))
    sha = F.unhex(F.sha2(data, 256))
    rows = docs.select(
        "doc_id", data.alias("text"), F.octet_length(data).cast("bigint").alias("n_bytes"), sha.alias("sha"), F.substring(sha, 1, 16).alias("key"))
    long = rows.where(F.col("n_bytes") >= length)
    with work_tables(docs.sparkSession) as database:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once = long.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("id"), F.first("text").alias("text"))
        once.write.bucketBy(parts, "key").saveAsTable(f"{database}.texts")
        stored = docs.sparkSession.table(f"{database}.texts")
        found = _spans(stored, database, length, keep_first, group)
        found = found.select("key", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("s"))
        found = found.groupBy("key").agg(F.collect_set("s").alias("spans"))
        gone = stored.select("key", "text").join(found, "key").select("key", "text", "spans").mapInArrow(_remove(texts), _OUTCOME)
        known = cut(stored.select("key", "copies", "id").join(gone, "key", "left"))
    met = spread_join(long.drop("text"), known, ["key"], "copies", ["doc_id"]).withColumn("_later", F.lit(False))
    if keep_first:
        met = met.withColumn("_later", ~F.col("doc_id").eqNullSafe(F.col("id")))
    if texts:  # untouched texts are read again rather than kept twice
        again = docs.select(F.col("doc_id").alias("_id"), data.alias("_text"), F.substring(sha, 1, 16).alias("_key")).distinct()
        met = met.join(again, (met["key"] == again["_key"]) & met["doc_id"].eqNullSafe(again["_id"]), "left")
    else:
        met = met.withColumn("_text", F.lit(None).cast("binary"))
    none, whole = F.array().cast(RANGES), F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    spans = F.when(F.col("_later"), whole).otherwise(F.coalesce("spans", none))
    empty = F.lit("").cast("binary")
    met = met.select(
        "doc_id", "n_bytes", F.when(F.col("_later"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("_later"), F.sha2(empty, 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        spans.alias("spans"), F.when(F.col("_later"), empty).otherwise(F.coalesce("kept", "_text")).alias("kept"))
    short = rows.where(F.col("n_bytes") < length).select(
        "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"),
        none.alias("spans"), (F.col("text") if texts else F.lit(None).cast("binary")).alias("kept"))
    out = met.unionByName(short)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "spans", "kept")


def op11_repeats(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents") if docs is None else docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
