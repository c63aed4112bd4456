"""Benchmark decontamination by an FM-index per shard of training text.

A benchmark item is cut into windows of ten words (an item of fewer words is one window). Every Arrow batch of
documents is one shard: its words are numbered by the vocabulary of the windows, and the runs of known words that are
long enough to hold a window are indexed (a word outside the vocabulary ends a run, so no occurrence is lost).
All windows are searched backwards at once through the ranks of a wavelet matrix over the Burrows-Wheeler transform;
occurrences are located by walking to the nearest sampled suffix position, and overlapping ones merge into spans.

The benchmark is searched in blocks of bounded size (``block_bytes``): each block is broadcast and all documents pass
it, so neither the driver nor a task holds more than one block. Documents are never shuffled.

Cases: a null or empty text has no words and no spans; an item with null or wordless text has no window; a null
item_id is called ``null``; repeated rows are handled row by row; an empty benchmark marks nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import RANGES, sha256_hex, table, utf8

WINDOW = 10
#: bytes of benchmark text in one broadcast block
BLOCK_BYTES = 4 << 20
#: words of one index; a larger batch is split between documents
SHARD_WORDS = 1 << 21
#: every so many suffix positions are kept
SAMPLE = 8

STATE = "struct<n_words:bigint,ranges:array<struct<start:int,end:int>>,items:array<string>>"
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    """Lower-cased words: ASCII digits and letters and everything beyond ASCII."""
    return data.translate(_WORD_BYTES).split()


class Wavelet:
    """Ranks over a sequence of small integers, one bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros, level = [], [], symbols
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(level) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        first, end = np.zeros_like(end), end
        for k, b in enumerate(reversed(range(self.bits))):
            ones, one = self.ones[k], ((symbol >> b) & 1).astype(bool)
            first = np.where(one, self.zeros[k] + ones[first], first - ones[first])
            end = np.where(one, self.zeros[k] + ones[end], end - ones[end])
        return end - first

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ones[k]
            one = ones[at + 1] - ones[at]
            out = out * 2 + one
            at = np.where(one == 1, self.zeros[k] + ones[at], at - ones[at])
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling compared prefixes; zeros end a run and rank by position."""
    stops = symbols == 0
    rank = np.where(stops, np.cumsum(stops) - 1, symbols.astype(np.int64) + stops.sum())
    order = np.argsort(rank, kind="stable")
    first = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
    step = 1
    while True:
        tied = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
        if not len(tied):
            return order
        at = order[tied]
        group, further = rank[at], rank[at + step]
        by = np.lexsort((further, group))
        at, group, further = at[by], group[by], further[by]
        begins = np.concatenate(([True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])))
        order[tied], first[tied] = at, begins
        rank[at] = tied[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        step *= 2


class FMIndex:
    """Backward search and sampled locating over symbols 1..top, with zeros between runs."""

    def __init__(self, symbols: np.ndarray, top: int):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.size, self.wavelet = len(symbols), Wavelet(before.astype(np.int64), top)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.samples, self.nth = order[self.sampled], np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of patterns that occur, with their suffix intervals."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, k]
            low = self.below[symbol] + self.wavelet.rank(symbol, low)
            high = self.below[symbol] + self.wavelet.rank(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out, open_, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(open_):
            hit = self.sampled[at]
            out[open_[hit]] = self.samples[self.nth[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            symbol = self.wavelet.access(at)
            at = self.below[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


class Block:
    """Windows of some benchmark items: vocabulary, numbered windows by length, items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        owners: dict[tuple[bytes, ...], set[int]] = {}
        self.items = [i for i, _ in items]
        for n, (_, text) in enumerate(items):
            found = words(text)
            for k in range(max(1, len(found) - window + 1) if found else 0):
                owners.setdefault(tuple(found[k : k + window]), set()).add(n)
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for p in owners for w in p}))}
        self.windows: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for m in sorted({len(p) for p in owners}):
            own = [(p, sorted(o)) for p, o in owners.items() if len(p) == m]
            self.windows[m] = (
                np.array([[self.vocabulary[w] for w in p] for p, _ in own], dtype=np.int64),
                [o for _, o in own],
            )
        self.least = min(self.windows, default=0)

    def hits(self, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """Merged word ranges and items of each text."""
        ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # one stop after each text
        numbers = np.zeros(starts[-1], dtype=np.int64)
        for t, at in zip(texts, starts[:-1].tolist(), strict=True):
            numbers[at : at + len(t)] = np.fromiter(map(self.vocabulary.get, t, repeat(0)), np.int64, len(t))
        known = np.diff(np.concatenate(([0], numbers > 0, [0])).astype(np.int8))
        begin, end = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        if not len(begin):
            return ranges, items
        size = end - begin + 1  # each run with its stop
        offset = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(offset[-1]) + np.repeat(begin - offset[:-1], size)  # shard position of each symbol
        index = FMIndex(numbers[place], len(self.vocabulary))
        edge, owned = np.zeros(len(numbers) + 1, np.int32), set()
        for m, (patterns, owners) in self.windows.items():
            which, low, high = index.search(patterns)
            count = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            at = place[index.locate(rows)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m, -1)
            text = np.searchsorted(starts, at, side="right") - 1
            owned.update(set(zip(text.tolist(), np.repeat(which, count).tolist(), repeat(m))))
        for text, pattern, m in owned:
            items[text] += [self.items[n] for n in self.windows[m][1][pattern]]
        inside = np.diff(np.concatenate(([0], np.cumsum(edge) > 0, [0])).astype(np.int8))
        for a, b in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True):
            text = int(np.searchsorted(starts, a, side="right")) - 1
            ranges[text].append((a - int(starts[text]), b - int(starts[text])))
        return ranges, [sorted(set(x)) for x in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(shared, shard_words: int):
    """Column function: text bytes and the state so far to the state after one more block."""
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("ranges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ])

    @F.arrow_udf(STATE)
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        block = Block.__new__(Block)
        vars(block).update(shared.value)
        for texts, states in batches:
            found, counts, shard, size = ([], []), [], [], 0

            def flush():
                for kept, new in zip(found, block.hits(shard), strict=True):
                    kept.extend(new)
                shard.clear()

            for text in texts:
                shard.append(words(text.as_py()))
                counts.append(len(shard[-1]))
                size += len(shard[-1])
                if size >= shard_words:
                    flush()
                    size = 0
            flush()
            out = []
            for n, ranges, items, state in zip(counts, *found, states.to_pylist(), strict=True):
                if state:
                    ranges = merged(ranges + [(r["start"], r["end"]) for r in state["ranges"]])
                    items = sorted({*items, *state["items"]})
                out.append({"n_words": n, "ranges": [{"start": a, "end": b} for a, b in ranges], "items": items})
            yield pa.array(out, kind)

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  shard_words: int = SHARD_WORDS, text: str = "text") -> Column:
    """Struct column of ``docs``: n_words, word ranges inside any occurrence of a window, items that occur."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), utf8(F.col("text")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    state = F.lit(None).cast(STATE)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # one bounded block
        shared = spark.sparkContext.broadcast(vars(Block([(r.item, bytes(r.text)) for r in rows], window)))
        state = _pass(shared, shard_words)(utf8(docs[text]), state)
    return state


@F.arrow_udf(RANGES)
def character_spans(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Word ranges as code point spans of the text."""
    out = []
    for text, some in zip(texts, ranges.to_pylist(), strict=True):
        at = [m.span() for m in _WORD.finditer(text.as_py() or "")] if some else []
        out.append([{"start": at[r["start"]][0], "end": at[r["end"] - 1][1]} for r in some or []])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


@F.arrow_udf(T.StringType())
def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The text with the spans cut out."""
    out = []
    for text, some in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        for s in reversed(some or []):
            text = text[: s["start"]] + text[s["end"] :]
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, word counts, items and removal spans (code points) of each row of ``docs``."""
    rows = docs.select("doc_id", "text")
    rows = rows.select("doc_id", "text", contamination(rows, benchmark, **options).alias("found"))
    return rows.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.aggregate("found.ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"]).alias("n_hit"),
        F.col("found.items").alias("items"),
        character_spans("text", "found.ranges").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    return docs.where(F.size(contamination(docs, benchmark, **options)["items"]) == 0)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256_hex(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
