"""Alignment of two tokenizers: exact texts are tokenised once, pair counts are weighted by multiplicity.

1. Rows are shuffled by their full text and counted, equal texts already in the map tasks, so a text with a third of all
   rows costs one row per task.
2. Each distinct text is encoded by both tokenizers. Byte offsets where tokens of both end cut it into groups; the two
   tokens that end there are a link. The result is written once: measures, and the text's distinct links with their
   times as two arrays.
3. Corpus counts of links: links times copies of the text, summed with map-side aggregation; a link is best if no other
   link of its B id has a higher count.
4. Counts go back to the texts in blocks of at most ``BLOCK`` links, one block broadcast at a time (usually there is one);
   sums per text leave each block.
5. Measures meet doc_ids by the SHA-256 of the text; texts with very many rows are dealt over several tasks.

Both tokenizers are read in each task from ``folder``, a parameter. No token of either is empty, so links and groups
of a text are equal in number.

Cases: null and empty texts, and texts that a tokenizer does not give back byte by byte after a space, have zeros and an
empty string; ids may be null or repeated, each row is answered; a tie for the highest count makes all its links best; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import spread_join, table, work_tables
from trialstats.session import cut

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: B ids are below this, A ids below 2^16, so a link (A id times this plus B id) is an int
B_IDS = 1 << 15
#: links whose counts are broadcast at once (16 bytes each)
BLOCK = 2_000_000
#: bytes of text that are aligned at once
TOGETHER = 1 << 20


def _byte_values() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes and the decimal forms of their tokens."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        values = _byte_values()
        vocabulary = sorted(self.a.get_vocab().items(), key=lambda item: item[1])
        # an added token is plain text, not byte-level; it is never given out for a text
        a = [bytes(values.get(c, 63) for c in piece) for piece, _ in vocabulary]
        b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
             for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.bytes = [pa.array(a, pa.binary()), pa.array(b, pa.binary())]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
        # an id followed by what separates it from the next: inside a side, between the sides, between the groups
        numbers = [np.arange(len(side)).astype(str).astype(object) for side in (a, b)]
        self.texts = pa.array(np.concatenate([numbers[0] + ",", numbers[0] + "|", numbers[1] + ",", numbers[1] + ";"]), pa.string())
        self.starts = np.array([0, len(a), 2 * len(a), 2 * len(a) + len(b)])

    def encode(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of each text by A (after a space) and by B (which adds it)."""
        return [[e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)],
                self.b.encode(texts, num_threads=1)]


def _joined(values: pa.Array, codes: np.ndarray, offsets: np.ndarray, empty) -> list:
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(codes)))
    return pc.binary_join(lists, empty).to_pylist()


def align(pair: Pair, texts: list[str]) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, groups, links, times) of each text, links distinct; zeros where tokens do not give the text back."""
    ids = pair.encode(texts)
    whole = [b" " + t.encode() for t in texts]
    same = np.ones(len(texts), bool)
    flat, offsets, text_of, ends = [], [], [], []
    before = np.concatenate(([0], np.cumsum([len(w) for w in whole])))
    for side in (0, 1):
        sizes = np.array([len(x) for x in ids[side]], np.int64)
        offsets.append(np.concatenate(([0], np.cumsum(sizes))))
        flat.append(np.fromiter((i for x in ids[side] for i in x), np.int64, offsets[side][-1]))
        back = _joined(pair.bytes[side], flat[side], offsets[side], b"")
        same &= np.array([x == w for x, w in zip(back, whole, strict=True)], bool)
        text_of.append(np.repeat(np.arange(len(texts)), sizes))
        run = np.concatenate(([0], np.cumsum(pair.sizes[side][flat[side]])))
        first = run[offsets[side][:-1]]
        ends.append(before[text_of[side]] + run[1:] - first[text_of[side]])  # of the batch, in bytes
    for side in (0, 1):
        keep = same[text_of[side]]
        flat[side], text_of[side], ends[side] = flat[side][keep], text_of[side][keep], ends[side][keep]
    cuts, in_a, in_b = np.intersect1d(ends[0], ends[1], assume_unique=True, return_indices=True)
    links, of = flat[0][in_a] * B_IDS + flat[1][in_b], text_of[0][in_a]
    # written form: tokens by group, side and place; the last one of a side in its group has the longer separator
    closing = [np.zeros(len(flat[k]), np.int64) for k in (0, 1)]
    closing[0][in_a], closing[1][in_b] = 1, 1
    codes = np.concatenate([pair.starts[2 * k + closing[k]] + flat[k] for k in (0, 1)])
    group = np.concatenate([np.searchsorted(cuts, ends[k]) * 2 + k for k in (0, 1)])
    order = np.argsort(group, kind="stable")
    tokens = [np.bincount(text_of[k], minlength=len(texts)) for k in (0, 1)]
    pieces = np.concatenate(([0], np.cumsum(tokens[0] + tokens[1])))
    written = _joined(pair.texts, codes[order], pieces, "")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
    for k in range(len(texts)):
        if same[k]:
            own, times = np.unique(links[bounds[k] : bounds[k + 1]], return_counts=True)
            yield int(tokens[0][k]), int(tokens[1][k]), int(bounds[k + 1] - bounds[k]), written[k][:-1], own, times
        else:
            yield 0, 0, 0, "", links[:0], links[:0]


_ENCODED = "digest binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, times array<int>"
_NAMES = ["digest", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times"]
_TYPES = [pa.binary(), *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 2]


def _encoder(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            pair = pair or Pair(folder)
            digests, copies, texts = (batch.column(k).to_pylist() for k in range(3))
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= TOGETHER):
                    size += len(texts[end])
                    end += 1
                rows = []
                for d, c, (a, b, g, written, own, times) in zip(digests[begin:end], copies[begin:end], align(pair, texts[begin:end]), strict=True):
                    sha = hashlib.sha256(written.encode()).hexdigest() if a else ""
                    rows.append((d, c, a, b, g, sha, own.astype(np.int32), times.astype(np.int32)))
                begin = end
                columns = zip(zip(*rows, strict=True), _TYPES, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], _NAMES)

    return run


def encoded(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """A row for each distinct text but null and the empty one: its digest, copies, measures, links and times."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    # short tasks: tokenising is the dear part, and a lost executor loses only what its tasks did
    return texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text").mapInArrow(_encoder(folder), _ENCODED)


def link_counts(texts: DataFrame) -> DataFrame:
    """link, count over the corpus and whether no other link of its B id has a higher one."""
    links = texts.select("copies", F.explode(F.arrays_zip("links", "times")).alias("x"))
    counts = cut(links.groupBy(F.col("x.links").alias("link")).agg(F.sum(F.col("x.times") * F.col("copies")).alias("count")))
    b = (F.col("link") % B_IDS).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))  # a row per B id
    return counts.withColumn("b", b).join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def link_sums(texts: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """digest, n_best and count_sum of each text, from written counts, a block of them at a time."""
    blocks = max(1, -(-counts.count() // block))
    parts = []
    for k in range(blocks):
        own = counts if blocks == 1 else cut(counts.where(F.pmod(F.xxhash64("link"), F.lit(blocks)) == k))
        links = texts.select("digest", F.explode(F.arrays_zip("links", "times")).alias("x")).select("digest", "x.links", "x.times")
        met = links.join(F.broadcast(own), links["links"] == own["link"])
        parts.append(cut(met.groupBy("digest").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if blocks == 1 else out.groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def alignment(docs: DataFrame, folder: str = TOKENIZERS, block: int = BLOCK) -> DataFrame:
    """The measures of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    with work_tables(docs.sparkSession) as database:
        encoded(docs, folder).write.saveAsTable(f"{database}.texts")
        texts = docs.sparkSession.table(f"{database}.texts")
        sums = link_sums(texts, cut(link_counts(texts)), block)
        known = cut(texts.join(sums, "digest", "left").select(
            "digest", "copies", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
            *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")), "groups_sha256"))
    rows = docs.where("text <> ''").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    met = spread_join(rows, known, ["digest"], "copies", ["doc_id"]).select("doc_id", *_MEASURES, "groups_sha256")
    empty = docs.where("coalesce(text, '') = ''")
    zeros = [F.lit(0).cast("bigint").alias(c) for c in _MEASURES]
    return met.unionByName(empty.select("doc_id", *zeros, F.lit("").alias("groups_sha256")))


def op12_alignment(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents") if docs is None else docs)
