"""Near-duplicate documents: SetSketch registers, bands, joint estimates, exact confirmation, components.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes), a digest of that set and a sketch of
   ``REGISTERS`` SetSketch registers. A register is the truncated exponent, to the base ``BASE``, of the minimum of
   exponentially distributed hashes; sketches of parts merge by maximum.
2. Texts with equal sets are one class, found by the digest; only one row per class goes on.
3. ``BANDS`` bands of ``REGISTERS // BANDS`` registers each put classes into buckets. Two registers agree with a
   probability of at least the similarity J, so a pair of similarity 0.75 shares no bucket with probability
   below (1 - 0.75^4)^32 = 6e-6.
4. Classes of one bucket are linked by hubs, never by all pairs: every class is compared with ``HUBS`` classes of its
   bucket, picked by hash. Then an exhaustive round compares each class outside its bucket's largest component with
   all classes of other components, so no link between components is lost to the hubs. Both sides are dealt into
   bounded blocks that meet in a grid; pairs never leave their cell, only rows and the links that join components do.
5. Every candidate pair is estimated jointly by maximum likelihood from its register comparison and the two set
   sizes; pairs ``SIGMAS`` standard deviations below the threshold are left out, all others are confirmed on the
   full sets by 100 * intersection >= 75 * union. Inside a cell the estimates choose the rows whose full sets are
   fetched, and those are compared exactly.
6. Links become components; a component is named by its smallest doc_id.

Cases: a null, empty or blank text has an empty set and is linked with nothing; fewer than five words are one shingle;
rows with a null doc_id take part and never name a component unless it holds no other id; repeated rows fall into one
class; two texts under one id stay two rows, each with its own component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import small, table, utf8, work_tables
from trialstats.llm.graph import components
from trialstats.session import cut, release

SHINGLE = 5
PERCENT = 75
REGISTERS = 128
BANDS = 32
#: close to 1, so that registers of unlike sets differ: at 1.1 two of them in 44 agree, and chance buckets grow with
#: the square of the input
BASE = 1.001
#: registers hold 0..65535; exponentials above this value truncate to 0
CEILING = 20.0
HUBS = 4
SIGMAS = 5.0
#: pairs that are estimated at once
TOGETHER = 20_000
#: rows and elements of their sets in one block of the exhaustive round, about
BLOCK_ROWS = 1024
BLOCK_ELEMENTS = 1 << 20
#: ids (16 bytes each) that are broadcast at most; more are joined by a shuffle
SMALL_IDS = 1_000_000
#: stands for a null doc_id where full sets are read
NO_ID = -(1 << 63)
#: words a task remembers the hash of
WORD_CACHE = 1 << 20


#: what the exhaustive round keeps of a row with a likely partner
_HITS = {"key": "long", "band": "int", "l": "int", "r": "int", "digest": "binary", "root": "binary", "n": "long",
         "loose": "boolean", "left": "boolean", "right": "boolean"}


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; words are what ASCII white space separates."""
    found = data.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(h) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(found), 1 + len(found))], np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + _mix(h[k : k + len(out)] + np.uint64(k + 1))
    return np.unique(_mix(out))


def _seeds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    low = random.integers(0, 1 << 32, registers, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return low, random.integers(0, 1 << 32, registers, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (uint16) of each set, one row per set; an empty set has zeros."""
    out = np.zeros((len(sets), registers), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    least = np.empty((len(full), registers), np.uint32)
    a, b = _seeds(registers)
    begin = 0
    while begin < len(full):  # about 2^16 elements at a time stay in the cache
        end, size = begin, 0
        while end < len(full) and (end == begin or size + len(sets[full[end]]) <= 1 << 16):
            size += len(sets[full[end]])
            end += 1
        flat = np.concatenate([sets[k] for k in full[begin:end]])
        low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[k]) for k in full[begin : end - 1]], dtype=np.int64)))
        for j in range(registers):
            least[begin:end, j] = np.minimum.reduceat(low * a[j] + high * b[j], starts)
        begin = end
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    exponential = -np.log1p(-uniform) / CEILING
    out[full] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, 65535).astype(np.uint16)
    return out


def joint_estimate(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each row pair of sketches, given the set sizes."""
    more, less = (first > second).sum(1), (first < second).sum(1)
    same = first.shape[1] - more - less
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        right = likelihood(x) < likelihood(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def _least_estimate(percent: int, registers: int) -> float:
    j = percent / 100
    return j - SIGMAS * math.sqrt(j * (1 - j) / registers)


_SUMMARY = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.BinaryType()),
])
_CLASS = T.StructType([*_SUMMARY.fields, T.StructField("elements", T.ArrayType(T.LongType()))])


def _sets(texts: pa.Array, hashes: WordHashes) -> tuple[list[np.ndarray], list[bytes]]:
    sets = [shingles(t.as_py(), hashes) for t in texts]
    return sets, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]


@F.arrow_udf(_SUMMARY)
def summaries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Set size, set digest and sketch of each text."""
    hashes = WordHashes()
    for texts in batches:
        sets, digests = _sets(texts, hashes)
        yield pa.StructArray.from_arrays([
            pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
            pa.array([r.tobytes() for r in sketches(sets)], pa.binary()),
        ], ["n", "digest", "sketch"])


@F.arrow_udf(_CLASS)
def full_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Set size, set digest, sketch and all shingles of each text."""
    hashes = WordHashes()
    for texts in batches:
        sets, digests = _sets(texts, hashes)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        yield pa.StructArray.from_arrays([
            pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
            pa.array([r.tobytes() for r in sketches(sets)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
        ], ["n", "digest", "sketch", "elements"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _likely(percent: int):
    @F.arrow_udf(T.BooleanType())
    def likely(a: pa.Array, b: pa.Array, n1: pa.Array, n2: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        first, second = _registers(a), _registers(b)
        n1, n2 = n1.to_numpy().astype(float), n2.to_numpy().astype(float)
        return pa.array(joint_estimate(first, second, n1, n2) >= _least_estimate(percent, first.shape[1]))

    return likely


class _Cell:
    """Rows of one cell of a bucket's grid, in the order of their digests."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.n, self.left, self.right, self.loose = (rows[c].to_numpy() for c in ("n", "left", "right", "loose"))
        roots = rows["root"].to_pylist()
        self.names = {c: k for k, c in enumerate(dict.fromkeys(roots))}
        self.root = np.array([self.names[r] for r in roots])
        self.hit = np.zeros(len(roots), bool)

    @cached_property
    def registers(self) -> np.ndarray:
        return _registers(self.rows["sketch"])

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Left and right rows of different components and close sizes, in the first band that they share; a bounded
        number at a time, by left row. Two loose rows meet in two cells, and are a pair in one of them."""
        lefts, rights = np.flatnonzero(self.left), np.flatnonzero(self.right)
        band = self.rows["band"][0].as_py()
        some = max(1, TOGETHER // max(1, len(rights)))
        for at in range(0, len(lefts), some):
            own = lefts[at : at + some, None]
            close = np.minimum(self.n[rights], self.n[own]) * 100 >= percent * np.maximum(self.n[rights], self.n[own])
            k, o = np.nonzero(close & (self.root[rights] != self.root[own]) & (~self.loose[rights] | (rights < own)))
            k, o = own[k, 0], rights[o]
            if len(k):
                same = (self.registers[k] == self.registers[o]).reshape(len(k), BANDS, -1).all(axis=2)
                first = same.argmax(axis=1) == band
                k, o = k[first], o[first]
            if len(k):
                yield k, o


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[_Cell]:
    """The cells of batches sorted by cell and digest."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch.column(c).to_numpy() for c in ("key", "l", "r")], axis=1)
        cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if held and tuple(where[begin]) != last:
                yield _Cell(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(begin, end - begin))
            last = tuple(where[begin])
    if held:
        yield _Cell(pa.Table.from_batches(held).combine_chunks())


def _narrow(percent: int):
    """Rows of cells to those rows that have a likely partner in their cell."""

    def estimate(waiting: list[tuple[_Cell, np.ndarray, np.ndarray]]) -> None:
        first = np.concatenate([c.registers[k] for c, k, _ in waiting])
        second = np.concatenate([c.registers[o] for c, _, o in waiting])
        sizes = [np.concatenate([c.n[x] for c, x in side]).astype(float)
                 for side in ([(c, k) for c, k, _ in waiting], [(c, o) for c, _, o in waiting])]
        good = joint_estimate(first, second, *sizes) >= _least_estimate(percent, first.shape[1])
        at = 0
        for cell, k, o in waiting:
            own = good[at : at + len(k)]
            cell.hit[k[own]] = cell.hit[o[own]] = True
            at += len(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[_Cell] = []  # cells with estimates to come
        waiting: list[tuple[_Cell, np.ndarray, np.ndarray]] = []
        pairs = rows = 0

        def done() -> Iterator[pa.RecordBatch]:
            for cell in open_:
                if cell.hit.any():
                    yield from cell.rows.filter(pa.array(cell.hit)).select(list(_HITS)).to_batches()

        for cell in _cells(batches):
            begun = False
            for k, o in cell.pairs(percent):
                waiting.append((cell, k, o))
                begun, pairs = True, pairs + len(k)
                if pairs >= TOGETHER:
                    estimate(waiting)
                    waiting, pairs = [], 0
            if begun:
                open_.append(cell)
                rows += len(cell.n)
            if pairs >= TOGETHER // 2 or rows >= TOGETHER:
                if waiting:
                    estimate(waiting)
                yield from done()
                open_, waiting, pairs, rows = [], [], 0, 0
        if waiting:
            estimate(waiting)
        yield from done()

    return run


def _linked(percent: int):
    """Rows of cells with their full sets to links between components, no more than a cell's components less one."""

    def links(cell: _Cell) -> Iterator[tuple[int, int]]:
        parent = list(range(len(cell.names)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        elements = cell.rows["elements"].combine_chunks()
        ids = np.unique(elements.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        ends = np.cumsum(cell.n)
        own = [ids[e - n : e] for e, n in zip(ends.tolist(), cell.n.tolist(), strict=True)]
        mark = np.zeros(len(ids), bool)
        for lefts, rights in cell.pairs(percent):
            for k in np.unique(lefts).tolist():
                mine = find(cell.root[k])
                others = [o for o in rights[lefts == k].tolist() if find(cell.root[o]) != mine]
                if not others:
                    continue
                mark[own[k]] = True
                starts = np.concatenate(([0], np.cumsum(cell.n[others])[:-1]))
                both = np.add.reduceat(mark[np.concatenate([own[o] for o in others])], starts, dtype=np.int64)
                mark[own[k]] = False
                near = both * 100 >= percent * (cell.n[k] + cell.n[others] - both)
                for o in np.array(others)[near].tolist():
                    x, y = find(cell.root[k]), find(cell.root[o])
                    if x != y:
                        parent[x] = y
                        yield k, o

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            found = list(links(cell))
            if found:
                digests = cell.rows["digest"]
                yield pa.RecordBatch.from_arrays(
                    [digests.take(pa.array([p[k] for p in found])).combine_chunks().cast(pa.binary()) for k in (0, 1)],
                    ["a", "b"])

    return run


def _buckets(classes: DataFrame, registers: int, bands: int) -> DataFrame:
    """key, band, digest and set size of every class that shares a bucket (band and its registers) with another."""
    width = 2 * registers // bands
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("sketch", 1 + width * b, width)) for b in range(bands)))
    rows = classes.select("digest", "n", F.posexplode(keys).alias("band", "key")).repartition("key")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(shared, "key", "left_semi")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches make the threshold likely and whose full sets reach it."""
    one = sets.select(F.col("digest").alias("a"), F.col("sketch").alias("s"), F.col("n").alias("m"))
    two = sets.select(F.col("digest").alias("b"), F.col("sketch").alias("t"), F.col("n").alias("o"))
    close = F.least("m", "o") * 100 >= F.greatest("m", "o") * percent
    likely = pairs.join(one, "a").join(two, "b").where(close).where(_likely(percent)("s", "t", "m", "o")).select("a", "b")
    # the pairs lie by b now, so that side's elements come first and only they move
    two = sets.select(F.col("digest").alias("b"), F.col("elements").alias("y"))
    one = sets.select(F.col("digest").alias("a"), F.col("elements").alias("x"))
    both = F.size(F.array_intersect("x", "y"))
    near = both * 100 >= (F.size("x") + F.size("y") - both) * percent
    return likely.join(two, "b").join(one, "a").where(near).select("a", "b")


def _rooted(frame: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("digest"), F.col("root").alias("_root"))
    return frame.join(named, "digest", "left").withColumn("root", F.coalesce("_root", "digest")).drop("_root")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each class with the hubs of its bucket: the first classes by ``HUBS`` different hashes."""
    first = [F.min(F.struct(F.xxhash64(F.lit(k), "digest").alias("h"), "digest")) for k in range(HUBS)]
    hubs = members.groupBy("key").agg(F.array_distinct(F.array(*(f["digest"] for f in first))).alias("_hubs"))
    pairs = members.join(hubs, "key").select("digest", F.explode("_hubs").alias("_hub")).where("digest <> _hub")
    return pairs.select(F.greatest("digest", "_hub").alias("a"), F.least("digest", "_hub").alias("b")).distinct()


def _grids(members: DataFrame) -> DataFrame:
    """Per bucket of several components: the largest of them, and the blocks of its two sides by rows and set sizes."""
    parts = members.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("elements"))
    whole = parts.groupBy("key").agg(
        F.sum("rows").alias("rows"), F.sum("elements").alias("elements"), F.count("*").alias("parts"),
        F.max(F.struct("rows", "root", "elements")).alias("big"))

    def blocks(rows: Column, elements: Column) -> Column:
        most = F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(elements / BLOCK_ELEMENTS))
        return most.cast("int")

    rows, elements, big = F.col("rows"), F.col("elements"), F.col("big")
    return whole.where("parts > 1").select(
        "key", big["root"].alias("_big"), blocks(rows - big["rows"], elements - big["elements"]).alias("_lefts"),
        blocks(rows, elements).alias("_rights"))


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r", "digest")


def _rest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes outside their bucket's largest component and those of its other components.

    Both sides are dealt by hash into blocks, which meet in a grid of cells, so a task holds two bounded blocks at most.
    Cells work on sketches first; only rows with a likely partner move again, with their full sets.
    """
    rows = members.join(_grids(members), "key").join(sets.select("digest", "sketch"), "digest")
    loose = F.col("root") != F.col("_big")

    def block(side: int, blocks: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(side), "digest"), F.col(blocks)).cast("int")

    rows = rows.select("*", loose.alias("loose"), block(1, "_lefts").alias("_l"), block(2, "_rights").alias("_r"))
    across = F.transform(F.sequence(F.lit(0), F.col("_rights") - 1), lambda r: F.struct(F.col("_l").alias("l"), r.alias("r")))
    down = F.transform(F.sequence(F.lit(0), F.col("_lefts") - 1), lambda k: F.struct(k.alias("l"), F.col("_r").alias("r")))
    rows = rows.withColumn("_cell", F.explode(F.when(F.col("loose"), F.array_union(across, down)).otherwise(down)))
    rows = rows.select(
        "key", "band", "_cell.l", "_cell.r", "digest", "root", "n", "sketch", "loose",
        (F.col("loose") & (F.col("_cell.l") == F.col("_l"))).alias("left"), (F.col("_cell.r") == F.col("_r")).alias("right"))
    hits = _by_cell(rows).mapInArrow(_narrow(percent), ", ".join(f"{k} {t}" for k, t in _HITS.items()))
    hits = hits.join(sets.select("digest", "sketch", "elements"), "digest")
    return _by_cell(hits).mapInArrow(_linked(percent), "a binary, b binary")


def _bucketed(sets: DataFrame, name: str) -> DataFrame:
    """Sketches and full sets in buckets by digest, so that confirming moves candidate pairs and never all sets."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = sets.repartition(parts, "digest").dropDuplicates(["digest"])
    once.write.bucketBy(parts, "digest").saveAsTable(name)
    return spark.table(name)


def _roots(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and root of every class with a confirmed link."""
    links = cut(_confirm(_hub_pairs(members), sets, percent))
    rest = cut(_rest_links(_rooted(members, components(links)), sets, percent))
    return components(links.unionAll(rest))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest of the set, root (a digest, null for an empty set), component_id and kept of each row."""
    rows = docs.select("doc_id", summaries(utf8(F.col("text"))).alias("_s"))
    rows = cut(rows.select("doc_id", "_s.n", "_s.digest", "_s.sketch"))
    classes = rows.where("n > 0").select("digest", "n", "sketch").dropDuplicates(["digest"])
    buckets = _buckets(classes, REGISTERS, BANDS)
    members = cut(buckets.select("key", "band", "digest", "n"))
    release(docs.sparkSession)
    wanted = members.select("digest").distinct()
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")
    ids = rows.where("n > 0").select(key, "digest").join(wanted, "digest", "left_semi")
    ids = ids.groupBy("digest").agg(F.min("_id").alias("_id")).select("_id").distinct()
    sets = docs.select(key, "text").join(small(cut(ids), SMALL_IDS), "_id", "left_semi")
    sets = sets.select(full_sets(utf8(F.col("text"))).alias("_s")).select("_s.*")
    with work_tables(docs.sparkSession) as database:
        stored = _bucketed(sets, f"{database}.sets")
        release(docs.sparkSession)
        roots = _roots(members, stored, percent)
    named = _rooted(rows.select("doc_id", "n", "digest"), roots)
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.withColumn("root", F.when(F.col("n") > 0, F.col("root")))
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "digest", "root",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@F.arrow_udf(T.BinaryType())
def set_digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Digest of each text's shingle set."""
    hashes = WordHashes()
    for texts in batches:
        yield pa.array(_sets(texts, hashes)[1], pa.binary())


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per component, that of the smallest doc_id; rows without words all stay."""
    found = cut(near_duplicates(docs, percent).select("doc_id", "digest", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    worded = found.where("root is not null")
    best = worded.groupBy("root").agg(F.min(order).alias("best"))
    sizes = worded.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n")).join(best, "root")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    key = [F.col("doc_id").alias("_id"), F.col("digest").alias("_out")]
    out = small(cut(sizes.where(~first).select(*key).distinct()), SMALL_IDS)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_set") == F.col("_out"))
    rows = docs.withColumn("_set", set_digests(utf8(F.col("text"))))
    kept = rows.join(out, same, "left_anti")
    again = cut(sizes.where(first & (F.col("n") > 1)).select(*key))
    if again.isEmpty():
        return kept.drop("_set")
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_set"])  # repeated rows of a kept document
    return kept.join(again, same, "left_anti").unionAll(once).drop("_set")


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("digest", "root")
