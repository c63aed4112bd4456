"""Merkle manifest of a dataset: bitmap ranks give leaf coordinates, keyed slot arrays reduce the levels.

1. Every row becomes a leaf: the hash of its columns. Only ids and hashes go on, no texts.
2. Per group (source) the ids form a compressed bitmap: 64-bit words keyed by id >> 6, words without an id left out. Words
   are merged by bit-or with partial aggregation in the map tasks. Popcount directories over chunks of 2^10 words, 2^26
   and 2^42 give the number of ids before each word; no window sees more than 65,536 rows, however sparse the ids are.
3. The rank of an id is the directory's count plus the popcount below its bit: rows learn their place without a sort.
4. A level is reduced by key: nodes with the same place // ``ARITY`` fill the slots of one array of at most ``ARITY``
   hashes, whose hash is the parent. The groups' last nodes are reduced in the same way, in the order of the groups.
5. Proofs are handed down from the root: a node's row holds what its leaves share, so that siblings above the lowest
   level are stored once for ``ARITY`` leaves.

Cases: a null id comes first in its group, a null group first of all; a null column is hashed as ``-``, an empty text as
``0:``; repeated ids, equal rows among them, are leaves of their own in the order of their hashes (ranked by ranges, so
that an id with a third of all rows is no single task); an empty table has no leaves and no root; other columns
play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm.common import DOCUMENT_COLUMNS, spread_join, table
from trialstats.plans.scale import positions
from trialstats.session import cut

ARITY = 16
#: columns of a leaf, in order
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
#: rows whose id's crc32 this divides are tampered with by the query
TAMPERED = 5
#: word of null ids: below every other
_NO_WORD = -(1 << 60)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Manifest:
    """``levels[k]``: ``group``, ``idx``, ``n`` (nodes of the group below), ``kids`` and ``hash``; ``top`` likewise over the
    groups' subroots; ``groups``: ``group``, ``pos`` and ``hash`` (the subroot); ``root`` in lowercase hex."""

    levels: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    root: str | None


def leaf_hash(*columns: Column) -> Column:
    """Hash of columns: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash_of(digests: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("", F.transform(digests, _hex)).cast("binary"), 256))


def _directory(leaves: DataFrame) -> DataFrame:
    """group, word, bits, n (rows of the word), before (rows of the group in lower words) and total (of the group)."""
    words = cut(leaves.groupBy("group", "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n")))
    steps = [("c1", 10), ("c2", 26), ("c3", 42)]
    words = words.select("*", *(F.shiftright("word", bits).alias(c) for c, bits in steps))
    below, out = "word", words
    counts = words.select("group", "word", "c1", "c2", "c3", "n")
    for c, _ in [*steps, (None, None)]:
        keys = ["group", c] if c else ["group"]
        inside = Window.partitionBy(*keys).orderBy(below)
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        own = [F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(f"before_{below}")]
        if c is None:
            own.append(F.sum("n").over(Window.partitionBy("group")).alias("total"))
        out = out.join(counts.select("group", below, *own), ["group", below])
        if c:
            rest = [k for k, _ in steps[[k for k, _ in steps].index(c):]]
            counts, below = counts.groupBy("group", *rest).agg(F.sum("n").alias("n")), c
    before = reduce(Column.__add__, (F.col(f"before_{k}") for k in ("word", "c1", "c2", "c3")))
    return cut(out.select("group", "word", "bits", "n", before.alias("before"), "total"))


def ranked(leaves: DataFrame) -> DataFrame:
    """Add ``pos`` (place by id in the group) and ``total`` to written leaves with ``group``, ``doc_id``, ``hash`` and ``row``."""
    leaves = leaves.select(
        "*", F.coalesce(F.shiftright("doc_id", 6), F.lit(_NO_WORD)).alias("word"),
        F.coalesce(F.expr("cast(doc_id & 63 as int)"), F.lit(0)).alias("bit"))
    found = spread_join(leaves, _directory(leaves), ["group", "word"], "n", ["row"])
    once = F.col("n") == F.expr("bit_count(bits)")
    rank = F.expr("before + bit_count(bits & ~shiftleft(-1L, bit))")
    columns = [c for c in leaves.columns if c not in ("word", "bit")]
    single = found.where(once).select(*columns, rank.alias("pos"), "total")
    repeated = cut(found.where(~once).withColumn("_by", F.struct("doc_id", "hash", "row")))
    if repeated.isEmpty():
        return single
    inside = positions(repeated, ["group", "word"], "_by")
    return single.unionByName(inside.select(*columns, (F.col("before") + F.col("pos")).alias("pos"), "total"))


def _levels(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Slot arrays level by level of nodes with ``group``, ``pos``, ``n``, ``hash``; the lowest arrays keep ``payload`` too."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    while most > 1 or not levels:
        slot = F.struct((F.col("pos") % ARITY).alias("slot"), "hash", *payload)
        arrays = nodes.groupBy("group", F.expr(f"pos div {ARITY}").alias("idx")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(slot)).alias("kids"))
        level = cut(arrays.withColumn("hash", F.when(F.col("n") == 1, F.col("kids")[0]["hash"]).otherwise(_hash_of(F.col("kids.hash")))))
        levels.append(level)
        nodes = level.where("n > 1").select("group", F.col("idx").alias("pos"), F.ceil(F.col("n") / ARITY).alias("n"), "hash")
        nodes, payload, most = nodes.where("n > 1"), [], -(-most // ARITY)
    return levels


def _ends(levels: list[DataFrame]) -> DataFrame:
    """The last node of every group."""
    return reduce(DataFrame.unionByName, (level.where(f"n <= {ARITY}").select("group", "hash") for level in levels))


def build(leaves: DataFrame, payload: list[str]) -> Manifest:
    """The manifest of written leaves: ``group`` (a string), ``doc_id``, ``hash`` (binary), ``row`` (unique) and ``payload``."""
    placed = ranked(leaves).withColumnRenamed("total", "n")
    levels = _levels(placed, payload)
    ends = cut(_ends(levels))
    groups = cut(positions(ends.withColumn("all", F.lit("")), ["all"], "group").withColumnRenamed("size", "n"))
    top = _levels(groups.select(F.col("all").alias("group"), "pos", "n", "hash"), [])
    last = _ends(top).first()
    return Manifest(levels, groups, top, bytes(last["hash"]).hex() if last else None)


def _below(level: DataFrame, above: DataFrame, extra: list[str]) -> DataFrame:
    """Kids of ``level`` with their siblings and those of the nodes above: group, idx, kid, steps and ``extra``."""
    rows = level.join(above, ["group", "idx"]).withColumn("_all", F.transform("kids.hash", _hex))
    kid = rows.select("*", F.posexplode("kids").alias("_slot", "kid"))
    step = F.struct(
        F.concat_ws("", F.expr("slice(_all, 1, _slot)")).alias("before"),
        F.concat_ws("", F.expr(f"slice(_all, _slot + 2, {ARITY})")).alias("after"))
    steps = F.when(F.col("n") == 1, F.col("steps")).otherwise(F.concat(F.array(step), F.col("steps")))
    return kid.select("group", (F.col("idx") * ARITY + F.col("_slot")).alias("idx"), "kid", steps.alias("steps"), *extra)


_STEPS = "array<struct<before:string,after:string>>"


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: group, kid (its slot), subroot in hex and steps: hex of the siblings before and after, from the leaf up."""
    above = manifest.top[-1].where(f"n <= {ARITY}").select("group", "idx", F.array().cast(_STEPS).alias("steps"))
    for level in reversed(manifest.top):
        above = _below(level, above, []).select("group", "idx", "steps")
    starts = cut(manifest.groups.select("group", F.col("pos").alias("idx"), _hex(F.col("hash")).alias("subroot")).join(
        above.select("idx", "steps"), "idx").select("group", F.lit(0).cast("bigint").alias("idx"), "steps", "subroot"))
    above = None
    for level in reversed(manifest.levels):
        first = level.where(f"n <= {ARITY}").select("group", "idx").join(starts, ["group", "idx"])
        above = first if above is None else above.select("group", "idx", "steps", "subroot").unionByName(first)
        above = _below(level, above, ["subroot"])
    return above


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give, in hex."""
    return F.aggregate(steps, leaf, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]).cast("binary"), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Written leaves of documents, and under ``other`` the hash of the tampered row where that differs."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    own = leaf_hash(*(F.col(c) for c in LEAF))
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    other = F.when(chosen & (lowered != F.col("text")), leaf_hash(*(lowered if c == "text" else F.col(c) for c in LEAF)))
    return cut(docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("group"), "doc_id",
        F.unhex(own).alias("hash"), F.unhex(other).alias("other"), F.monotonically_increasing_id().alias("row")))


def op13_manifest(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    manifest = build(document_leaves(docs), ["doc_id", "other"])
    root = F.lit(manifest.root).cast("string")
    siblings = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"])))
    folded = fold(_hex(F.coalesce("kid.other", "kid.hash")), F.col("steps"))
    return proofs(manifest).select(
        F.col("kid.doc_id").alias("doc_id"), _hex(F.col("kid.hash")).alias("leaf"), "subroot", root.alias("root"),
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
