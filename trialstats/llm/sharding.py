"""Shards of near equal bytes by a k-d tree over document metadata, with DataFrame functions only.

Every document becomes one point: an integer coordinate per metadata dimension and a weight (UTF-8 bytes plus one).
Leaves are split level by level. A node is cut along its widest dimension (the largest share of the table's range) at
its weighted median, or at the share its leaves need when their number is odd. Medians come from distributed
histograms: one aggregation per pass gives the weight of ``BINS`` equal slices of every open node, and the slice that
holds the cut is sliced again until its weight is below ``TOLERANCE`` of the node, so a pass returns one row per node.

A coordinate is extended by the text's crc32 before it is cut, so texts that agree in every dimension are kept in one
shard. The query's dimensions are read off the text alone, so equal texts agree whatever their other columns say. Only when one such group alone outweighs ``GROUP`` of a leaf is it cut, by a hash
of doc_id: a text that holds a third of all rows is spread, and no group is ever gathered in a task.

Cases: a null text has size 1 and crc32 0; a null dimension is a coordinate of its own; an empty table has no shards;
repeated rows are points of their own and get slots of their own (they share a coordinate and usually a shard).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm.common import table, utf8
from trialstats.session import cut

BINS = 1024
#: share of a node's weight by which a cut may miss its target
TOLERANCE = 0.0005
#: share of a leaf's weight up to which equal texts are never cut
GROUP = 0.01
#: documents numbered together when slots are dealt
SLOT_BLOCK = 20_000
#: steps of the hash that cuts one group of equal coordinates
FINE = 1 << 20
_CRC = 1 << 32


@dataclass
class Node:
    """Leaves first..first+leaves-1; after a cut, rows below (dimension, key, fine) go to the left child."""

    first: int
    leaves: int
    cut: tuple[int, int, int] | None = None
    left: Node | None = None
    right: Node | None = None


def _walk(node: Node, leaf) -> Column:
    """The leaf value of each row as nested comparisons."""
    if node.cut is None:
        return leaf(node)
    dim, key, fine = node.cut
    return F.when(_below(dim, key, fine), _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def _below(dim: int, key: int, fine: int) -> Column:
    own = F.col(f"_k{dim}")
    return (own < key) | ((own == key) & (F.col("_fine") < fine))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.cut is None else _leaves(node.left) + _leaves(node.right)


def _cuts(points: DataFrame, root: Node, open_: list[Node], dims: int, full: list[float]) -> None:
    """Cut every open node once."""
    at = points.where(_walk(root, lambda n: F.lit(n.leaves > 1))).withColumn("_node", _walk(root, lambda n: F.lit(n.first)))
    sums = [F.sum("_w").alias("w")]
    for d in range(dims):
        sums += [F.min(f"_k{d}").alias(f"low{d}"), F.max(f"_k{d}").alias(f"high{d}")]
    stats = {r["_node"]: r for r in at.groupBy("_node").agg(*sums).collect()}  # a row per open node
    todo = {}
    for node in open_:
        if (r := stats.get(node.first)) is None:
            continue
        width = [(r[f"high{d}"] // _CRC - r[f"low{d}"] // _CRC) / full[d] for d in range(dims)]
        d = max(range(dims), key=lambda k: (width[k], r[f"high{k}"] - r[f"low{k}"], -k))
        todo[node.first] = {"node": node, "d": d, "low": r[f"low{d}"], "high": r[f"high{d}"], "w": r["w"],
                            "need": r["w"] * (node.leaves // 2) / node.leaves, "fine": False}
    while todo:
        key, low, step = F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
        for first, t in todo.items():
            here = F.col("_node") == first
            t["step"] = max(1, -(-(t["high"] - t["low"] + 1) // BINS))
            own = F.when(F.col(f"_k{t['d']}") == t["key"], F.col("_fine")) if t["fine"] else F.col(f"_k{t['d']}")
            key = F.when(here, own.cast("bigint")).otherwise(key)
            low = F.when(here, F.lit(t["low"])).otherwise(low)
            step = F.when(here, F.lit(t["step"])).otherwise(step)
        inside = at.select("_node", "_w", key.alias("_key"), low.alias("_low"), step.alias("_step"))
        inside = inside.where((F.col("_key") >= F.col("_low")) & (F.col("_key") < F.col("_low") + BINS * F.col("_step")))
        bins = inside.groupBy("_node", F.expr("(_key - _low) div _step").alias("bin")).agg(F.sum("_w").alias("w"))
        found: dict[int, list] = {}
        for r in bins.collect():  # at most BINS rows for each of the open nodes
            found.setdefault(r["_node"], []).append((r["bin"], r["w"]))
        for first, t in list(todo.items()):
            sofar = 0
            for b, w in sorted(found[first]):
                if sofar + w >= t["need"]:
                    break
                sofar += w
            begin = t["low"] + b * t["step"]
            whole = t["step"] == 1 and w <= GROUP * t["w"] / t["node"].leaves
            if w <= TOLERANCE * t["w"] or whole or (t["step"] == 1 and t["fine"]):
                edge = begin + t["step"] if sofar + w - t["need"] <= t["need"] - sofar else begin
                t["node"].cut = (t["d"], t["key"], edge) if t["fine"] else (t["d"], edge, 0)
                del todo[first]
            elif t["step"] == 1:  # one group of equal coordinates: go on by the hash of the id
                t.update(fine=True, key=begin, low=0, high=FINE - 1, need=t["need"] - sofar)
            else:
                t.update(low=begin, high=begin + t["step"] - 1, need=t["need"] - sofar)


def kd_tree(points: DataFrame, dims: int, shards: int | None = None, target: int | None = None) -> Node:
    """Tree over ``points`` (_k0.., _fine, _w) with ``shards`` leaves, or as many as bring them to ``target`` weight."""
    ends = [F.max(f"_k{d}") for d in range(dims)] + [F.min(f"_k{d}") for d in range(dims)]
    total, *ends = points.agg(F.coalesce(F.sum("_w"), F.lit(0)), *ends).first()
    root = Node(0, shards if shards is not None else max(1, math.ceil(total / target)))
    if not total:
        return root
    full = [max(1, ends[d] // _CRC - ends[dims + d] // _CRC) for d in range(dims)]
    while open_ := [n for n in _leaves(root) if n.leaves > 1]:
        _cuts(points, root, open_, dims, full)
        for n in open_:
            if n.cut is None:  # no rows here
                n.leaves = 1
                continue
            half = n.leaves // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.leaves - half)
    return root


def document_dimensions(docs: DataFrame) -> list[Column]:
    """Metadata that equal texts share: length, share of bytes beyond ASCII and share of spaces."""
    text = F.coalesce("text", F.lit(""))
    size, chars = F.octet_length(text), F.length(text)
    spaces = chars - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return [
        (F.log2(size + F.lit(1.0)) * 32768).cast("bigint"),
        ((size - chars) * F.lit(float(1 << 20)) / F.greatest(size, F.lit(1))).cast("bigint"),
        (spaces * F.lit(float(1 << 20)) / F.greatest(size, F.lit(1))).cast("bigint"),
    ]


def shard(docs: DataFrame, dimensions: list[Column], shards: int | None = None, target: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in each shard) of every row of ``docs``.

    ``dimensions`` are expressions over ``docs`` with values from 0 to 2^30; ``target`` is in bytes.
    """
    text = utf8(F.col("text"))
    crc = F.crc32(text)
    columns = [F.col("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), crc.alias("text_crc32")]
    keys = [
        ((F.coalesce(d.cast("bigint") + 1, F.lit(0)) * _CRC) + crc).alias(f"_k{n}") for n, d in enumerate(dimensions)
    ]
    fine = F.pmod(F.xxhash64("doc_id"), F.lit(FINE)).cast("bigint").alias("_fine")
    points = cut(docs.select(*columns, *keys, fine).withColumn("_w", F.col("size")))
    root = kd_tree(points, len(dimensions), shards, target)
    placed = points.select("doc_id", "size", "text_crc32", _walk(root, lambda n: F.lit(n.first)).alias("shard"))
    return slots(placed, points.count())


def slots(placed: DataFrame, rows: int) -> DataFrame:
    """Add ``slot``: 0, 1, ... in each shard, by blocks of ids so that no task numbers a whole shard."""
    blocks = max(1, math.ceil(rows / SLOT_BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "shard", "text_crc32", "size"), F.lit(blocks)).cast("int")
    placed = placed.withColumn("_block", block)
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.join(start, ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.row_number().over(inside) - 1).cast("bigint"))
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )


def op6_sharding(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    placed = shard(docs, document_dimensions(docs), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
