"""Cluster bootstraps: documents are drawn with replacement by hashed indices.

Nothing is resampled row by row. The positions of a draw are packed by range of positions; a range of them meets the
per-document counts of that range, and the counts are summed per draw.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType
from pyspark.sql.window import Window

from trialstats.functions import draws as D
from trialstats.functions.intervals import order_limits, peak_draw, sorted_draws
from trialstats.operators.cells import G
from trialstats.operators.counts import count_columns
from trialstats.operators.fit import COEFS, refit
from trialstats.plans.scale import broadcast_if_small, positions
from trialstats.rules import Rules
from trialstats.session import cut, parallelism

KEYS = ("model_id", "size", "statistic", "draw")
#: positions that are drawn together; a longer draw is spread over several tasks
BLOCK = 1_048_576
#: positions that are summed together (their offsets fit two bytes), columns of all groups beside them, and draws
CHUNK, COLUMNS, SERIES = 16_384, 512, 2_000
#: draws that are multiplied at a time
BATCH = 128


def _blocks(sizes: DataFrame, draws: int, snapshot_id: str, statistics: Sequence[str]) -> DataFrame:
    """One row per draw and block of it, with the payload up to the index, which is the same for a whole draw."""
    last = F.floor((F.col("size") - 1) / BLOCK).cast("bigint")
    head = F.concat(
        F.lit('["boot",'), D.json_string(F.lit(snapshot_id)), F.lit(","), D.json_string("model_id"),
        F.lit(","), D.json_string("statistic"), F.lit(","), D.number("draw"), F.lit(","),
    )
    return (
        sizes.withColumn("statistic", F.explode(F.lit(list(statistics))))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .repartition(parallelism(sizes.sparkSession), *KEYS, "_block").withColumn("_head", head)
    )


def resample_index(
    sizes: DataFrame, draws: int, snapshot_id: str, statistics: Sequence[str]
) -> DataFrame:
    """(model_id, size, statistic, draw, j, pos) for every draw; ``sizes`` has one row per model
    and population size. Draws and their blocks are spread over the tasks, so neither one model nor one
    large population sits in one task."""
    return _positions(_blocks(sizes, draws, snapshot_id, statistics)).select(*KEYS, "j", "pos")


def _positions(blocks: DataFrame) -> DataFrame:
    """A row per drawn index: the first 32 bits of its payload's digest, modulo the size."""
    first = F.col("_block") * BLOCK
    rows = blocks.withColumn("j", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("size")) - 1)))
    hashed = D.u32_of(F.sha2(F.concat("_head", D.number("j"), F.lit("]")), 256))
    # never null: without the default the join would filter on the hash and compute it twice
    pos = F.coalesce(hashed, F.lit(0).cast("bigint")) % F.col("size")
    return rows.withColumn("pos", F.coalesce(pos, F.lit(0).cast("bigint"))).drop("_head")


def _digests(head: bytes, start: int, stop: int, tails: tuple[list[bytes], list[bytes]]) -> np.ndarray:
    """First 32 bits of the digests of ``head``, an index and a bracket, for a range of indices.

    ``tails`` has the last digits with the bracket, as they stand alone and behind others.
    """
    parts, wide = [np.zeros(0, np.int64)], len(tails[0])
    while start < stop:
        high, low = divmod(start, wide)
        stem, ends = (head + b"%d" % high, tails[1]) if high else (head, tails[0])
        part = b"".join([sha256(stem + end).digest() for end in ends[low : min(stop - high * wide, wide)]])
        parts.append(np.frombuffer(part, ">u4")[::8].astype(np.int64))
        start = (high + 1) * wide
    return np.concatenate(parts)


def _ranges(pos: np.ndarray, size: int, chunk: int) -> Iterator[tuple[int, bool, bytes]]:
    """Range, whether dense, and bytes of positions: two bytes an offset where few are drawn, else a byte of multiplicity a
    position, in several rows where a byte is too small."""
    pos = np.sort(pos.astype(np.uint32))
    own = pos // chunk
    starts = np.flatnonzero(np.diff(own)) + 1
    for c, offsets in zip(own[np.append(0, starts)].tolist(), np.split(pos % chunk, starts), strict=True):
        width = min(chunk, size - c * chunk)
        if 2 * len(offsets) < width:
            yield c, False, offsets.astype("<u2").tobytes()
            continue
        times = np.bincount(offsets, minlength=width)
        while times.any():
            held = np.minimum(times, 255)
            yield c, True, held.astype(np.uint8).tobytes()
            times -= held


def _packed(blocks: DataFrame) -> DataFrame:
    """Drawn positions of every size in ``_sizes``, packed by range of them: rows of a draw, size, block and range.

    An index is hashed once for all populations of a model, and no row is made of it.
    """
    keys = ["model_id", "statistic", "draw", "_series"]
    blocks = blocks.select(*keys, "_block", "_head", "_sizes")
    schema = blocks.select(*keys).schema.add("size", "long").add("_chunk", "long").add("_dense", "boolean").add("_at", "binary")
    block, chunk = BLOCK, CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = [b"%d]" % j for j in range(10_000)], [b"%04d]" % j for j in range(10_000)]
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for row in batch.to_pylist():
                first = row["_block"] * block
                hashed = _digests(row["_head"].encode(), first, min(first + block, max(row["_sizes"])), tails)
                for size in row["_sizes"]:
                    if size <= first:
                        continue
                    own, dense, at = zip(*_ranges(hashed[: size - first] % size, size, chunk), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([row[k]] * len(own), t) for k, t in zip(keys, types, strict=True)),
                         pa.array([size] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array(dense), pa.array(at, pa.binary())],
                        names=[*keys, "size", "_chunk", "_dense", "_at"])

    return blocks.mapInArrow(run, schema)


def _times(at: Sequence[bytes], dense: Sequence[bool], chunk: int) -> np.ndarray:
    """Multiplicities of a range's positions, a line for each packed row."""
    out = np.zeros((len(at), chunk))
    for line, row, full in zip(out, at, dense, strict=True):
        times = np.frombuffer(row, np.uint8) if full else np.bincount(np.frombuffer(row, "<u2"))
        line[: len(times)] = times
    return out


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values with zero for null, and which are there."""
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


def _product(weights: np.ndarray, values: np.ndarray, whole: bool) -> np.ndarray:
    """Weighted sums; whole numbers stay exact, in 64 bits where doubles could round."""
    most = float(weights.sum(axis=1).max()) * float(np.abs(values.astype(float)).max(initial=0))
    if whole and most >= 2.0**53:
        return weights.astype(np.int64) @ values
    return weights @ values.astype(float)


def multiplicities(index: DataFrame) -> DataFrame:
    """How often each document appears in each draw."""
    return index.groupBy("model_id", "size", "statistic", "draw", "pos").agg(
        F.count(F.lit(1)).alias("w")
    )


def placed_documents(docs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Documents with their position in the sorted population of their group."""
    return positions(docs, g, "doc_id")


def draw_sums(
    placed: DataFrame,
    values: Sequence[str],
    draws: int,
    snapshot_id: str,
    statistics: Sequence[str],
    g: Sequence[str] = G,
) -> DataFrame:
    """Sums of ``values`` (whole numbers or doubles) over the documents of every draw, per group and statistic.

    Groups of one model share the hashes of their indices, so those are taken once. A task sums one range of positions, of
    as many groups as fill ``COLUMNS`` columns, over at most ``SERIES`` draws of a statistic: its memory depends on none of the
    tables, and what moves is about a byte per drawn index and population size, two at most.
    """
    whole = all(isinstance(placed.schema[v].dataType, IntegralType) for v in values)
    if not whole and not all(isinstance(placed.schema[v].dataType, (IntegralType, DoubleType, FloatType)) for v in values):
        raise TypeError("draws are summed over whole numbers or doubles")
    slot, series = max(1, COLUMNS // len(values)), -(-draws // SERIES)
    groups = cut(placed.where(F.col("model_id").isNotNull()).select(*g, "size").distinct())
    sizes = groups.groupBy("model_id").agg(F.max("size").alias("size"), F.collect_set("size").alias("_sizes"))
    # one row per group: the groups of one model and size are dealt into slots
    numbered = groups.withColumn("_n", F.row_number().over(Window.partitionBy("model_id", "size").orderBy(*g)) - 1)
    numbered = cut(numbered.select(
        *[F.col(c).alias(f"_g_{c}") for c in g], "size", (F.col("_n") % slot).alias("_group"), F.floor(F.col("_n") / slot).alias("_slot")))
    slots = numbered.groupBy(F.col("_g_model_id").alias("model_id"), "size").agg(F.max("_slot").alias("_last"))
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g]
    each = F.explode(F.sequence(F.lit(0), F.lit(len(statistics) * series - 1)))
    docs = placed.join(broadcast_if_small(numbered.drop("size")), on).select(
        *g, "size", "_slot", "_group", each.alias("_series"), F.floor(F.col("pos") / CHUNK).alias("_chunk"),
        (F.col("pos") % CHUNK).alias("_at"), *values)
    order = F.array_position(F.lit(list(statistics)), F.col("statistic")).cast("int") - 1
    blocks = _blocks(sizes, draws, snapshot_id, statistics).withColumn(
        "_series", order * series + F.floor(F.col("draw") / SERIES).cast("int"))
    drawn = _packed(blocks).join(broadcast_if_small(slots), ["model_id", "size"]).withColumn(
        "_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))).drop("_last")
    schema = docs.select(*g).schema.add("statistic", "string").add("draw", "integer")
    for v in values:
        schema = schema.add(v, "long" if whole else "double")
    names, chunk, batch = list(values), CHUNK, BATCH

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        types = [right.schema.field(c).type for c in g]
        kind, dtype = (pa.int64(), np.int64) if whole else (pa.float64(), np.float64)
        kinds = [*types, pa.string(), pa.int32(), *[kind] * len(names)]
        labels = [*g, "statistic", "draw", *names]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=labels)
        at, which = right["_at"].to_numpy(), right["_group"].to_numpy()
        here, first, which = np.unique(which, return_index=True, return_inverse=True)
        there = np.zeros((chunk, len(here), len(names)), dtype)
        known = np.zeros((chunk, len(here), len(names)), bool)
        for i, v in enumerate(names):
            there[at, which, i], known[at, which, i] = _numbers(right[v])
        there = there.reshape(chunk, -1)
        gaps = int(known.sum()) < len(at) * len(names)
        place = np.zeros((chunk, len(here)))
        place[at, which] = 1.0
        owners = right.select(list(g)).take(pa.array(first))
        parts = []
        for start in range(0, left.num_rows, batch):
            rows = left.slice(start, batch)
            weights = _times(rows["_at"].to_pylist(), rows["_dense"].to_pylist(), chunk)
            sums = _product(weights, there, whole).reshape(len(weights), len(here), -1)
            seen = (weights @ place) > 0
            null = (weights @ known.reshape(chunk, -1).astype(float)).reshape(sums.shape) == 0 if gaps else None
            r, k = np.nonzero(seen)
            columns = [owners[c].take(pa.array(k)).combine_chunks() for c in g]
            columns += [rows[c].take(pa.array(r)).combine_chunks() for c in ("statistic", "draw")]
            columns += [pa.array(sums[r, k, i].astype(dtype), kind, mask=null[r, k, i] if gaps else None) for i in range(len(names))]
            parts.append(pa.table(columns, names=labels))
        return pa.concat_tables(parts)

    keys = ["model_id", "size", "_chunk", "_slot", "_series"]
    sums = drawn.groupBy(*keys).cogroup(docs.groupBy(*keys)).applyInArrow(run, schema)
    return sums.groupBy(*g, "statistic", "draw").agg(*[F.sum(v).alias(v) for v in values])


def regression_draws(
    placed: DataFrame, cells, snapshot_id: str, g: Sequence[str] = G, rules: Rules = Rules(),
    statistic: str = "p1",
) -> DataFrame:
    """Refit of every draw with the drop of each zero-row column against the last column."""
    sums = draw_sums(placed, count_columns(cells), rules.draws, snapshot_id, [statistic], g)
    last = cells.index((rules.peak_range[1], rules.drop_fault_pct))
    keys = [*g, "draw"]
    zero_row = [
        (t, cells.index((t, rules.drop_fault_pct))) for t in rules.scope_tools
        if (t, rules.drop_fault_pct) in cells
    ]
    rate = lambda i: F.try_divide(F.col(f"s_{i}"), F.col(f"n_{i}"))
    drops = F.create_map(
        *[e for t, i in zero_row for e in (F.lit(t), 100.0 * (rate(i) - rate(last)))]
    )
    carried = sums.withColumn("drops", drops)
    return refit(carried, cells, [*keys, "drops"], rules)


def regression_bootstrap(
    draws: DataFrame, columns: DataFrame, g: Sequence[str] = G, rules: Rules = Rules()
) -> DataFrame:
    """Intervals of the peak, the coefficients and the drop, and the share of each kind of draw.

    ``columns`` has the drop column of each group (from the primary fit, never from a draw).
    """
    drop = F.try_element_at(F.col("drops"), F.col("drop_column"))
    agg = (
        draws.join(columns.select(*g, "drop_column"), list(g))
        .groupBy(*g)
        .agg(
            F.count(F.lit(1)).alias("draws"),
            sorted_draws(peak_draw("ok", "tc", "tc2")).alias("_peak"),
            *[sorted_draws(F.when(F.col("ok"), F.col(c))).alias(f"_{c}") for c in COEFS],
            sorted_draws(drop).alias("_drop"),
            F.count_if(F.col("ok") & (F.col("tc2") < 0)).alias("_neg"),
            F.count_if(~F.col("ok")).alias("_failed"),
            F.count_if(F.col("firth")).alias("_firth"),
        )
    )
    out = [*g, "draws"]
    for name in ("peak", *COEFS, "drop"):
        lo, hi = order_limits(F.col(f"_{name}"), rules.alpha)
        out += [lo.alias(f"boot_{name}_lo"), hi.alias(f"boot_{name}_hi")]
    for name, source in (("b2_negative", "_neg"), ("failed", "_failed"), ("firth", "_firth")):
        out.append((F.col(source) / F.col("draws")).alias(f"{name}_fraction"))
    return agg.select(*out)


def ratio_bootstrap(
    placed: DataFrame,
    ratios: dict[str, tuple[str, str]],
    snapshot_id: str,
    g: Sequence[str] = G,
    rules: Rules = Rules(),
) -> DataFrame:
    """Interval of sum(value)/sum(count) over document draws; ``ratios`` maps each statistic name
    to its (value, count) columns."""
    values = sorted({c for pair in ratios.values() for c in pair})
    sums = draw_sums(placed, values, rules.draws, snapshot_id, list(ratios), g)
    stat = F.lit(None).cast("double")
    for name, (value, count) in ratios.items():
        stat = F.when(F.col("statistic") == name, F.col(value) / F.col(count)).otherwise(stat)
    agg = sums.groupBy(*g, "statistic").agg(sorted_draws(stat.cast("double")).alias("_v"))
    lo, hi = order_limits(F.col("_v"), rules.alpha)
    return agg.select(*g, "statistic", F.size("_v").alias("draws"), lo.alias("lo"), hi.alias("hi"))
