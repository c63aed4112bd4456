"""Plan fragments that keep hot keys, long groups and wide broadcasts under control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialstats.session import cut, parallelism

BROADCAST_VALUES = 8_000_000
#: fact rows of one key that one task takes in a join
TASK_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint only when a count proves the side is small; otherwise the planner chooses.

    The limit is on rows times columns (8 million numbers are 64 MB). Call it on a written (cut)
    table, so the count does not recompute anything.
    """
    rows = rows or BROADCAST_VALUES // len(df.columns)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_key_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "inner",
    limit: int = TASK_ROWS,
) -> DataFrame:
    """Join a fact table with a table that is unique on ``keys``, splitting hot keys.

    A key with more than ``limit`` fact rows is hot and gets a salt for every ``limit`` of them, so no task
    holds much more than that whatever a key's share; the lookup row is copied to each salt.
    """
    keys = list(keys)
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > limit).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_rows") / limit).cast("bigint").alias("_salts"))
    hot = broadcast_if_small(cut(hot))

    def marked(df: DataFrame) -> DataFrame:
        on = [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys]
        return df.join(hot, on, "left").drop(*[f"_hot_{k}" for k in keys])

    salted = marked(facts).withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")), F.lit(0))
    ).drop("_salts")
    last = F.coalesce(F.col("_salts") - 1, F.lit(0)).cast("bigint")
    copies = (
        marked(lookup)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("_salts")
    )
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*(f"_right_{k}" for k in keys))


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` written in ranges of group and order whose bounds are measured from the data.

    ``_part`` rises with them and ``_uid`` tells equal rows apart, so a range holds about ``rows`` rows whatever the values
    look like.
    """
    spark = df.sparkSession
    parts = max(parallelism(spark), -(-df.count() // rows))
    named = df.withColumn("_uid", F.monotonically_increasing_id())
    return cut(named.repartitionByRange(parts, *group, *order, "_uid").withColumn("_part", F.spark_partition_id()))


#: bounds of a group that ``split`` takes (a power of two), and values that are looked at for each
SPLITS, SEEN = 64, 64


def split(df: DataFrame, group: Sequence[str], order: str, rows: int) -> DataFrame:
    """``df`` with ``_range`` from 0 to ``SPLITS``, which rises with the order inside a group; no row moves.

    The bounds come from a hashed few of the ``rows`` rows. They decide only how even the ranges are: equal values share a
    range, and nulls lie in the first.
    """
    group = list(group)
    one_in = max(1, rows // (SPLITS * SEEN))
    seen = df.where(F.pmod(F.xxhash64(order), F.lit(one_in)) == 0).select(*group, order).distinct()
    dealt = seen.withColumn("_tile", F.ntile(SPLITS).over(Window.partitionBy(*group).orderBy(order)))
    least = dealt.groupBy(*group, "_tile").agg(F.min(order).alias("_least"))
    bounds = cut(least.groupBy(*group).agg(F.array_sort(F.collect_list("_least")).alias("_bounds")))
    out = null_safe_join(df, broadcast_if_small(bounds, BROADCAST_VALUES // SPLITS), group, "left").withColumn("_range", F.lit(0))
    step = SPLITS
    while step:  # binary search for the number of bounds up to the value
        passed = F.get("_bounds", F.col("_range") + (step - 1)) <= F.col(order)
        out = out.withColumn("_range", F.col("_range") + F.when(passed, step).otherwise(0))
        step //= 2
    return out.drop("_bounds")


def running_before(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column], rows: int = TASK_ROWS,
) -> DataFrame:
    """Running sums over all earlier rows of a group, without one task per group: a prefix scan in two levels.

    Ranges are summed first; the small table of ranges carries what lies before each.
    """
    group, order = list(group), list(order)
    base = in_ranges(df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()]), group, order, rows)
    totals = base.groupBy(*group, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_part").orderBy(*order, "_uid").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums]
    out = null_safe_join(base.select("*", *own), carried, [*group, "_part"])
    names = [c for c in df.columns if c not in sums]
    return out.select(*names, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def positions(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Add ``pos`` (0-based rank by ``order``) and ``size`` to rows distinct per group and order.

    The table is range-partitioned, written once, and ranked inside each range; the per-range
    counts give the offsets. No group is ever sorted by a single task.
    """
    group = list(group)
    ranged = cut(
        df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id())
    )
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    all_parts = Window.partitionBy(*group)
    earlier = all_parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group,
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(all_parts).alias("size"),
    )
    inside = Window.partitionBy(*group, "_part").orderBy(order)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "_part"])
        .withColumn("pos", (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_part", "_rank", "_offset")
    )


def hashed_order(df: DataFrame, group: Sequence[str], unit: str, tie: str, buckets: int = 1024) -> DataFrame:
    """``pos`` and ``size`` by a uniform draw. The draw itself gives even, ordered buckets."""
    group = list(group)
    base = df.withColumn("_bucket", F.floor(F.col(unit) * buckets))
    counts = base.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per_group = Window.partitionBy(*group)
    earlier = per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(per_group).alias("size"),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(unit, tie)
    return (
        base.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "_bucket"])
        .withColumn("pos", (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_rank", "_offset")
    )


def previous(
    df: DataFrame, group: Sequence[str], order: str, value: Column, name: str, rows: int = TASK_ROWS
) -> DataFrame:
    """Add the value of the preceding row of the group, without one task per group.

    Rows are windowed inside measured ranges; the first row of a range takes the last value of the nearest earlier
    range of its group from a table of one row per range.
    """
    group = list(group)
    base = in_ranges(df.withColumn("_value", value), group, [order], rows)
    inside = Window.partitionBy(*group, "_part").orderBy(order, "_uid")
    marked = base.withColumn("_inner", F.lag(F.struct("_value")).over(inside))
    edges = base.groupBy(*group, "_part").agg(F.max_by(F.struct("_value"), F.struct(order, "_uid")).alias("_last"))
    across = Window.partitionBy(*group).orderBy("_part")
    edges = edges.select(*group, "_part", F.lag("_last").over(across).alias("_edge"))
    found = F.when(F.col("_inner").isNotNull(), F.col("_inner._value")).otherwise(F.col("_edge._value"))
    return null_safe_join(marked, edges, [*group, "_part"]).withColumn(name, found).drop("_part", "_uid", "_value", "_inner", "_edge")


#: ids for each 64-bit word of a Bloom filter; each id sets two bits of one word, so one foreign id in 16 passes
IDS_PER_WORD = 8


def _bloom_place(key: str, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit("bloom"), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, n).bitwiseAND(63).cast("int")) for n in (58, 52)]
    return F.pmod(h, F.lit(words)), bits[0].bitwiseOR(bits[1])


def small_filter(df: DataFrame, key: str) -> tuple[DataFrame | None, int]:
    """Bloom filter of a written table's key as rows (word, bits), and its number of words; None if it is too large to broadcast."""
    words = max(1, -(-df.count() // IDS_PER_WORD))
    if words > BROADCAST_VALUES // 2:
        return None, words
    word, mask = _bloom_place(key, words)
    return df.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits")), words


def may_hold(df: DataFrame, key: str, bits: DataFrame, words: int) -> DataFrame:
    """Rows whose key the Bloom filter may hold: none that it holds is missing."""
    word, mask = _bloom_place(key, words)
    met = df.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return met.where(mask.bitwiseAND(F.col("_bits")) == mask).drop("_word", "_bits")
