"""Plan fragments against plain formulations, with one key holding a third of all rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialstats.plans import scale as SC


def skewed(spark, n=3000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        F.format_string("%06d", (F.col("id") * 7919) % n).alias("o"),
        (F.col("id") % 11).cast("decimal(10,2)").alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hot_key_join_equals_join(spark):
    facts = skewed(spark)
    lookup = facts.select("k").distinct().withColumn("name", F.upper("k"))
    want = rows(facts.join(lookup, "k").select("k", "o", "name"))
    got = SC.hot_key_join(facts, lookup, ["k"], "o", limit=50)
    assert rows(got.select("k", "o", "name")) == want


@pytest.mark.parametrize("size", [7, 10**6])
def test_running_before_equals_window(spark, size):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = rows(df.select("k", "o", F.coalesce(F.sum("v").over(w), F.lit(0)).cast("double")))
    got = SC.running_before(df, ["k"], ["o"], {"s": F.col("v")}, size)
    assert rows(got.select("k", "o", F.col("s").cast("double"))) == want


@pytest.mark.parametrize("size", [7, 10**6])
def test_previous_equals_lag(spark, size):
    df = skewed(spark)
    want = rows(df.select("k", "o", F.coalesce(F.lag("v").over(Window.partitionBy("k").orderBy("o")), F.lit(-1)).cast("double")))
    got = SC.previous(df, ["k"], "o", F.col("v"), "p", size)
    assert rows(got.select("k", "o", F.coalesce("p", F.lit(-1)).cast("double"))) == want


def test_ranges_are_bounded_by_rows_even_where_order_and_group_are_equal(spark):
    same = spark.range(6000).select(F.lit(None).cast("string").alias("k"), F.lit("x").alias("o"), F.lit(2).alias("v"))
    sizes = [r["count"] for r in SC.in_ranges(same, ["k"], ["o"], 500).groupBy("_part").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1500
    sums = sorted(r.s for r in SC.running_before(same, ["k"], ["o"], {"s": F.col("v")}, 500).collect())
    assert sums == list(range(0, 12000, 2))
    assert SC.previous(same, ["k"], "o", F.col("v"), "p", 500).where("p is null").count() == 1


def test_positions_equal_row_number(spark):
    df = skewed(spark).select("k", "o").distinct()
    w = Window.partitionBy("k")
    want = rows(df.select("k", "o", F.row_number().over(w.orderBy("o")) - 1, F.count("*").over(w)))
    assert rows(SC.positions(df, ["k"], "o").select("k", "o", "pos", "size")) == want


def test_hashed_order_is_a_permutation(spark):
    df = skewed(spark).withColumn("u", F.rand(3))
    df = df.withColumn("u", (F.abs(F.xxhash64("o")) % 100000) / 100000.0)
    got = SC.hashed_order(df, ["k"], "u", "o").orderBy("k", "pos").collect()
    for a, b in zip(got, got[1:]):
        if a.k == b.k:
            assert b.pos == a.pos + 1 and (a.u, a.o) <= (b.u, b.o)


def test_broadcast_only_when_small(spark):
    big, small = spark.range(1000), spark.range(10)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(SC.broadcast_if_small(small, 100)) and not hinted(SC.broadcast_if_small(big, 100))


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path, monkeypatch):
    from trialstats.sources import adapters

    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(adapters, "SPREAD_ROWS", 100)
    dealt = adapters.spread(adapters.table(spark, str(tmp_path), "t"))
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) <= 150
