"""A table of run rows that grows by committed batches: every id once, a crash between write and commit leaves it as it was.

Layout: ``batch=<name>/model_id=/phase=/mix=`` holds a batch, ``_commits`` a file per commit. A batch is staged first, without
effect on readers; the commit is one file that the file system's rename makes visible. A batch named like a committed
one is left out, so a replayed append adds nothing; a staged one without commit is written anew. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trialstats.plans.scale import may_hold, small_filter
from trialstats.schema import RUN_FIELDS, RUNS
from trialstats.session import cut

#: an id fixes these: it is a digest of the run's place in the plan
PARTS = ("model_id", "phase", "mix")
#: partitions named one by one in a filter; a batch over more of them reads the whole table's ids
NAMED = 1000


def committed(spark: SparkSession, path: str) -> DataFrame:
    """batch and rows of every commit."""
    schema = "batch string, rows bigint"
    try:
        return spark.read.schema(schema).json(f"{path}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the committed batches, with their ``batch``. The list of commits is one short row per append."""
    names = committed(spark, path).select("batch")
    schema = f"{RUNS}, batch string"
    if names.isEmpty():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).join(F.broadcast(names), "batch", "left_semi")


def staged_only(spark: SparkSession, path: str) -> DataFrame:
    """Batches that were written and never committed."""
    rows = spark.read.schema(f"{RUNS}, batch string").parquet(path).select("batch").distinct()
    return rows.join(committed(spark, path), "batch", "left_anti")


def one_per_id(runs: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Run rows, one per id: the least by ``order`` (over the columns of ``runs``), then by its JSON text, so that the choice
    never depends on the partitions.

    Equal ids meet by partial aggregation; a row without an id stops the job.
    """
    held = F.when(F.col("run_id").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a row has no run id")).cast("boolean"))
    extra = [c.alias(f"_order{k}") for k, c in enumerate(order)]
    names = [n for n, _ in RUN_FIELDS]
    rows = runs.where(held).select(*[F.col(n).cast(t).alias(n) for n, t in RUN_FIELDS], *extra)
    by = F.struct(*(f"_order{k}" for k in range(len(extra))), F.to_json(F.struct(*names)))
    least = rows.groupBy("run_id").agg(F.min_by(F.struct(*names), by).alias("_r"))
    return least.select("_r.*")


def _touched(batch: DataFrame) -> Column:
    """Filter on the partitions that a batch falls into."""
    found = batch.select(*PARTS).distinct().limit(NAMED + 1).collect()
    if len(found) > NAMED:
        return F.lit(True)
    each = [reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(r[c]).cast("string")) for c in PARTS)) for r in found]
    return reduce(Column.__or__, each, F.lit(False))


def unknown(batch: DataFrame, path: str) -> DataFrame:
    """Rows of a written batch whose id the table does not hold.

    Only ids of the batch's partitions are read, and only those that pass a Bloom filter of the batch's ids meet it.
    """
    spark = batch.sparkSession
    known = read_table(spark, path).where(_touched(batch)).select("run_id")
    words, size = small_filter(batch, "run_id")
    if words is not None:
        known = may_hold(known, "run_id", words, size)
    return batch.join(known, "run_id", "left_anti")


def stage(runs: DataFrame, path: str, name: str, order: Sequence[Column] = ()) -> int:
    """Write the rows that the table lacks as a batch without effect yet; returns their number."""
    batch = cut(one_per_id(runs, order))
    seen = Observation()
    fresh = unknown(batch, path).select(*batch.columns).observe(seen, F.count(F.lit(1)).alias("rows"))
    fresh.write.mode("overwrite").partitionBy(*PARTS).parquet(f"{path}/batch={name}")
    return seen.get["rows"]


def commit(spark: SparkSession, path: str, name: str, rows: int) -> None:
    """Make a staged batch part of the table."""
    one = spark.createDataFrame([(name, rows)], "batch string, rows bigint")
    one.coalesce(1).write.mode("append").json(f"{path}/_commits")


def append_runs(runs: DataFrame, path: str, name: str | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Append rows whose id the table does not hold yet; returns the table.

    The first committed row of an id wins; inside one append the least by ``order`` and JSON text does. With a ``name``
    the append is done once however often it is called.
    """
    spark = runs.sparkSession
    name = name or uuid.uuid4().hex
    if committed(spark, path).where(F.col("batch") == name).isEmpty():
        commit(spark, path, name, stage(runs, path, name, order))
    return read_table(spark, path).drop("batch")
