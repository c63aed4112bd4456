"""Trial tables derived by Spark from a star schema, used where no run log is at hand.

Every row of the fact table becomes one trial; nothing is filtered out.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.functions import draws
from trialstats.functions.intervals import sigmoid
from trialstats.rules import ABORTED, UNPARSEABLE, Design
from trialstats.session import checkpoint_dir, parallelism

CALLS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: rows of an input that one task takes
SPREAD_ROWS = 250_000


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share, of ``SPREAD_ROWS`` rows at most, when the input has fewer splits than that takes.

    The rows are counted from the file's footers, so a task's share does not grow with the input.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


_WRITTEN: dict[tuple[str, str], str] = {}


def trials_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the derived trial table, written once per session like an ingested run log."""
    key = (spark.sparkContext.applicationId, os.path.normpath(sf_dir))
    if key not in _WRITTEN:
        path = f"{checkpoint_dir(spark).rstrip('/')}/trials-{uuid.uuid4().hex}"
        rows = derive_trials(spark, sf_dir).drop("u", "u_abort")
        rows.write.partitionBy("model_id", "mix").parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written trial table, partitioned by model and mix.

    Every query gets column pruning, pushed filters and partition pruning from it instead of hashing
    all draws again.
    """
    return spark.read.parquet(trials_path(spark, sf_dir))


def derive_trials(spark: SparkSession, sf_dir: str, design: Design = Design()) -> DataFrame:
    """Analysis-ready trial rows (one per line item) with a known outcome surface."""
    li = spread(table(spark, sf_dir, "lineitem"))
    ident = [draws.number(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    ident += [
        draws.number(F.col("l_quantity").cast("int")),
        draws.number(F.unix_date(F.col("l_shipdate").cast("date"))),
    ]
    base = li.select(
        draws.digest("run", *ident).alias("run_id"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string")).alias("model_id"),
        F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("mix"),
        F.lit("sweep").alias("phase"),
        ((F.col("l_linenumber") - 1) % 6 + 1).cast("int").alias("tools"),
        (F.least(F.floor(F.round(F.col("l_discount") * 100) / 2), F.lit(5)) * 10)
        .cast("int").alias("fault_pct"),
        F.col("l_suppkey").cast("string").alias("doc_id"),
        (F.col("l_quantity").cast("int") % 4).alias("epoch"),
        draws.unit("trial", *ident).alias("u"),
        draws.unit("abort", *ident).alias("u_abort"),
        F.col("l_quantity").cast("int").alias("tool_calls"),
        (F.col("l_quantity").cast("int") % 3 == 0).cast("int").alias("malformed_calls"),
        (F.col("l_partkey") % 4).cast("int").alias("_quality"),
        "l_tax",
        F.col("l_orderkey").alias("_order"),
        F.col("l_shipdate").cast("date").alias("request_date"),
    )
    call_key = (
        design.root_seed, draws.token("model_id"), draws.token("mix"), draws.token("doc_id"),
        draws.number("epoch"),
    )
    rate = F.col("fault_pct") / F.lit(100.0)
    # the calls of a row are one array: a column for each would make a method too long for the JIT
    hit = lambda i: draws.unit("fault", *call_key, draws.number(i)) < rate
    base = base.withColumn("_hits", F.transform(F.lit(list(range(CALLS))), hit))
    # one kind draw per row: that of the first call that was hit
    base = base.withColumn("_first", F.nullif(F.array_position("_hits", True), F.lit(0)) - 1).withColumn(
        "_kind_u", draws.unit("kind", *call_key, draws.number("_first")))
    first_kind = draws.choice_weighted(F.col("_kind_u"), design.fault_kinds, design.fault_weights)
    first_kind = F.when(F.col("_first").isNotNull(), first_kind)
    tc = F.col("tools") - F.lit(4.0)
    eta = (
        F.lit(1.6) - F.lit(0.6) * tc - F.lit(0.6) * tc * tc
        - F.lit(3.0) * F.col("fault_pct") / F.lit(100.0)
    )
    solved = (F.col("tools") >= 2) & (F.col("u") < sigmoid(eta))
    graded = F.col("u_abort") >= 0.01
    n_faults = F.size(F.filter("_hits", lambda h: h))
    good = F.when(F.col("_quality") == 0, 0.8).when(F.col("_quality") == 1, 0.9).otherwise(1.0)
    score = F.when(solved, good).otherwise(F.round(F.col("l_tax") * 9, 2))
    return (
        base.withColumn("n_faults", n_faults)
        .withColumn("first_fault_kind", first_kind)
        .withColumn("score", F.when(graded, score))
        .withColumn("success", F.when(graded, F.col("score") >= 0.8))
        .withColumn(
            "outcome",
            F.when(~graded, ABORTED).when(F.col("score") >= 0.3, "submitted")
            .otherwise("no_submission"),
        )
        .withColumn("recovered", F.when(F.col("n_faults") > 0, F.col("outcome") == "submitted"))
        .withColumn(
            "abort_cause",
            F.when(graded, None).when(F.col("u_abort") < 0.001, "unrecorded")
            .when(F.col("u_abort") < 0.004, UNPARSEABLE).otherwise("transport"),
        )
        .withColumn("total_correct", F.when(graded, F.col("success") & (F.col("_quality") != 0)))
        .withColumn("turns", F.lit(3) + F.col("tool_calls") % 7 + F.col("n_faults"))
        .withColumn("seconds", (F.col("turns") + F.col("l_tax")).cast("decimal(18,6)"))
        .withColumn("input_tokens", F.col("_order") % 1000 + 200)
        .withColumn("output_tokens", F.col("_order") % 300 + 20)
        .withColumn("cache_read_tokens", F.col("_order") % 4000)
        .withColumn("cache_write_tokens", F.col("_order") % 800)
        .drop("_quality", "l_tax", "_order", "_first", "_kind_u", "_hits")
    )
