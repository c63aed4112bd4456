"""Noise floor: how much identical runs differ when only the stack or the seed changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions.intervals import wilson
from trialstats.rules import Rules

CELL = ("model_id", "protocol", "mix", "tools", "fault_pct")


def missing_runs(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Planned floor runs without a recorded row."""
    return plan.join(runs.select("run_id"), "run_id", "left_anti")


def require_complete(plan: DataFrame, runs: DataFrame) -> None:
    n = missing_runs(plan, runs).count()
    if n:
        raise ValueError(f"{n} planned floor runs are not recorded; resume the floor first")


def flips(rows: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Per planned position: whether the graded outcomes of its reruns are not all equal."""
    hit = F.col("success").cast("int")
    return rows.groupBy(*cell, "index").agg(
        (F.coalesce(F.min(hit) != F.max(hit), F.lit(False))).alias("flipped"))


def rerun_rates(rows: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Success rate of each rerun over its graded runs; a rerun without any stops the job."""
    n = F.count("success")
    refuse = F.raise_error(F.lit("a rerun has no graded run, no rate to report")).cast("double")
    return rows.groupBy(*cell, "rerun").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(F.col("success").isNull()).alias("aborted"),
        F.when(n > 0, F.count_if("success") / n).otherwise(refuse).alias("rate"),
    )


def identity(rows: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Share of later reruns whose transcripts equal the first rerun's at every position.

    Positions are compared one by one against the first rerun (unique per position), so no rerun's
    list of hashes is ever collected.
    """
    first = rows.where(F.col("rerun") == 0).select(
        *cell, "index", F.col("transcript_hash").alias("_first"))
    later = rows.where(F.col("rerun") > 0).join(first, [*cell, "index"], "left")
    per_rerun = later.groupBy(*cell, "rerun").agg(
        F.bool_and(F.coalesce(F.col("transcript_hash") == F.col("_first"), F.lit(False))).alias("_same"))
    return per_rerun.groupBy(*cell).agg(
        F.avg(F.col("_same").cast("int")).alias("identity_rate"))


def noise_floor(
    rows: DataFrame, rules: Rules = Rules(), cell: Sequence[str] = CELL, hashes: bool = True
) -> DataFrame:
    """All floor statistics per protocol and cell from rows (protocol, cell, rerun, index, success
    and, where hashes are compared, transcript_hash).

    The fixed protocol reports identity, the varied one phi, a hosted block both.
    """
    rates = rerun_rates(rows, cell)
    r = rates.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("reruns"), F.sum("aborted").alias("aborted"),
        F.max(F.when(F.col("rerun") == 0, F.col("planned"))).alias("n_per_rerun"),
        F.avg("rate").alias("mean_rate"), F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("jitter_sd"),
    )
    f = flips(rows, cell).groupBy(*cell).agg(F.count_if("flipped").alias("flipped"))
    t = r.join(f, list(cell))
    lo, hi = wilson("flipped", "n_per_rerun", rules.alpha)
    sd = F.sqrt(F.col("mean_rate") * (1.0 - F.col("mean_rate")) / F.col("n_per_rerun"))
    with_phi = F.col("protocol") != "fixed_seed"
    if hashes:
        t = t.join(identity(rows, cell), list(cell), "left").withColumn(
            "identity_rate", F.when(F.col("protocol") != "varied_seed",
                                    F.coalesce("identity_rate", F.lit(1.0))))
    out = t.withColumns({
        "flip_rate": F.col("flipped") / F.col("n_per_rerun"), "flip_lo": lo, "flip_hi": hi,
        "binomial_sd": F.when(with_phi, sd),
    })
    return out.withColumn("phi", F.when(F.col("binomial_sd") > 0, F.col("jitter_sd") / F.col("binomial_sd")))
