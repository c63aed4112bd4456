"""Choosing the success threshold and difficulty from pilot runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialstats.functions.intervals import wilson
from trialstats.rules import Design, Rules

LEVEL = ("model_id", "level")


def rate_table(
    runs: DataFrame, taus: Sequence[float], rules: Rules = Rules(), by: Sequence[str] = LEVEL
) -> DataFrame:
    """Per candidate threshold: successes, scored runs, rate, limits and whether it is in band.

    All thresholds are counted in one pass; the table is unfolded after the aggregation.
    """
    counted = runs.groupBy(*by).agg(
        F.count("score").alias("n"),
        *[F.count_if(F.col("score") >= F.lit(round(t, 6))).alias(f"_k{i}") for i, t in enumerate(taus)],
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("tau_rank"), F.lit(float(t)).alias("tau"), F.col(f"_k{i}").alias("k"))
        for i, t in enumerate(taus)
    ])
    t = counted.select(*by, "n", F.inline(rows))
    lo, hi = wilson("k", "n", rules.alpha)
    p = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(float("nan")))
    band_lo, band_hi = rules.band
    return t.select(
        *by, "tau_rank", "tau", "k", "n", p.alias("p"), lo.alias("lo"), hi.alias("hi"),
        ((F.col("n") > 0) & p.between(band_lo, band_hi)).alias("in_band"),
    )


def level_summary(runs: DataFrame, rules: Rules = Rules(), by: Sequence[str] = LEVEL) -> DataFrame:
    """Runs, mean score, malformed-call rate and eligibility of each pilot."""
    rate = F.coalesce(F.try_divide(F.sum("malformed_calls"), F.sum("tool_calls")), F.lit(0.0))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        (F.sum(F.col("score").cast("decimal(18,12)")).cast("double") / F.count("score")).alias("mean_score"),
        rate.alias("malformed_call_rate"),
    ).withColumn("eligible", F.col("malformed_call_rate") <= rules.max_malformed_rate)


def rank_options(rates: DataFrame, levels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Threshold and difficulty options that every model was piloted at, best first.

    Ranked by replicates, threshold position, summed distance from the band's middle and level.
    """
    middle = sum(rules.band) / 2.0
    models = rates.agg(F.count_distinct("model_id").alias("m")).scalar()
    joined = rates.join(levels.select(*LEVEL, "eligible"), list(LEVEL))
    replicate = F.col("in_band") & F.col("eligible")
    options = joined.groupBy("tau_rank", "tau", "level").agg(
        F.count(F.lit(1)).alias("_models"), F.count_if(replicate).alias("replicates"),
        F.sum(F.abs(F.col("p") - middle).cast("decimal(18,12)")).cast("double").alias("distance"),
    ).where(F.col("_models") == models)
    # one row per threshold candidate and level: the option list does not grow with the data
    order = Window.orderBy(F.desc("replicates"), "tau_rank", "distance", "level")
    return options.withColumn("rank", F.row_number().over(order)).drop("_models")


def recommend(rates: DataFrame, levels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return rank_options(rates, levels, rules).where(F.col("rank") == 1)
