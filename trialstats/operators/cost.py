"""Cost of runs: prices, the spend ledger with its stop line, and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialstats.plans.scale import SPLITS, broadcast_if_small, null_safe_join, previous, running_before, split
from trialstats.session import cut

USAGE = ("input", "output", "cache_read", "cache_write")
STOP_AT = 0.95


def price_runs(runs: DataFrame, prices: DataFrame, places: int = 12) -> DataFrame:
    """Add ``cost_usd``: token counts times prices. A model without prices stops the job.

    The price table has one row per model. It is broadcast where a count proves it small; dealt by model, all runs of one would
    go to a single task.
    """
    p = broadcast_if_small(prices.select("model_id", *[F.col(u).alias(f"_p_{u}") for u in USAGE]))
    parts = [
        F.col(f"{u}_tokens") * F.col(f"_p_{u}").cast(f"decimal(18,{places})") for u in USAGE
    ]
    cost = sum(parts[1:], parts[0]).cast(f"decimal(38,{places})")
    no_price = F.raise_error(F.concat(F.lit("no prices for model "), F.col("model_id")))
    return (
        runs.join(p, "model_id", "left")
        .withColumn("cost_usd", F.when(F.col("_p_input").isNull(), no_price.cast(f"decimal(38,{places})"))
                    .otherwise(cost))
        .drop(*[f"_p_{u}" for u in USAGE])
    )


def unpriced(runs: DataFrame, prices: DataFrame) -> DataFrame:
    return runs.select("model_id").distinct().join(prices, "model_id", "left_anti")


def spend(priced: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Total spend; null where no run carries a cost."""
    return priced.groupBy(*by).agg(
        F.count("cost_usd").alias("priced_runs"), F.sum("cost_usd").cast("double").alias("spend_usd"))


def _judged(t: DataFrame, cap_usd: float) -> DataFrame:
    """Whether starting the next run would cross the stop line, from spend and runs before it."""
    spent = F.col("spent_before").cast("double")
    forecast = F.coalesce(F.try_divide(spent, F.col("runs_before")), F.lit(0.0))
    return t.withColumn("over", spent + forecast > F.lit(STOP_AT * cap_usd))


def ledger(priced: DataFrame, cap_usd: float, order: Sequence[str]) -> DataFrame:
    """Spend and mean cost before each run, and whether starting it would cross the stop line."""
    return _judged(running_before(
        priced, ["model_id"], order,
        {"spent_before": F.col("cost_usd"), "runs_before": F.lit(1)},
    ), cap_usd)


#: runs that are walked one by one; more are first narrowed to the ranges in which the line can be crossed
WALKED = 1_000_000


def _summed(ranged: DataFrame) -> DataFrame:
    """Runs and cost of every range, the cost above zero in it, and what lies before it."""
    sums = cut(ranged.groupBy("model_id", "_block", "_range").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("s"),
        F.coalesce(F.sum(F.when(F.col("cost_usd") > 0, F.col("cost_usd"))), F.lit(0)).alias("above"),
        F.min("_runs").alias("_runs"), F.min("_spent").alias("_spent")))
    earlier = Window.partitionBy("model_id", "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return sums.withColumns({"runs_before": F.col("_runs") + before("n"), "spent_before": F.col("_spent") + before("s")})


def _crossed(sums: DataFrame, cap_usd: float) -> DataFrame:
    """The ranges that may hold a model's first refused run; none that does is missing.

    No run of a range sees more than the spend before it and the costs above zero in it, or a mean over fewer runs than lie
    before it. A range whose first run is refused ends the search.
    """
    most = F.greatest(F.lit(0.0), (F.col("spent_before") + F.col("above")).cast("double"))
    bound = most * (1 + F.lit(1.0) / F.greatest(F.col("runs_before"), F.lit(1))) * (1 + 1e-9)
    place = F.struct("_block", "_range")
    end = F.min(F.when(F.col("over"), place)).over(Window.partitionBy("model_id"))
    marked = _judged(sums, cap_usd).withColumn("_end", end)
    return marked.where((bound >= F.lit(STOP_AT * cap_usd)) & F.coalesce(place <= F.col("_end"), F.lit(True))).select(
        "model_id", "_block", "_range", "n", F.col("runs_before").alias("_runs"), F.col("spent_before").alias("_spent"))


def spend_cutoff(priced: DataFrame, cap_usd: float, order: str, walked: int = WALKED) -> DataFrame:
    """Per model: runs that start before the first one the stop line would refuse.

    The runs are summed by ranges of the order where they lie; only ranges that may hold the first refused run are written and
    looked at closer, by finer ranges and in the end run by run. The first refused row already carries the count and the
    spend of everything before it.
    """
    zero = F.lit(0).cast("bigint")
    near = priced.select("model_id", order, "cost_usd", zero.alias("_block"), zero.alias("_runs"),
                         F.lit(0).cast(priced.schema["cost_usd"].dataType).alias("_spent"))
    left, totals, within = near.count(), None, ["model_id", "_block"]
    while True:
        ranged = split(near, within, order, left)
        sums = _summed(ranged)
        if totals is None:
            totals = sums.groupBy("model_id").agg(F.sum("n").alias("runs"), F.sum("s").alias("_all"))
        kept = cut(_crossed(sums, cap_usd))
        near = null_safe_join(ranged.drop("_runs", "_spent"), broadcast_if_small(kept.drop("n")), [*within, "_range"])
        near = cut(near.withColumn("_block", F.col("_block") * (2 * SPLITS) + F.col("_range")).drop("_range"))
        before, left = left, kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if left <= walked or left > before // 2:
            break
    t = running_before(near, within, [order], {"_s": F.col("cost_usd"), "_n": F.lit(1)}).withColumns({
        "spent_before": F.col("_spent") + F.col("_s"), "runs_before": F.col("_runs") + F.col("_n")})
    stop = F.min(F.when(F.col("over"), F.struct(order, "runs_before", "spent_before")))
    stops = _judged(t, cap_usd).groupBy("model_id").agg(stop.alias("_stop"))
    return null_safe_join(totals, stops, ["model_id"], "left").select(
        "model_id", F.col(f"_stop.{order}").alias("stopped_at"), "runs",
        F.coalesce("_stop.runs_before", "runs").alias("started"),
        F.coalesce("_stop.spent_before", "_all").cast("double").alias("spent_usd"),
    )


def transport_streaks(
    runs: DataFrame, order: str, g: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Transport aborts, marked when the run before them aborted the same way (the stack was down)."""
    down = (F.col("outcome") == "aborted_transport") & (
        F.coalesce(F.col("abort_cause"), F.lit("unrecorded")) != "unparseable_model_output")
    t = previous(runs.withColumn("_down", down), g, order, F.col("_down"), "after_abort")
    return t.where("_down").withColumn(
        "after_abort", F.coalesce("after_abort", F.lit(False))).drop("_down")


def token_means(runs: DataFrame, g: Sequence[str] = ("model_id",)) -> DataFrame:
    """Mean tokens and turns per probe point and overall (null cell), aborted runs left out."""
    keys = [*g, "tools", "fault_pct"]
    usable = runs.where(F.col("outcome") != "aborted_transport")
    return (
        usable.groupingSets(
            [[F.col(c) for c in keys], [F.col(c) for c in g]], *[F.col(c) for c in keys])
        .agg(
            F.count(F.lit(1)).alias("runs"),
            *[(F.sum(f"{u}_tokens") / F.count(F.lit(1))).alias(f"mean_{u}_tokens") for u in USAGE],
            (F.sum("turns") / F.count(F.lit(1))).alias("mean_turns"),
        )
    )


def forecast(means: DataFrame, prices: DataFrame, counts: DataFrame, cap_usd: float) -> DataFrame:
    """Cost per phase in cents, the total, and whether it stays within the stop line."""
    overall = means.where(F.col("tools").isNull())
    per_run = sum(
        (F.col(f"mean_{u}_tokens") * F.col(u) for u in USAGE[1:]),
        F.col("mean_input_tokens") * F.col("input"),
    )
    rate = overall.join(prices, "model_id").select("model_id", per_run.alias("_rate"))
    phases = counts.join(rate, "model_id").select(
        "model_id", "phase", F.col("runs"), F.round(F.col("runs") * F.col("_rate"), 2).alias("usd"))
    total = phases.groupBy("model_id").agg(
        F.round(F.sum("usd"), 2).alias("total_usd"))
    return phases.join(total, "model_id").withColumn(
        "within_cap", F.col("total_usd") <= F.lit(STOP_AT * cap_usd))
