"""Cell-level rates and the descriptive tables built on them.

Every function groups by ``g`` (by default model and mix), so one job covers all groups. Rates come
from integer counts, which makes them independent of row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialstats.functions.intervals import newcombe, wilson
from trialstats.rules import ABORTED, UNPARSEABLE, Rules

G = ("model_id", "mix")
CELL = ("tools", "fault_pct")


def exact_mean(value, n, places: int = 12):
    """Mean through a decimal sum: the same digits for any order of the rows."""
    return F.sum(value.cast(f"decimal(18,{places})")).cast("double") / n


def sweep_rows(runs: DataFrame) -> DataFrame:
    return runs.where(F.coalesce(F.col("phase"), F.lit("sweep")) == "sweep")


def cell_table(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """n, k, rate, Wilson limits, mean score and faults per run of every cell with graded runs."""
    graded = F.col("success").isNotNull()
    n = F.count("success")
    scored = F.count(F.when(graded, F.col("score")))
    agg = (
        sweep_rows(runs)
        .groupBy(*g, *CELL)
        .agg(
            n.alias("n"),
            F.coalesce(F.sum(F.col("success").cast("int")), F.lit(0)).alias("k"),
            exact_mean(F.when(graded, F.col("score")), scored).alias("mean_score"),
            (F.sum(F.when(graded, F.col("n_faults"))) / n).alias("faults_per_run"),
        )
        .where(F.col("n") > 0)
    )
    return rated(agg, g, rules, "mean_score", "faults_per_run")


def rated(counts: DataFrame, g: Sequence[str] = G, rules: Rules = Rules(), *more: str) -> DataFrame:
    """Rate, Wilson limits and scope of cells with counts ``n`` and ``k``."""
    lo, hi = wilson("k", "n", rules.alpha)
    return counts.select(
        *g, *CELL, "n", "k", (F.col("k") / F.col("n")).alias("p"), lo.alias("lo"), hi.alias("hi"),
        (F.col("tools") >= 2).alias("in_scope"), *more,
    )


def malformed_rates(runs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Malformed tool calls over all tool calls per cell; 0 where no call was made."""
    graded = F.col("success").isNotNull()
    calls = F.sum(F.when(graded, F.coalesce(F.col("tool_calls"), F.lit(0))))
    bad = F.sum(F.when(graded, F.coalesce(F.col("malformed_calls"), F.lit(0))))
    return (
        sweep_rows(runs).groupBy(*g, *CELL)
        .agg(bad.alias("malformed"), calls.alias("calls"))
        .where(F.col("calls").isNotNull())
        .withColumn("rate", F.coalesce(F.try_divide("malformed", "calls"), F.lit(0.0)))
    )


def success_meaning(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Four readings of success per cell with at least two tools, each with Wilson limits."""
    graded = F.col("success").isNotNull()
    readings = {
        "registered": F.col("success"),
        "score_09": graded & (F.coalesce(F.col("score"), F.lit(0.0)) >= 0.9),
        "total_correct": graded & F.coalesce(F.col("total_correct"), F.lit(False)),
        "fully_correct": graded & (F.col("score") == 1.0),
    }
    agg = (
        sweep_rows(runs).where(F.col("tools") >= 2).groupBy(*g, *CELL)
        .agg(
            F.count("success").alias("n"),
            *[F.count_if(c).alias(f"{name}_k") for name, c in readings.items()],
        )
        .where(F.col("n") > 0)
    )
    out = [*g, *CELL, "n"]
    for name in readings:
        lo, hi = wilson(f"{name}_k", "n", rules.alpha)
        out += [
            F.col(f"{name}_k"), (F.col(f"{name}_k") / F.col("n")).alias(f"{name}_p"),
            lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi"),
        ]
    return agg.select(*out)


def never_recovered(runs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Share of graded faulted runs that ended without a submission; cells without faults drop."""
    faulted = F.col("success").isNotNull() & (F.col("n_faults") > 0)
    return (
        sweep_rows(runs).where(F.col("tools") >= 2).groupBy(*g, *CELL)
        .agg(
            F.count_if(faulted).alias("faulted"),
            F.count_if(faulted & (F.col("outcome") != "submitted")).alias("never"),
        )
        .where(F.col("faulted") > 0)
        .withColumn("share", F.col("never") / F.col("faulted"))
    )


def abort_causes(runs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Aborted runs per cell and cause (long form; ``abort_cause_map`` nests it)."""
    return (
        sweep_rows(runs).where((F.col("tools") >= 2) & (F.col("outcome") == ABORTED))
        .groupBy(*g, *CELL, F.coalesce(F.col("abort_cause"), F.lit("unrecorded")).alias("cause"))
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def abort_cause_map(causes: DataFrame, g: Sequence[str] = G) -> DataFrame:
    return causes.groupBy(*g, *CELL).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("cause", "runs")))).alias("causes")
    )


def unparseable_as_failure(runs: DataFrame) -> DataFrame:
    """Runs aborted on unparseable model output become graded failures with score 0.

    They keep their recorded outcome, as in the registered reading.
    """
    turned = (F.col("outcome") == ABORTED) & (F.col("abort_cause") == UNPARSEABLE)
    turned = F.coalesce(turned, F.lit(False))
    return runs.withColumns(
        {
            "success": F.when(turned, F.lit(False)).otherwise(F.col("success")),
            "score": F.when(turned, F.lit(0.0)).otherwise(F.col("score")),
            "turned": turned,
        }
    )


def success_at(tau: float, offset: float) -> Column:
    """Success read at another threshold; rows without success or score stay as they are."""
    keep = F.col("success").isNull() | F.col("score").isNull()
    return F.when(keep, F.col("success")).otherwise(F.col("score") >= F.lit(round(tau + offset, 6)))


def tool_effects(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Rate at k tools minus rate at k-1, per fault row and pooled (``fault_pct`` null)."""
    counts = (
        sweep_rows(runs).where(F.col("tools") >= 2)
        .groupBy(*g, *CELL)
        .agg(F.count("success").alias("n"), F.sum(F.col("success").cast("int")).alias("k"))
        .where(F.col("n") > 0)
    )
    return step_effects(counts, rules, g)


def step_effects(counts: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    rolled = (
        counts.groupingSets(
            [[F.col(c) for c in (*g, "tools", "fault_pct")], [F.col(c) for c in (*g, "tools")]],
            *[F.col(c) for c in (*g, "tools", "fault_pct")],
        )
        .agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.grouping("fault_pct").alias("_pooled"))
    )
    line = Window.partitionBy(*g, "_pooled", "fault_pct").orderBy("tools")
    before = F.lag(F.struct("tools", "k", "n")).over(line)
    lo, hi = newcombe("k", "n", "_b.k", "_b.n", rules.alpha)
    return (
        rolled.withColumn("_b", before)
        .where(F.col("_b.tools") == F.col("tools") - 1)
        .select(
            *g, "fault_pct", F.col("_b.tools").alias("from_tools"),
            F.col("tools").alias("to_tools"),
            (F.col("k") / F.col("n") - F.col("_b.k") / F.col("_b.n")).alias("diff"),
            lo.alias("lo"), hi.alias("hi"),
        )
    )


def boundary_width(cells: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Rungs between the first in-scope cell below 90 % and the first below 10 % per fault row.

    The width is claimed when every adjacent difference on the way excludes zero.
    """
    row = [*g, "fault_pct"]
    line = Window.partitionBy(*row).orderBy("tools")
    lo, hi = newcombe("k", "n", "_next.k", "_next.n", rules.alpha)
    ranked = (
        cells.where(F.col("in_scope") & (F.col("n") > 0))
        .withColumn("_i", F.row_number().over(line) - 1)
        .withColumn("_next", F.lead(F.struct("k", "n")).over(line))
        .withColumn("_clear", F.coalesce((lo > 0) | (hi < 0), F.lit(False)))
    )
    point = F.struct("_i", "tools")
    found = ranked.groupBy(*row).agg(
        F.min(F.when(F.col("p") < 0.9, point)).alias("_a"),
        F.min(F.when(F.col("p") < 0.1, point)).alias("_b"),
        F.collect_list(F.struct("_i", "_clear")).alias("_steps"),  # one entry per tool count
    )
    on_way = F.filter(
        "_steps",
        lambda s: (s["_i"] >= F.greatest(F.col("_a._i") - 1, F.lit(0))) & (s["_i"] < F.col("_b._i")),
    )
    claimed = (F.size(on_way) > 0) & F.forall(on_way, lambda s: s["_clear"])
    return found.select(
        *row,
        F.col("_a.tools").alias("first_below_90"),
        F.col("_b.tools").alias("first_below_10"),
        (F.col("_b.tools") - F.col("_a.tools")).alias("width"),
        F.when(F.col("_b").isNull(), F.lit(False)).otherwise(claimed).alias("claimed"),
    )


def viable_fraction(cells: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Share of in-scope cells above one half by the rate and by its lower limit."""
    scope = F.col("in_scope")
    n = F.count_if(scope)
    share = lambda c: F.when(n > 0, F.count_if(scope & (F.col(c) > 0.5)) / n).otherwise(0.0)
    return cells.groupBy(*g).agg(
        share("p").alias("point"), share("lo").alias("lower_bound"), n.alias("n_cells")
    )


def instrument_check(
    groups: DataFrame, cells: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G
) -> DataFrame:
    """Anchor rate against the calibration band, widened by the anchor's half interval."""
    lo_b, hi_b = rules.band
    anchor = cells.where(
        (F.col("tools") == rules.anchor_tools) & (F.col("fault_pct") == rules.anchor_fault_pct)
    ).select(
        *g, F.col("p").alias("anchor_p"), F.col("lo").alias("anchor_lo"),
        F.col("hi").alias("anchor_hi"),
    )
    half = (F.col("anchor_hi") - F.col("anchor_lo")) / 2.0
    inside = F.col("anchor_p").between(F.lit(lo_b) - half, F.lit(hi_b) + half)
    return groups.join(anchor, list(g), "left").select(
        *g, "anchor_p", "anchor_lo", "anchor_hi",
        F.coalesce(inside, F.lit(False)).alias("ok"),
        F.when(F.col("anchor_p").isNull(), "anchor_missing").when(inside, "in_calibration")
        .otherwise("instrument_out_of_calibration").alias("label"),
    )


def nearest_below(cells: DataFrame, target: float, tools: int, fault_pct: int,
                  g: Sequence[str] = G) -> DataFrame:
    """Distance from one cell to the nearest cell, along each axis and direction, whose Wilson
    lower limit is under ``target``. No row where the grid holds none."""
    along = [("tools", "fault_pct", tools, fault_pct), ("fault_pct", "tools", fault_pct, tools)]
    steps = F.array(*[
        F.struct(
            F.lit(axis).alias("axis"), (F.col(axis) - at).alias("delta"),
            (F.col(other) == fixed).alias("on"),
        )
        for axis, other, at, fixed in along
    ])
    low = cells.where(F.col("in_scope") & (F.col("lo") < target)).select(
        *g, F.inline(F.filter(steps, lambda s: s["on"] & (s["delta"] != 0)))
    )
    return low.groupBy(*g, "axis", F.signum("delta").cast("int").alias("direction")).agg(
        F.min(F.abs("delta")).alias("distance")
    )


def run_counts(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Log counters per group: rows, aborts, rung-1 rows, in-scope rows and documents."""
    scope = p1_scope(rules)
    return sweep_rows(runs).groupBy(*g).agg(
        F.count(F.lit(1)).alias("runs_analyzed"),
        F.count_if(F.col("success").isNull()).alias("aborted_transport"),
        F.count_if(F.col("tools") == 1).alias("rung1"),
        F.count_if(scope).alias("in_scope_p1"),
        F.count_distinct(F.when(scope, F.col("doc_id"))).alias("documents_p1"),
        F.sum("malformed_calls").alias("malformed_calls"),
        F.coalesce(F.max("request_date").cast("string"), F.lit("undated")).alias("last_date"),
        F.min("request_date").cast("string").alias("first_date"),
    )


def outcome_counts(runs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    return runs.groupBy(*g, "outcome").agg(F.count(F.lit(1)).alias("runs"))


def p1_scope(rules: Rules, success: Column | None = None):
    """In-scope tool counts of rows graded (in a reading, by its ``success``) whose outcome is not excluded."""
    return (
        F.col("tools").isin(*rules.scope_tools)
        & (F.col("success") if success is None else success).isNotNull()
        & ~F.coalesce(F.col("outcome"), F.lit("")).isin(*rules.excluded_outcomes)
    )
