"""Paired recovery analysis: faulted, recovered runs against their fault-free controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.operators.boot import placed_documents, ratio_bootstrap
from trialstats.operators.cells import G, sweep_rows
from trialstats.plans.scale import hot_key_join
from trialstats.rules import Rules
from trialstats.session import cut

KEY = ("tools", "doc_id", "epoch")

SURVIVORSHIP_NOTE = (
    "The mean extra turns are measured on faulted runs that recovered. A fault that ends a run "
    "without a submission has no pair; the cell success rates carry that half."
)


def controls(runs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """One fault-free graded run per key: the one with the largest run id."""
    latest = F.max(F.struct("run_id", "turns", "seconds")).alias("c")
    return (
        sweep_rows(runs).where((F.col("fault_pct") == 0) & F.col("success").isNotNull())
        .groupBy(*g, *KEY).agg(latest)
        .select(*g, *KEY, F.col("c.run_id").alias("control_id"),
                F.col("c.turns").alias("control_turns"), F.col("c.seconds").alias("control_seconds"))
    )


def recovered_runs(runs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return sweep_rows(runs).where(
        F.col("tools").isin(*rules.scope_tools) & (F.col("n_faults") > 0) & F.col("recovered")
    )


def control_pairs(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Row-level pairs. A document with very many runs is split over salted tasks."""
    faulted = recovered_runs(runs, rules).select(
        *g, *KEY, "run_id", "fault_pct", "first_fault_kind", "n_faults", "turns", "seconds"
    )
    paired = hot_key_join(faulted, controls(runs, g), [*g, *KEY], "run_id")
    return paired.select(
        *g, *KEY, "run_id", "control_id", "fault_pct", "first_fault_kind", "n_faults",
        (F.col("turns") - F.col("control_turns")).alias("extra_turns"),
        (F.col("seconds") - F.col("control_seconds")).alias("extra_seconds"),
    )


def pair_sums(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Pairs summed per key, fault row and first fault kind before they meet their control.

    Since a key has one control, sums of differences follow from sums of the faulted side: hot
    documents shrink on the map side and both join inputs are unique per key.
    """
    faulted = (
        recovered_runs(runs, rules)
        .groupBy(*g, *KEY, "fault_pct", "first_fault_kind")
        .agg(
            F.count(F.lit(1)).alias("recovered"),
            F.sum("turns").alias("_turns"),
            F.sum("n_faults").alias("faults"),
            F.sum("seconds").alias("_seconds"),
        )
    )
    joined = faulted.join(controls(runs, g), [*g, *KEY], "left")
    paired = F.col("control_id").isNotNull()
    n = F.when(paired, F.col("recovered")).otherwise(F.lit(0))
    extra, faults = F.col("_turns") - n * F.col("control_turns"), F.when(paired, F.col("faults"))
    return joined.select(
        *g, "doc_id", "tools", "fault_pct", "first_fault_kind", "recovered", n.alias("pairs"),
        extra.alias("extra_turns"), faults.alias("faults"), (extra - faults).alias("net_turns"),
        (F.col("_seconds") - n * F.col("control_seconds")).alias("extra_seconds"),
    )


def document_sums(pairs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Per document with at least one pair: pair count, extra turns and extra turns net of faults."""
    return (
        pairs.where(F.col("pairs") > 0).groupBy(*g, "doc_id")
        .agg(
            F.sum("pairs").alias("pairs"),
            F.sum("extra_turns").alias("extra"),
            F.sum("net_turns").alias("net"),
        )
    )


def folded_pairs(pairs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Pair sums with one row per document for what has a control and one for what has none.

    Means and intervals are sums over these columns, so they come out as from ``pairs``.
    """
    sums = ("pairs", "extra_turns", "faults", "net_turns", "extra_seconds")
    folded = pairs.groupBy(*g, "doc_id", (F.col("pairs") > 0).alias("_paired")).agg(*[F.sum(c).alias(c) for c in sums])
    return folded.drop("_paired")


def breakdowns(pairs: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Mean extra turns by the kind of the first fault and by fault row, in one pass."""
    by = [*g, "first_fault_kind", "fault_pct"]
    return (
        pairs.where(F.col("pairs") > 0)
        .groupingSets(
            [[F.col(c) for c in (*g, "first_fault_kind")], [F.col(c) for c in (*g, "fault_pct")]],
            *[F.col(c) for c in by],
        )
        .agg(F.sum("pairs").alias("pairs"), F.sum("extra_turns").alias("extra_turns"),
             F.grouping("fault_pct").alias("_by_kind"))
        .select(
            *g,
            F.when(F.col("_by_kind") == 1, "kind").otherwise("row").alias("axis"),
            F.when(F.col("_by_kind") == 1, F.col("first_fault_kind"))
            .otherwise(F.col("fault_pct").cast("string")).alias("level"),
            "pairs",
            (F.col("extra_turns") / F.col("pairs")).alias("mean_extra_turns"),
        )
    )


def population_counts(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Graded faulted in-scope runs and how many of them recovered."""
    faulted = (
        F.col("tools").isin(*rules.scope_tools) & F.col("success").isNotNull()
        & (F.col("n_faults") > 0)
    )
    hit = faulted & F.coalesce(F.col("recovered"), F.lit(False))
    return (
        sweep_rows(runs).groupBy(*g)
        .agg(F.count_if(faulted).alias("faulted"), F.count_if(hit).alias("recovered"))
        .withColumn("unrecovered", F.col("faulted") - F.col("recovered"))
    )


def recovery_means(pairs: DataFrame, population: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Point estimates and population counts of each group; null means without pairs."""
    agg = pairs.groupBy(*g).agg(
        F.sum("pairs").alias("n_pairs"),
        F.count_distinct(F.when(F.col("pairs") > 0, F.col("doc_id"))).alias("n_documents"),
        F.sum("extra_turns").alias("_extra"),
        F.sum("faults").alias("_faults"),
        F.sum("extra_seconds").alias("_seconds"),
    )
    n = F.col("n_pairs")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return population.join(agg, list(g), "left").select(
        *g, count("n_pairs"), count("n_documents"),
        F.try_divide(F.col("_extra"), n).alias("r"),
        F.try_divide(F.col("_extra") - F.col("_faults"), n).alias("net"),
        F.try_divide(F.col("_seconds").cast("double"), n).alias("seconds_mean"),
        F.col("faulted").alias("n_faulted"), F.col("unrecovered").alias("n_unrecovered"),
        (F.col("recovered") - F.coalesce(n, F.lit(0))).alias("n_without_control"),
    )


def recovery_intervals(
    pairs: DataFrame, snapshot_id: str, g: Sequence[str] = G, rules: Rules = Rules()
) -> DataFrame:
    """Bootstrap limits of the mean extra turns (p2) and of its net form (p2_net)."""
    placed = placed_documents(document_sums(pairs, g), g)
    ratios = {"p2": ("extra", "pairs"), "p2_net": ("net", "pairs")}
    long = ratio_bootstrap(placed, ratios, snapshot_id, g, rules)
    pick = lambda s, c: F.max(F.when(F.col("statistic") == s, F.col(c)))
    return long.groupBy(*g).agg(
        pick("p2", "lo").alias("lo"), pick("p2", "hi").alias("hi"),
        pick("p2_net", "lo").alias("net_lo"), pick("p2_net", "hi").alias("net_hi"),
    )


def recovery_table(
    runs: DataFrame, snapshot_id: str, g: Sequence[str] = G, rules: Rules = Rules(),
    pairing: str = "in_expectation_unverified_stack",
) -> DataFrame:
    """Everything the second decision needs, one row per group.

    The pairs are summed once and written by document, for the means and the intervals.
    """
    pairs = cut(folded_pairs(pair_sums(runs, rules, g), g))
    means = recovery_means(pairs, population_counts(runs, rules, g), g)
    return means.join(recovery_intervals(pairs, snapshot_id, g, rules), list(g), "left").withColumn(
        "pairing", F.lit(pairing)
    )
