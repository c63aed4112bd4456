"""Counts per document and cell: the one wide pass over the trial table that every refit reuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.operators.cells import CELL, G, p1_scope, sweep_rows
from trialstats.rules import Design, Rules


def grid(rules: Rules = Rules(), design: Design = Design()) -> list[tuple[int, int]]:
    """In-scope cells in a fixed order."""
    return [(t, f) for t in rules.scope_tools for f in design.fault_pct_axis]


#: cells that become columns of a bootstrap at most; ``sparse.fit`` has no such bound
WIDE = 256


def measured_grid(
    counts: DataFrame, rules: Rules = Rules(), design: Design = Design()
) -> list[tuple[int, float]]:
    """The declared cells, then whatever other cells written counts hold, in order."""
    declared = grid(rules, design)
    rows = counts.select(*CELL).distinct().limit(WIDE + 1).collect()
    more = sorted({(r["tools"], r["fault_pct"]) for r in rows} - set(declared))
    if len(declared) + len(more) > WIDE:
        raise ValueError(f"more than {WIDE} cells: fit them in long form, a bootstrap needs a column for each")
    return declared + more


def document_counts(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Successes, runs and score mass per group, document and in-scope cell."""
    score = F.col("score").cast("decimal(18,12)")
    return (
        sweep_rows(runs).where(p1_scope(rules)).groupBy(*g, "doc_id", *CELL)
        .agg(
            F.count_if("success").alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.sum(score).alias("score_sum"),
            F.count("score").alias("score_n"),
        )
    )


def score_counts(runs: DataFrame, rules: Rules = Rules(), g: Sequence[str] = G) -> DataFrame:
    """Score mass, scored runs, least and largest score and all runs per group, document and in-scope cell."""
    score = F.col("score").cast("decimal(18,12)")
    return sweep_rows(runs).where(p1_scope(rules)).groupBy(*g, "doc_id", *CELL).agg(
        F.coalesce(F.sum(score), F.lit(0)).cast("double").alias("s"), F.count("score").alias("n"),
        F.min(score).alias("score_lo"), F.max(score).alias("score_hi"), F.count(F.lit(1)).alias("runs"))


def wide_counts(
    counts: DataFrame,
    cells: Sequence[tuple[int, int]],
    g: Sequence[str] = G,
    s: str = "s",
    n: str = "n",
) -> DataFrame:
    """One row per group and document with columns ``s_i`` and ``n_i`` in grid order.

    A cell outside the declared grid stops the job; it is never dropped silently. The short rows are dealt by document before they
    are made wide: a task that holds few cells of each of all documents would only hold more.
    """
    here = [(F.col("tools") == t) & (F.col("fault_pct") == f) for t, f in cells]
    on_grid = here[0]
    for h in here[1:]:
        on_grid = on_grid | h
    checked = counts.where(
        F.when(on_grid, F.lit(True)).otherwise(
            F.raise_error(F.lit("a trial lies outside the declared grid")).cast("boolean")
        )
    )
    kind = "double" if s != "s" else "bigint"
    sums = []
    for i, h in enumerate(here):
        sums += [
            F.coalesce(F.sum(F.when(h, F.col(s))), F.lit(0)).cast(kind).alias(f"s_{i}"),
            F.coalesce(F.sum(F.when(h, F.col(n))), F.lit(0)).alias(f"n_{i}"),
        ]
    return checked.repartition(*g, "doc_id").groupBy(*g, "doc_id").agg(*sums)


def count_columns(cells: Sequence) -> list[str]:
    return [f"{p}_{i}" for i in range(len(cells)) for p in ("s", "n")]
