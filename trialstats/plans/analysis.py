"""The whole analysis of a run log as one set of result tables, for all groups and readings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.intervals import drop_column
from trialstats.operators import boot as B
from trialstats.operators import cells as C
from trialstats.operators import counts as K
from trialstats.operators import recovery as R
from trialstats.operators import sparse as SP
from trialstats.operators import verdict as V
from trialstats.rules import UNPARSEABLE, Design, Rules
from trialstats.session import cut


@dataclass
class P1:
    """Tables of the first decision."""

    cells: DataFrame
    fit: DataFrame
    boot: DataFrame
    verdict: DataFrame


def first_decision(
    runs: DataFrame, snapshot_id: str, g: Sequence[str] = C.G, rules: Rules = Rules(),
    design: Design = Design(), statistic: str = "p1",
) -> P1:
    """Counts once, then fit, bootstrap and decision from the counts alone."""
    return decision_of_counts(
        C.cell_table(runs, rules, g), cut(K.document_counts(runs, rules, g)), snapshot_id, g, rules, design, statistic)


def decision_of_counts(
    cells: DataFrame, counts: DataFrame, snapshot_id: str, g: Sequence[str] = C.G, rules: Rules = Rules(),
    design: Design = Design(), statistic: str = "p1",
) -> P1:
    """The decision from rates per cell and counts per document and cell.

    The fit and the bootstrap read ``counts`` several times: a written table, or a view that is cheap to read from one. The three
    result tables have one row per cell or group; they are written so that the decision, the statements and the snapshot read them
    instead of running the bootstrap again.
    """
    cells = cut(cells)
    grid = K.measured_grid(counts, rules, design)
    placed = B.placed_documents(K.wide_counts(counts, grid, g), g)
    fit = cut(SP.fit(counts, g, rules))
    estimable = fit.where(F.col("status") != "not_estimable").withColumn(
        "drop_column", drop_column("peak", *rules.peak_range)
    )
    draws = B.regression_draws(placed, grid, snapshot_id, g, rules, statistic)
    boot = cut(B.regression_bootstrap(draws, estimable, g, rules))
    return P1(cells, fit, boot, V.verdict_p1(fit, boot, cells, g, rules))


def _variants(rules: Rules, offsets: Sequence[float]) -> dict[str, tuple[Column, Column]]:
    """Success and score of every reading. A turned abort keeps its recorded outcome: it enters the cell rates but stays
    out of the regression."""
    bad = F.coalesce(F.col("abort_cause") == UNPARSEABLE, F.lit(False))
    return {
        "registered": (F.col("success"), F.col("score")),
        **{f"tau{o:+g}": (C.success_at(rules.tau, o), F.col("score")) for o in offsets},
        "unparseable_as_failure": (
            F.when(bad, F.lit(False)).otherwise(F.col("success")), F.when(bad, F.lit(0.0)).otherwise(F.col("score"))),
    }


def readings(runs: DataFrame, rules: Rules = Rules(), offsets=(-0.1, 0.1)) -> DataFrame:
    """Registered, re-thresholded and unparseable-as-failure readings of every run, a row for each.

    For looking at single runs; ``reading_counts`` counts all readings in one pass over the runs.
    """
    rows = [F.struct(F.lit(name).alias("reading"), success.alias("success"), score.alias("score"))
            for name, (success, score) in _variants(rules, offsets).items()]
    fanned = runs.withColumn("_r", F.explode(F.array(*rows)))
    return fanned.withColumns({
        "reading": F.col("_r.reading"), "success": F.col("_r.success"), "score": F.col("_r.score"),
    }).drop("_r")


def reading_counts(
    runs: DataFrame, rules: Rules = Rules(), offsets=(-0.1, 0.1), g: Sequence[str] = C.G
) -> tuple[DataFrame, DataFrame]:
    """Rates per cell and counts per document and in-scope cell of every reading: (cells, counts), with ``reading``.

    One aggregation over the runs holds two filtered count pairs per reading; its rows, one per document and cell, are
    written, and unpivoted wherever they are read, so no table holds a row for each reading.
    """
    named = _variants(rules, offsets)
    read = [success.alias(f"_y{i}") for i, (success, _) in enumerate(named.values())]
    rows = C.sweep_rows(runs).select(*g, "doc_id", *C.CELL, "outcome", *read)
    sums = []
    for i in range(len(named)):
        inside = C.p1_scope(rules, F.col(f"_y{i}"))
        sums += [F.count(f"_y{i}").alias(f"n{i}"), F.count_if(f"_y{i}").alias(f"k{i}"),
                 F.count_if(inside).alias(f"m{i}"), F.count_if(inside & F.col(f"_y{i}")).alias(f"s{i}")]
    once = cut(rows.groupBy(*g, "doc_id", *C.CELL).agg(*sums))
    one = [F.struct(F.lit(name).alias("reading"), *[F.col(f"{c}{i}").alias(c) for c in "nkms"]) for i, name in enumerate(named)]
    unpivoted = lambda rows: rows.select(*g, "doc_id", *C.CELL, F.inline(F.array(*one)))
    long, keys = unpivoted(once), ["reading", *g]
    cells = C.rated(long.groupBy(*keys, *C.CELL).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0"), keys, rules)
    # cells out of scope go before the unpivoting, below which a later check of the cells may be pushed
    inside = once.where(F.greatest(*[F.col(f"m{i}") for i in range(len(named))]) > 0)
    counts = unpivoted(inside).where("m > 0").select(*keys, "doc_id", *C.CELL, "s", F.col("m").alias("n"))
    return cells, counts


RG = ("reading", *C.G)


def sensitivity(
    runs: DataFrame, snapshot_id: str, rules: Rules = Rules(), design: Design = Design()
) -> DataFrame:
    """First decision of every reading on the same resample indices, against the registered one."""
    p1 = decision_of_counts(*reading_counts(runs, rules), snapshot_id, RG, rules, design)
    registered = p1.verdict.where(F.col("reading") == "registered").select(
        *C.G, F.col("verdict").alias("registered")
    )
    return p1.verdict.join(registered, list(C.G), "left").withColumn(
        "differs", F.col("verdict") != F.col("registered")
    )


def analyze(
    runs: DataFrame, snapshot_id: str, rules: Rules = Rules(), design: Design = Design(),
    pairing: str = "in_expectation_unverified_stack",
) -> dict[str, DataFrame]:
    """All result tables of the registered reading, keyed by name."""
    g = C.G
    p1 = first_decision(runs, snapshot_id, g, rules, design)
    recovery = cut(R.recovery_table(runs, snapshot_id, g, rules, pairing))
    p1.verdict = cut(p1.verdict)
    p2 = V.verdict_p2(recovery, g, rules)
    counts = cut(C.run_counts(runs, rules, g))
    instrument = C.instrument_check(counts.select(*g), p1.cells, rules, g)
    return {
        "cells": p1.cells,
        "fit": p1.fit,
        "bootstrap": p1.boot,
        "recovery": recovery,
        "instrument": instrument,
        "verdict_p1": p1.verdict,
        "verdict_p2": p2,
        "counts": counts,
        "statements": V.statements(p1.verdict, p2, instrument, counts, snapshot_id, g),
        "viable_fraction": C.viable_fraction(p1.cells, g),
        "boundary_width": C.boundary_width(p1.cells, rules, g),
        "malformed": C.malformed_rates(runs, g),
    }
