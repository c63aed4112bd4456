"""The regression of ``fit`` over whatever cells a log holds: normal equations from counts in long form.

A row is (group, document, cell) with successes and runs; no cell has to be declared and rates need not be percents.
Cells of a group are put into one short row while there are at most ``CELLS`` of them, and Newton's method runs on that row.
A group with more is fitted by Spark: each step sums score and information over its cells, and only 14 numbers per
group leave the sum. Document scores for the clustered covariance are sums over cells in both cases.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.intervals import peak, sigmoid, z_value
from trialstats.operators.cells import CELL, G
from trialstats.operators.fit import COEFS, PAIRS, covariance_of, judged, limits_of, newton
from trialstats.plans.scale import broadcast_if_small
from trialstats.rules import Rules
from trialstats.session import cut

#: cells of a group that one row holds
CELLS = 65_536
STEPS, TOLERANCE, LONGEST = 100, 1e-8, 5.0


def _x() -> list[Column]:
    tc = F.col("tools") - F.lit(4.0)
    return [F.lit(1.0), tc, tc * tc, F.col("fault_pct").cast("double") / 100.0]


def cell_totals(counts: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Successes and runs per group and cell."""
    return counts.groupBy(*g, *CELL).agg(F.sum("s").cast("double").alias("s"), F.sum("n").cast("double").alias("n"))


def _linear(names: Sequence[str]) -> Column:
    return reduce(Column.__add__, (F.col(b) * x for b, x in zip(names, _x(), strict=True)))


def information(totals: DataFrame, betas: DataFrame, g: Sequence[str]) -> DataFrame:
    """Score (u_j) and information (i_jk) of every group at its coefficients, and the Gram matrix of its cells (g_jk)."""
    x = _x()
    met = totals.join(betas.select(*g, *COEFS), list(g)).withColumn("_p", sigmoid(_linear(COEFS)))
    w = F.col("n") * F.col("_p") * (1.0 - F.col("_p"))
    rest = F.col("s") - F.col("n") * F.col("_p")
    return met.groupBy(*g).agg(
        *[F.sum(x[j] * rest).alias(f"u_{j}") for j in range(4)],
        *[F.sum(w * x[j] * x[k]).alias(f"i_{j}{k}") for j, k in PAIRS])


def _leverage(totals: DataFrame, inverses: DataFrame, g: Sequence[str]) -> DataFrame:
    """The Jeffreys-prior term of the score, from the inverse information (v_jk) of every group."""
    x = _x()
    met = totals.join(inverses, list(g)).withColumn("_p", sigmoid(_linear(COEFS)))
    form = reduce(Column.__add__, (F.col(f"v_{j}{k}") * x[j] * x[k] * (1.0 if j == k else 2.0) for j, k in PAIRS))
    term = F.col("n") * F.col("_p") * (1.0 - F.col("_p")) * form * (0.5 - F.col("_p"))
    return met.groupBy(*g).agg(*[F.sum(x[j] * term).alias(f"a_{j}") for j in range(4)])


def _square(row, name: str) -> np.ndarray:
    out = np.zeros((4, 4))
    for j, k in PAIRS:
        out[j, k] = out[k, j] = row[f"{name}_{j}{k}"]
    return out


def _each(frame: DataFrame, g: Sequence[str], added: Sequence[str], work) -> DataFrame:
    """``work`` maps a row (one per group) to the values of ``added``, all doubles; the group's columns stay."""
    schema = frame.select(*g).schema
    for name in added:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[list(g)].reset_index(drop=True)
            found = [work(row) for row in pdf.to_dict("records")]
            for k, name in enumerate(added):
                out[name] = np.array([f[k] for f in found], float)
            yield out

    return frame.mapInPandas(run, schema)


def newton_by_sums(totals: DataFrame, g: Sequence[str], firth: bool = False) -> DataFrame:
    """Coefficients and ``done`` (1.0 if converged) of every group, a Spark aggregation (two with ``firth``) per step."""
    names = [*COEFS, "done"]
    states = cut(totals.select(*g).distinct().select(*g, *[F.lit(0.0).alias(c) for c in names]))

    def inverse(row):
        return [np.linalg.pinv(_square(row, "i"))[j, k] for j, k in PAIRS]

    def moved(row):
        beta = np.array([row[c] for c in COEFS])
        score = np.array([row[f"u_{j}"] + (row[f"a_{j}"] if firth else 0.0) for j in range(4)])
        step = np.linalg.pinv(_square(row, "i")) @ score
        size = np.abs(step).max()
        if not np.isfinite(size):
            return [*beta, -1.0]  # given up
        return [*(beta + step * min(1.0, LONGEST / max(size, LONGEST))), float(size < TOLERANCE)]

    for _ in range(STEPS):
        live = states.where("done = 0")
        if live.isEmpty():
            break
        sums = information(totals, live, g).join(live.select(*g, *COEFS), list(g))
        if firth:
            sums = cut(sums)
            inverses = _each(sums, g, [f"v_{j}{k}" for j, k in PAIRS], inverse).join(live.select(*g, *COEFS), list(g))
            sums = sums.join(_leverage(totals, inverses, g), list(g))
        states = cut(states.where("done <> 0").unionByName(_each(sums, g, names, moved)))
    return states


def _short(totals: DataFrame, g: Sequence[str], rules: Rules) -> DataFrame:
    """Status, reason and coefficients of groups whose cells fit one row."""
    rows = totals.groupBy(*g, "n_documents").agg(F.array_sort(F.collect_list(F.struct(*CELL, "s", "n"))).alias("cells"))
    schema = rows.select(*g, "n_documents").schema.add("n_runs", "long").add("status", "string").add("reason", "string")
    for name in COEFS:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for documents, cells in zip(pdf["n_documents"], pdf["cells"], strict=True):
                tc = np.array([c["tools"] - 4.0 for c in cells])
                f = np.array([float(c["fault_pct"]) / 100.0 for c in cells])
                x = np.column_stack([np.ones(len(cells)), tc, tc * tc, f])
                s, n = (np.array([[float(c[k]) for c in cells]]) for k in ("s", "n"))
                beta, converged = newton(x, s, n)
                rank = int(np.linalg.matrix_rank(x[n[0] > 0])) if n.sum() else 0
                state, why, beta = judged(
                    s.sum(), n.sum(), documents, rank, beta[0], converged[0], lambda x=x, s=s, n=n: newton(x, s, n, firth=True), rules)
                found.append((int(n.sum()), state, why, *beta))
            out = pdf[[*g, "n_documents"]].reset_index(drop=True)
            for k, name in enumerate(("n_runs", "status", "reason", *COEFS)):
                out[name] = [row[k] for row in found]
            yield out

    return rows.mapInPandas(run, schema)


def _long(totals: DataFrame, g: Sequence[str], rules: Rules) -> DataFrame:
    """The same for groups of any number of cells."""
    x, names = _x(), [*g, "n_documents"]
    base = cut(totals.groupBy(*names).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("n") > 0, x[j] * x[k]).otherwise(0.0)).alias(f"i_{j}{k}") for j, k in PAIRS]))
    # groups of one outcome or one document are refused without a fit
    fittable = base.where("n > 0 and s > 0 and s < n and n_documents > 1").select(*g)
    rated = cut(totals.select(*g, *CELL, "s", "n").join(fittable, g, "left_semi"))
    first = newton_by_sums(rated, g)
    worse = F.greatest(*(F.abs(c) for c in COEFS)) > rules.max_abs_coefficient
    if rules.nonconvergence_moves:
        worse = worse | (F.col("done") != 1.0)
    again = rated.join(first.where(worse).select(*g), list(g), "left_semi")
    second = newton_by_sums(again, g, firth=True) if rules.firth_rung else first.limit(0)
    both = base.join(first, list(g), "left").join(
        second.select(*g, *[F.col(c).alias(f"_{c}") for c in (*COEFS, "done")]), list(g), "left")
    schema = both.select(*names).schema.add("n_runs", "long").add("status", "string").add("reason", "string")
    for name in COEFS:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.to_dict("records"):
                beta = np.array([row[c] for c in COEFS])
                other = np.array([[row[f"_{c}"] for c in COEFS]], float), [row["_done"] == 1.0]
                state, why, beta = judged(
                    row["s"], row["n"], row["n_documents"], int(np.linalg.matrix_rank(_square(row, "i"))),
                    beta, row["done"] == 1.0, lambda other=other: other, rules)
                found.append((int(row["n"]), state, why, *beta))
            out = pdf[names].reset_index(drop=True)
            for k, name in enumerate(("n_runs", "status", "reason", *COEFS)):
                out[name] = [r[k] for r in found]
            yield out

    return both.mapInPandas(run, schema)


def estimate(counts: DataFrame, g: Sequence[str] = G, rules: Rules = Rules(), cells: int = CELLS) -> DataFrame:
    """Status, reason and coefficients of each group of written counts."""
    g = list(g)
    documents = counts.select(*g, "doc_id").distinct().groupBy(*g).agg(F.count(F.lit(1)).alias("n_documents"))
    totals = cell_totals(counts, g)
    sizes = totals.groupBy(*g).agg(F.count(F.lit(1)).alias("_cells")).join(documents, g)
    totals = cut(totals.join(sizes, g))
    out = _short(totals.where(F.col("_cells") <= cells), g, rules)
    many = totals.where(F.col("_cells") > cells)
    if not many.isEmpty():
        out = out.unionByName(_long(many, g, rules))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in COEFS})


def _products(counts: DataFrame, fitted: DataFrame, g: Sequence[str]) -> DataFrame:
    """Every group of a written fit by maximum likelihood, with the meat (m_jk) and the information (i_jk) of its coefficients."""
    # a row per group: the counts of a group need not meet in one task, only those of a document
    mle = broadcast_if_small(fitted.where("status = 'mle'").select(*g, *COEFS))
    x = _x()
    met = counts.select(*g, "doc_id", *CELL, "s", "n").repartition(*g, "doc_id").join(mle, g)
    rest = F.col("s") - F.col("n") * sigmoid(_linear(COEFS))
    scores = met.groupBy(*g, "doc_id").agg(*[F.sum(x[j] * rest).alias(f"u_{j}") for j in range(4)])
    meat = scores.groupBy(*g).agg(*[F.sum(F.col(f"u_{j}") * F.col(f"u_{k}")).alias(f"m_{j}{k}") for j, k in PAIRS])
    bread = information(cell_totals(counts, g), mle, g).select(*g, *[f"i_{j}{k}" for j, k in PAIRS])
    return fitted.join(meat, g).join(bread, g)


def fit(counts: DataFrame, g: Sequence[str] = G, rules: Rules = Rules(), cells: int = CELLS) -> DataFrame:
    """The whole primary fit of every group from written counts per document and cell, whatever the cells."""
    g = list(g)
    fitted = cut(estimate(counts, g, rules, cells))
    names = [f"{n}_{side}" for n in COEFS for side in ("lo", "hi")]

    def limits(row):
        beta = np.array([row[c] for c in COEFS])
        return limits_of(beta, _square(row, "i"), _square(row, "m"), row["n_documents"], row["n_runs"], rules)

    out = fitted.join(_each(_products(counts, fitted, g), g, names, limits), g, "left")
    return out.withColumn("peak", peak("tc", "tc2"))


def fractional_logit(counts: DataFrame, g: Sequence[str] = G, rules: Rules = Rules(), cells: int = CELLS) -> DataFrame:
    """The same regression on the continuous score, from written ``score_counts``.

    A group is refused without a fit where all its scores are equal or none is known, and where the ladder refuses it.
    """
    g = list(g)
    scored = counts.where("n > 0")
    spread = cut(counts.groupBy(*g).agg(
        F.count_distinct(F.when(F.col("n") > 0, F.col("doc_id"))).alias("n_documents"), F.sum("n").alias("n_runs"),
        F.coalesce(F.min("score_lo") < F.max("score_hi"), F.lit(False)).alias("_varied")))
    out = fit(cut(scored.join(spread.where("_varied").select(*g), g, "left_semi")), g, rules, cells)
    fitted = F.col("status") == "mle"
    rest = [c for c in out.columns if c not in (*g, "n_documents", "n_runs", "status", "reason")]
    out = out.withColumns({c: F.when(fitted, F.col(c)) for c in rest}).withColumn(
        "status", F.when(fitted, "fitted").otherwise("not_estimable"))
    same = spread.where(~F.col("_varied")).select(
        *g, "n_documents", "n_runs", F.lit("not_estimable").alias("status"),
        F.when(F.col("n_runs") > 0, "no variation in score").otherwise("no score").alias("reason"))
    return out.unionByName(same, allowMissingColumns=True)


def _form(weights: Sequence[Column]) -> Column:
    """w'Vw of the covariance held in v_jk."""
    return reduce(Column.__add__, (
        F.col(f"v_{j}{k}") * weights[j] * weights[k] * (1.0 if j == k else 2.0) for j, k in PAIRS))


def surface(counts: DataFrame, points: Sequence[tuple[int, float]], g: Sequence[str] = G, rules: Rules = Rules(),
            cells: int = CELLS) -> DataFrame:
    """Fitted rate and its slope along each axis at the asked cells (tools, fault_pct) of every group.

    ``per_tool`` is the slope a tool, ``per_fault`` that over the fault rate from 0 to 1. Limits are those of the delta
    method with the clustered covariance, for the rate on the logit scale. ``status`` is fitted, off_grid where the
    group has no run at the cell, or not_estimable where it has no maximum-likelihood fit; the values are null in both.
    """
    g, z = list(g), z_value(rules.alpha)
    fitted = cut(estimate(counts, g, rules, cells))
    names = [f"v_{j}{k}" for j, k in PAIRS]

    def spread(row):
        v = covariance_of(_square(row, "i"), _square(row, "m"), row["n_documents"], row["n_runs"])
        return [v[j, k] for j, k in PAIRS]

    known = fitted.join(_each(_products(counts, fitted, g), g, names, spread), g, "left")
    asked = F.array(*[F.struct(F.lit(t).alias("tools"), F.lit(float(f)).alias("fault_pct")) for t, f in points])
    run = counts.where("n > 0").select(*g, "tools", F.col("fault_pct").cast("double").alias("fault_pct")).distinct()
    at = known.select("*", F.inline(asked)).join(run.withColumn("_run", F.lit(True)), [*g, *CELL], "left")
    status = F.when(F.col("_run").isNull(), "off_grid").when(F.col("status") == "mle", "fitted").otherwise("not_estimable")
    at = at.withColumn("status", status).withColumn("_eta", _linear(COEFS)).withColumn("_p", sigmoid(F.col("_eta")))
    x, w = _x(), F.col("_p") * (1.0 - F.col("_p"))
    zero, one = F.lit(0.0), F.lit(1.0)
    values = {"fitted": F.col("_p")}
    half = F.sqrt(_form(x)) * z
    values |= {"fitted_lo": sigmoid(F.col("_eta") - half), "fitted_hi": sigmoid(F.col("_eta") + half)}
    for name, way in (("per_tool", [zero, one, 2.0 * x[1], zero]), ("per_fault", [zero, zero, zero, one])):
        slope = reduce(Column.__add__, (F.col(b) * c for b, c in zip(COEFS, way, strict=True)))
        half = F.sqrt(_form([w * (c + (1.0 - 2.0 * F.col("_p")) * slope * e) for c, e in zip(way, x, strict=True)])) * z
        values |= {name: w * slope, f"{name}_lo": w * slope - half, f"{name}_hi": w * slope + half}
    return at.select(*g, *CELL, "status", *[
        F.when(F.col("status") == "fitted", v).alias(n) for n, v in values.items()])
