"""Straight line against logistic step along the fault axis, per dose column and pooled.

A column has one point per fault level, so each fit is a handful of numbers; Spark gathers those
points per column and the fits run side by side in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.operators.cells import G

# Parameter bounds, the clip of the fitted rate, the least number of levels, the label margin.
LINE_BOX = ((-1.0, 2.0), (-20.0, 20.0))
STEP_BOX = ((-200.0, 200.0), (-0.5, 1.0))
CLIP = 1e-6
MIN_LEVELS = 4
MARGIN = 2.0

#: points per side of the search grid; each round keeps the cells around its best point
GRID = 61
RESOLUTION = 1e-9


def zoom(loss, box: np.ndarray) -> tuple[np.ndarray, float]:
    """Lowest point of ``loss`` in a box by grids that shrink around the best point until they are below ``RESOLUTION``."""
    low, high = box[:, 0].copy(), box[:, 1].copy()
    best, value = None, np.inf
    while True:
        axes = np.meshgrid(*(np.linspace(a, b, GRID) for a, b in zip(low, high)), indexing="ij")
        points = np.stack([x.ravel() for x in axes], axis=1)
        if best is not None:
            points = np.vstack([points, best])
        values = loss(points)
        at = int(np.argmin(values))
        best, value = points[at], float(values[at])
        reach = 3 * (high - low) / (GRID - 1)
        if (reach <= RESOLUTION * (1 + np.abs(best))).all():
            return best, value
        low, high = np.maximum(box[:, 0], best - reach), np.minimum(box[:, 1], best + reach)


def negative_likelihood(p: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = np.clip(p, CLIP, 1 - CLIP)
    ways = sum(lgamma(t + 1) - lgamma(c + 1) - lgamma(t - c + 1) for t, c in zip(n, k))
    return -(ways + (k * np.log(p) + (n - k) * np.log1p(-p)).sum(axis=-1))


def best_height(shape: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Height in 0..1 that makes height * shape most likely, one per row: the score falls, so its root is bisected."""
    low, high = np.zeros(len(shape)), np.ones(len(shape))
    for _ in range(50):
        a = (low + high) / 2
        p = a[:, None] * shape
        score = (k - (n - k) * p / np.maximum(1 - p, CLIP)).sum(axis=1)
        low, high = np.where(score > 0, a, low), np.where(score > 0, high, a)
    return high


def fall(point: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Logistic step from 1 to 0 with steepness and midpoint, one row per point."""
    return 1 / (1 + np.exp(np.clip(point[:, :1] * (f - point[:, 1:]), -700, 700)))


def shape_one(f, k, n) -> dict:
    """Maximum likelihood of a line and of a step (its height profiled out), compared by AIC."""
    line, line_loss = zoom(lambda x: negative_likelihood(x[:, :1] + x[:, 1:] * f, k, n), np.array(LINE_BOX))

    def profile(x):
        # steepness on a cubic scale, so that the grid is dense near zero
        shape = fall(np.column_stack([200 * x[:, 0] ** 3, x[:, 1]]), f)
        return negative_likelihood(best_height(shape, k, n)[:, None] * shape, k, n)

    point, step_loss = zoom(profile, np.array([(-1.0, 1.0), STEP_BOX[1]]))
    steepness = 200 * point[0] ** 3
    height = best_height(fall(np.array([[steepness, point[1]]]), f), k, n)[0]
    by_line, by_step = 2 * (2 + line_loss), 2 * (3 + step_loss)
    if abs(by_line - by_step) < MARGIN:
        label = "indistinguishable"
    else:
        label = "cliff" if by_step < by_line else "slope"
    return dict(aic_lin=by_line, aic_log3=by_step, a=height, s=steepness, f0=point[1],
                lin_intercept=line[0], lin_slope=line[1], label=label)


def shape_fit(cells: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """One row per in-scope column and one pooled row (``tools`` null) with enough fault levels."""
    keys = [*g, "tools", "fault_pct"]
    counted = cells.where(F.col("in_scope") & (F.col("n") > 0)).groupingSets(
        [[F.col(c) for c in keys], [F.col(c) for c in (*g, "fault_pct")]], *[F.col(c) for c in keys]
    ).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    point = F.struct((F.col("fault_pct") / 100.0).alias("f"), F.col("k").cast("double").alias("k"),
                     F.col("n").cast("double").alias("n"))
    # one entry per fault level of the design
    columns = counted.groupBy(*g, "tools").agg(F.sort_array(F.collect_list(point)).alias("_p")).where(
        F.size("_p") >= MIN_LEVELS)
    rows = columns.select(*g, "tools", F.col("_p.f").alias("f"), F.col("_p.k").alias("k"), F.col("_p.n").alias("n"))
    names = ["aic_lin", "aic_log3", "a", "s", "f0", "lin_intercept", "lin_slope"]
    schema = rows.select(*g, "tools").schema
    for name in names:
        schema = schema.add(name, "double")
    schema = schema.add("label", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                fits = [shape_one(*map(np.asarray, r)) for r in zip(pdf["f"], pdf["k"], pdf["n"])]
                yield pd.concat([pdf[[*g, "tools"]].reset_index(drop=True), pd.DataFrame(fits)], axis=1)[
                    [*g, "tools", *names, "label"]]

    return rows.repartition(F.col("tools"), *[F.col(c) for c in g]).mapInPandas(run, schema)
