"""Mixing sources to target weights by iterative proportional fitting and calibrated sampling.

Every document has a source, a language and a topic. One aggregation sums tokens by their cells. Raking scales the
cells to the target share of every source, language and topic in turn until all three margins hold; a cell's weight is
the product of one factor per dimension, and every value has its own. Targets are shares by value, or a power of the
present shares (0.5 flattens, 1 keeps them). Up to ``LOCAL_CELLS`` cells (counted) are raked as sparse arrays on the
driver, more on Spark, one aggregation of the cell table per step. The factors of a dimension's ``VALUES`` heaviest
values are literals of the plan; those of the others are a table of one row per value, joined to the documents.

A document is kept with probability min(1, scale * weight of its cell), where the scale makes the expected tokens
reach ``keep`` of all tokens. The draw is a hash of the row, so it is repeatable and needs no shuffle.

Cases: null source, language or text have the value ``(null)`` or no tokens; targets for absent values are spread over
the others; a cell without tokens has weight 1; an empty table gives an empty result; repeated rows share a draw.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import small, table
from trialstats.session import cut

VALUES = 256
#: cells that are raked on the driver (some 20 MB), and factor rows that are broadcast
LOCAL_CELLS, BROADCAST_ROWS = 300_000, 200_000
#: scales that one pass over the cell table tries
SCALES = 32
OTHER, NULL = "(other)", "(null)"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS, CLOSE = 500, 1e-9
#: power of the present shares per dimension, and the share of tokens to keep, of the registered query
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.7, "lang": 0.7, "topic": 0.9}
KEEP = 0.8
SEED = 20240229


def token_count(text: Column) -> Column:
    """Runs of characters that are not blank."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def topic(text: Column) -> Column:
    """Form of a text: marked up, long, short or prose."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.translate(text, "|#*$%&!{}<>", ""))
    return (
        F.when(marks * 50 > F.length(text), "marked").when(F.length(text) >= 8000, "long")
        .when(F.length(text) < 600, "short").otherwise("prose"))


def dimension_values(docs: DataFrame, topics: Column | None = None) -> dict[str, Column]:
    return {
        "source": F.coalesce(docs["source"], F.lit(NULL)), "lang": F.coalesce(docs["lang"], F.lit(NULL)),
        "topic": topic(docs["text"]) if topics is None else F.coalesce(topics, F.lit(NULL)),
    }


@dataclass
class Mix:
    """Factors by dimension and value, and the scale of the probabilities.

    ``factors`` has a dimension's ``VALUES`` heaviest values. If there are more, ``rest`` has a table of the others (value,
    factor), and ``factors`` their mean by tokens as ``(other)``, which is for reading only.
    """

    factors: dict[str, dict[str, float]]
    scale: float
    rest: dict[str, DataFrame] = field(default_factory=dict)

    def join(self, docs: DataFrame, values: dict[str, Column], name: str) -> DataFrame:
        """``docs`` with the weight as column ``name``; values without tokens have the factor 1."""
        weight = F.lit(1.0)
        for d, by in self.factors.items():
            by = {v: f for v, f in by.items() if d not in self.rest or v != OTHER}
            factor = F.element_at(F.create_map(*(F.lit(x) for pair in by.items() for x in pair)), values[d]) if by else F.lit(None)
            weight = weight * F.coalesce(factor, F.col(f"_{d}_factor") if d in self.rest else F.lit(None), F.lit(1.0))
        for d, rest in self.rest.items():
            # the heavy values need no row and are spread, so that none of them fills a task
            key = F.when(values[d].isin([v for v in self.factors[d] if v != OTHER]), F.concat(
                F.lit("\0"), F.col("_draw").cast("string"))).otherwise(values[d])
            docs = docs.withColumn(f"_{d}", key).join(
                small(rest.toDF(f"_{d}", f"_{d}_factor"), BROADCAST_ROWS), f"_{d}", "left").drop(f"_{d}")
        return docs.withColumn(name, weight).drop(*(f"_{d}_factor" for d in self.rest))


def target_shares(present: np.ndarray, values: list[str], wanted: float | dict[str, float]) -> np.ndarray:
    share = present / present.sum()
    if isinstance(wanted, dict):
        share = np.array([max(0.0, wanted.get(v, 0.0)) for v in values]) * (present > 0)
        if not share.sum():
            raise ValueError("no value that is present has a target")
    else:
        share = np.where(share > 0, share ** wanted, 0)
    return share / share.sum()


def rake_cells(at: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray]) -> list[np.ndarray]:
    """Factors per axis that bring the margins of the cells ``at`` (a position per axis) to the targets (shares)."""
    factors = [np.ones(len(t)) for t in targets]
    now = tokens / tokens.sum()
    for _ in range(ROUNDS):
        gap = 0.0
        for axis, target in enumerate(targets):
            margin = np.bincount(at[axis], now, len(target))
            gap = max(gap, float(np.abs(margin - target).max()))
            step = np.divide(target, margin, out=np.ones_like(target), where=margin > 0)
            factors[axis] = np.clip(factors[axis] * step, 1e-12, 1e12)  # targets may contradict empty cells
            now = now * step[at[axis]]
        if gap < CLOSE:
            break
    return factors


def rake(cells: np.ndarray, targets: list[np.ndarray]) -> list[np.ndarray]:
    """``rake_cells`` for a full grid; zero cells stay zero."""
    at = np.nonzero(cells)
    return rake_cells(list(at), cells[at], targets)


def probability_scale(tokens: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """The scale at which the sum of tokens * min(1, scale * weight) is the budget."""
    low, high = 0.0, 1.0
    reach = lambda s: float((tokens * np.minimum(1, s * weights)).sum())
    most = float(tokens[weights > 0].sum())
    if most <= budget:
        return float(1 / weights[(weights > 0) & (tokens > 0)].min())
    while reach(high) < budget:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if reach(middle) < budget else (low, middle)
    return high


def _local(cells: DataFrame, targets: dict, keep: float) -> Mix:
    """Raked on the driver, for up to ``LOCAL_CELLS`` cells."""
    spark, got = cells.sparkSession, cells.toArrow()
    tokens = got["tokens"].to_numpy().astype(float)
    coded = [got[d].combine_chunks().dictionary_encode() for d in DIMENSIONS]
    at, values = [c.indices.to_numpy() for c in coded], [c.dictionary.to_pylist() for c in coded]
    present = [np.bincount(a, tokens, len(v)) for a, v in zip(at, values, strict=True)]
    factors = rake_cells(at, tokens, [
        target_shares(p, v, targets.get(d, 1.0)) for d, p, v in zip(DIMENSIONS, present, values, strict=True)])
    scale = probability_scale(tokens, np.prod([f[a] for f, a in zip(factors, at, strict=True)], axis=0), keep * tokens.sum())
    out = Mix({}, scale)
    for d, p, v, f in zip(DIMENSIONS, present, values, factors, strict=True):
        heavy = sorted(range(len(v)), key=lambda k: (-p[k], v[k]))
        out.factors[d] = {v[k]: float(f[k]) for k in heavy[:VALUES]}
        if light := heavy[VALUES:]:
            out.factors[d][OTHER] = float(np.average(f[light], weights=p[light]))
            out.rest[d] = spark.createDataFrame(pa.table({"value": [v[k] for k in light], "factor": f[light]}))
    return out


def _spread_scale(cells: DataFrame, budget: float, most: float) -> float:
    """``probability_scale`` over cells (tokens, weight) on Spark, ``SCALES`` scales a pass."""
    if most <= budget:
        return 1 / cells.agg(F.min("weight")).first()[0]

    def reach(scales):
        return cells.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(x)) * F.col("weight"))) for x in scales)).first()

    powers = [2.0**k for k in range(-SCALES, 64, 2)]
    low, high = 0.0, next(x for x, r in zip(powers, reach(powers), strict=True) if r >= budget)
    for _ in range(12):
        tried = np.linspace(low, high, SCALES + 1)[1:]
        enough = [r >= budget for r in reach(tried)] + [True]
        k = min(enough.index(True), SCALES - 1)
        low, high = float(tried[k - 1]) if k else low, float(tried[k])
    return high


def _spread(cells: DataFrame, targets: dict, keep: float) -> Mix:
    """Raked on Spark: a step is one aggregation of the cells by one dimension and a join with its row per value."""
    total = float(cells.agg(F.sum("tokens")).first()[0])
    margins = {}
    for d in DIMENSIONS:
        by, wanted = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("present")), targets.get(d, 1.0)
        if isinstance(wanted, dict):
            asked = cells.sparkSession.createDataFrame(
                pa.table({d: pa.array(list(wanted), pa.string()), "asked": pa.array([max(0.0, float(x)) for x in wanted.values()])}))
            by = by.join(small(asked, BROADCAST_ROWS), d, "left").fillna(0.0, ["asked"])
        else:
            by = by.withColumn("asked", F.pow(F.col("present") / total, F.lit(float(wanted))))
        by = cut(by)
        if not (asked := by.agg(F.sum("asked")).first()[0]):
            raise ValueError("no value that is present has a target")
        margins[d] = cut(by.select(d, "present", (F.col("asked") / asked).alias("target"), F.lit(1.0).alias("factor")))
    now = cells.withColumn("now", F.col("tokens") / total)
    for _ in range(ROUNDS):
        gap = 0.0
        for d in DIMENSIONS:
            steps = cut(now.groupBy(d).agg(F.sum("now").alias("margin")).join(margins[d], d).withColumn(
                "step", F.when(F.col("margin") > 0, F.col("target") / F.col("margin")).otherwise(1.0)))
            gap = max(gap, steps.agg(F.max(F.abs(F.col("margin") - F.col("target")))).first()[0])
            margins[d] = steps.select(
                d, "present", "target", F.greatest(F.lit(1e-12), F.least(F.lit(1e12), F.col("factor") * F.col("step"))).alias("factor"))
            now = cut(now.join(small(steps.select(d, "step"), BROADCAST_ROWS), d).withColumn(
                "now", F.col("now") * F.col("step")).drop("step"))
        if gap < CLOSE:
            break
    for d in DIMENSIONS:
        now = now.join(small(margins[d].select(d, F.col("factor").alias(f"_{d}")), BROADCAST_ROWS), d)
    weighed = cut(now.select("tokens", reduce(lambda a, b: a * b, (F.col(f"_{d}") for d in DIMENSIONS)).alias("weight")))
    out = Mix({}, _spread_scale(weighed, keep * total, total))
    for d in DIMENSIONS:
        heavy = margins[d].orderBy(F.desc("present"), d).limit(VALUES).collect()
        out.factors[d] = {r[d]: r["factor"] for r in heavy}
        light = margins[d].where(~F.col(d).isin(list(out.factors[d])))
        mean = light.agg(F.sum(F.col("present") * F.col("factor")) / F.sum("present")).first()[0]
        if mean is not None:
            out.factors[d][OTHER] = mean
            out.rest[d] = light.select(F.col(d).alias("value"), "factor")
    return out


def mix(docs: DataFrame, targets: dict = TARGETS, keep: float = KEEP, topics: Column | None = None) -> Mix:
    """Raked weights for the documents' cells."""
    values = dimension_values(docs, topics)
    cells = docs.select(*(v.alias(d) for d, v in values.items()), token_count(docs["text"]).alias("tokens"))
    # read several times below, so the texts are read once
    cells = cut(cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    n = cells.count()
    if not n:
        return Mix({d: {} for d in DIMENSIONS}, 1.0)
    return (_local if n <= LOCAL_CELLS else _spread)(cells, targets, keep)


def draw(docs: DataFrame) -> Column:
    """A uniform number from 0 to 1 of each row's id and text."""
    return F.pmod(F.xxhash64(F.lit(SEED), docs["doc_id"], docs["text"]), F.lit(1 << 52)) / float(1 << 52)


def weighted(docs: DataFrame, **options) -> DataFrame:
    """doc_id, cell, tokens, weight, probability and sampled of each row of ``docs``."""
    raked, values = mix(docs, **options), dimension_values(docs, options.get("topics"))
    rows = docs.select(
        "doc_id", *(v.alias(d) for d, v in values.items()), token_count(docs["text"]).alias("tokens"), draw(docs).alias("_draw"))
    return raked.join(rows, {d: F.col(d) for d in DIMENSIONS}, "weight").withColumn(
        "probability", F.least(F.lit(1.0), F.col("weight") * raked.scale)).select(
        "doc_id", *DIMENSIONS, "tokens", "weight", "probability", (F.col("_draw") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    raked = mix(docs, **options)
    rows = docs.select(
        *(F.col(c) for c in docs.columns), draw(docs).alias("_draw"),
        *(v.alias(f"_{d}_value") for d, v in dimension_values(docs, options.get("topics")).items()))
    rows = raked.join(rows, {d: F.col(f"_{d}_value") for d in DIMENSIONS}, "_weight")
    return rows.where(F.col("_draw") < F.least(F.lit(1.0), F.col("_weight") * raked.scale)).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return weighted(table(spark, sf_dir, "documents"))
