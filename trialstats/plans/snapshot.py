"""One nested entry per model that restates the result tables without recomputing anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions.jsonsafe import json_rows
from trialstats.operators.cells import G


def _nested(df: DataFrame, name: str) -> DataFrame:
    """One struct per group of a table with one row per group."""
    return df.select(*G, F.struct(*[c for c in df.columns if c not in G]).alias(name))


def _listed(df: DataFrame, name: str) -> DataFrame:
    """Rows of a group as a sorted list; the tables listed here have one row per grid cell."""
    rows = F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c not in G])))
    return df.groupBy(*G).agg(rows.alias(name))


def require_one(df: DataFrame, column: str) -> None:
    """Refuse results produced under different snapshot ids or rule hashes."""
    found = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if found.a != found.b:
        raise ValueError(f"results carry more than one {column}: {found.a}, {found.b}")


def model_entries(tables: dict[str, DataFrame], snapshot: str, rules_hash: str) -> DataFrame:
    """(model_id, entry): every mix of a model with its decisions, rates and intervals."""
    out = _nested(tables["counts"], "counts")
    for name in ("fit", "bootstrap", "recovery", "instrument", "viable_fraction", "statements"):
        out = out.join(_nested(tables[name], name), list(G), "left")
    for name in ("verdict_p1", "verdict_p2"):
        out = out.join(_nested(tables[name], name), list(G), "left")
    for name in ("cells", "boundary_width"):
        out = out.join(_listed(tables[name], name), list(G), "left")
    fields = [c for c in out.columns if c != "model_id"]
    mixes = out.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("mix"))).alias("_m"),
                                        F.map_from_entries(F.collect_list(F.struct(
                                            F.col("mix"), F.struct(*fields).alias("r")))).alias("mixes"))
    return mixes.select(
        "model_id", F.lit(snapshot).alias("snapshot"), F.lit(rules_hash).alias("rules_hash"),
        F.transform("_m", lambda m: m["mix"]).alias("mix_names"), "mixes")


def entry_json(entries: DataFrame) -> DataFrame:
    return json_rows(entries)


def run_manifest(tables: dict[str, DataFrame], spend: DataFrame, identities: DataFrame,
                 rules_hash: str) -> DataFrame:
    """Per model: run counters, spend, served identities and the rule hash."""
    counts = tables["counts"].groupBy("model_id").agg(
        F.sum("runs_analyzed").alias("runs"), F.sum("aborted_transport").alias("aborted"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    served = identities.groupBy("model_id", "kind").agg(F.count(F.lit(1)).alias("distinct_values")).groupBy(
        "model_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "distinct_values"))).alias("served"))
    return counts.join(spend, "model_id", "left").join(served, "model_id", "left").withColumn(
        "rules_hash", F.lit(rules_hash))
