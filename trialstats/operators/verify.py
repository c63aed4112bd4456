"""Comparison of stored and recomputed results within a numeric tolerance."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from trialstats.functions.intervals import newcombe
from trialstats.functions.text import names_user_folder, shorten_paths

REL_TOL = 1e-9
ABS_TOL = 1e-12


def close(a: Column, b: Column) -> Column:
    """Equal within the relative or absolute tolerance; null when a side is null."""
    spread = F.greatest(F.lit(REL_TOL) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS_TOL))
    return (a == b) | (F.abs(a - b) <= spread)


_LEAVES = types.ArrayType(types.StructType([
    types.StructField(n, types.StringType()) for n in ("path", "kind", "value")]))
_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class _Number(str):
    """The text of a JSON number."""


def json_leaves(text: str | None) -> list[dict]:
    """Leaves of a JSON text at any depth; the size of a list is a leaf of its own, a map is one without a value."""
    out = []
    open_ = [("$", None if text is None else json.loads(
        text, parse_int=_Number, parse_float=_Number, parse_constant=_Number))]
    while open_:
        path, v = open_.pop()
        kind, value = "string", v
        if v is None:
            kind = "null"
        elif isinstance(v, bool):
            kind, value = "boolean", str(v).lower()
        elif isinstance(v, _Number):
            kind, value = "number", str(v)
        elif isinstance(v, list):
            kind, value = "list", str(len(v))
            open_ += [(f"{path}[{n}]", x) for n, x in enumerate(v)]
        elif isinstance(v, dict):
            kind, value = "map", None
            # a key that is no plain name is quoted, so two paths never share a text
            open_ += [(f"{path}.{k}" if _PLAIN_KEY.fullmatch(k) else f"{path}[{json.dumps(k)}]", x) for k, x in v.items()]
        out.append({"path": path, "kind": kind, "value": value})
    return out


@F.pandas_udf(_LEAVES)
def _leaves(texts: pd.Series) -> pd.Series:
    return texts.map(json_leaves)


def flatten_json(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """One row per leaf of a VARIANT column at any depth: (key, path, kind, value text)."""
    return df.select(*key, F.inline(_leaves(F.to_json(column))))


def json_differences(a: DataFrame, b: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Paths at which two JSON tables differ; numbers within tolerance agree, a boolean is never a
    number."""
    key = list(key)
    left = flatten_json(a, key, column).withColumnsRenamed({"kind": "_ka", "value": "_va"})
    right = flatten_json(b, key, column).withColumnsRenamed({"kind": "_kb", "value": "_vb"})
    both = left.join(right, [*key, "path"], "full_outer")
    numbers = (F.col("_ka") == "number") & (F.col("_kb") == "number")
    same = F.when(numbers, close(F.col("_va").cast("double"), F.col("_vb").cast("double"))).otherwise(
        F.col("_ka").eqNullSafe(F.col("_kb")) & F.col("_va").eqNullSafe(F.col("_vb")))
    status = (
        F.when(F.col("_ka").isNull() | F.col("_kb").isNull(), "present on one side only")
        .when(~same, "different")
    )
    return both.withColumn("status", status).where("status is not null").select(
        *key, "path", "status", F.col("_va").alias("left_value"), F.col("_vb").alias("right_value"))


def table_differences(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Differing values of two tables by row key and column, and rows present on one side only."""
    key = list(key)
    left = a.select(*key, F.struct(*columns).alias("_a"))
    right = b.select(*key, F.struct(*columns).alias("_b"))
    both = left.join(right, key, "full_outer")
    types = dict(a.select(*columns).dtypes)
    cells = []
    for c in columns:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        numeric = types[c] in ("double", "float") or types[c].startswith(("decimal", "int", "bigint"))
        same = F.coalesce(close(x.cast("double"), y.cast("double")), x.isNull() & y.isNull()) if numeric else x.eqNullSafe(y)
        cells.append(F.struct(F.lit(c).alias("column"), x.cast("string").alias("left_value"),
                              y.cast("string").alias("right_value"), same.alias("same")))
    one_side = F.col("_a").isNull() | F.col("_b").isNull()
    alone = F.array(F.struct(
        F.lit("*").alias("column"), F.when(F.col("_a").isNotNull(), "present").alias("left_value"),
        F.when(F.col("_b").isNotNull(), "present").alias("right_value"), F.lit(False).alias("same")))
    rows = both.select(*key, F.inline(F.when(one_side, alone).otherwise(F.array(*cells))))
    return rows.where(~F.col("same")).drop("same")


def comparison_status(differences: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """identical, within_tolerance or different for one output, from its difference tables."""
    out = differences.agg(F.count(F.lit(1)).alias("differences"))
    if exact is None:
        return out.withColumn("status", F.when(F.col("differences") == 0, "within_tolerance").otherwise("different"))
    bits = exact.agg(F.count(F.lit(1)).alias("_bits")).scalar()
    return out.withColumn(
        "status", F.when(F.col("differences") > 0, "different").when(bits == 0, "identical")
        .otherwise("within_tolerance"))


def exact_differences(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows whose values are not bit-equal."""
    key = list(key)
    left = a.select(*key, F.xxhash64(*columns).alias("_a"))
    right = b.select(*key, F.xxhash64(*columns).alias("_b"))
    return left.join(right, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key)


def first_shown(differences: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """The first ``rows`` differences for a report."""
    return differences.orderBy(*order).limit(rows)


def manifest_differences(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files that changed, are missing, or are not listed: (path, status)."""
    a = listed.select("path", F.col("sha256").alias("_a"), F.lit(True).alias("_la"))
    b = found.select("path", F.col("sha256").alias("_b"), F.lit(True).alias("_lb"))
    status = (
        F.when(F.col("_lb").isNull(), "missing").when(F.col("_la").isNull(), "unlisted")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "mismatched")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def remeasurement(old: DataFrame, new: DataFrame, cell: Sequence[str] = ("tools", "fault_pct")) -> DataFrame:
    """Published against repeated runs per cell: rates within noise, and identical transcripts."""
    o = old.select("run_id", F.col("success").alias("_o"), F.col("transcript_hash").alias("_ho"))
    n = new.select("run_id", *cell, F.col("success").alias("_n"), F.col("transcript_hash").alias("_hn"))
    both = n.join(o, "run_id", "left")
    compared = F.col("_ho").isNotNull() & F.col("_hn").isNotNull()
    t = both.groupBy(*cell).agg(
        F.count_if("_o").alias("published_k"), F.count("_o").alias("published_n"),
        F.count_if("_n").alias("k"), F.count("_n").alias("n"),
        F.count_if(compared & (F.col("_ho") == F.col("_hn"))).alias("identical_transcripts"),
        F.count_if(compared).alias("compared_transcripts"),
    )
    lo, hi = newcombe("k", "n", "published_k", "published_n")
    return t.withColumns({"lo": lo, "hi": hi}).withColumn(
        "consistent", F.coalesce((F.col("lo") <= 0) & (F.col("hi") >= 0), F.lit(False)))


def redact_paths(df: DataFrame) -> DataFrame:
    """User folders shortened in every text column."""
    texts = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: shorten_paths(F.col(c)) for c in texts})


def require_no_user_folder(df: DataFrame) -> DataFrame:
    """Stop where a text column still names a user folder."""
    texts = [c for c, t in df.dtypes if t == "string"]
    out = df
    for c in texts:
        stop = F.raise_error(F.lit(f"column {c} names a user folder")).cast("string")
        out = out.withColumn(c, F.when(names_user_folder(F.col(c)), stop).otherwise(F.col(c)))
    return out
