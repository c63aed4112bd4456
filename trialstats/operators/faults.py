"""Fault assignment and deterministic text corruption."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from trialstats.functions import draws as D
from trialstats.rules import Design

# The result texts of the fault kinds and the corruption alphabet.
TIMEOUT_TEXT = '{"error": "timeout", "timeout_s": 30, "tool": "%s"}'
ERROR_TEXT = '{"error": "service_unavailable", "status": 503}'
EMPTY_TEXT = ""
ALPHABET = '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ{}[]",:;.-_ #'


def call_key(design: Design = Design()) -> tuple:
    """Identity parts of one call. Dose and fault rate stay out, so a hit at a low rate stays a hit
    at every higher rate."""
    return (
        design.root_seed, D.json_string("model_id"), D.json_string("mix"),
        D.json_string("doc_id"), D.number("epoch"), D.number("call_index"),
    )


def assign_faults(calls: DataFrame, design: Design = Design(), exempt: str | None = None) -> DataFrame:
    """Add ``fires`` and ``kind`` to calls (model, mix, document, epoch, call index, fault rate)."""
    key = call_key(design)
    drawn = calls.withColumns({"_u1": D.unit("fault", *key), "_u2": D.unit("kind", *key)})
    fires = (F.col("fault_pct") > 0) & (F.col("_u1") < F.col("fault_pct") / F.lit(100.0))
    if exempt is not None:
        fires = fires & (F.col("tool") != exempt)
    kind = D.choice_weighted(F.col("_u2"), design.fault_kinds, design.fault_weights)
    return drawn.withColumn("fires", fires).withColumn("kind", F.when(F.col("fires"), kind)).drop("_u1", "_u2")


def nesting_violations(calls: DataFrame, design: Design = Design()) -> DataFrame:
    """Calls whose fault set is not nested along the fault axis, or whose kind changes with it."""
    key = ["model_id", "mix", "doc_id", "epoch", "call_index"]
    rates = calls.select(*key).distinct().withColumn(
        "fault_pct", F.explode(F.lit(list(design.fault_pct_axis))))
    a = assign_faults(rates, design)
    return a.groupBy(*key).agg(
        F.min(F.when(F.col("fires"), F.col("fault_pct"))).alias("first_hit"),
        F.max(F.when(~F.col("fires"), F.col("fault_pct"))).alias("last_miss"),
        F.min("kind").alias("_k1"), F.max("kind").alias("_k2"),
    ).where((F.col("first_hit") < F.col("last_miss")) | (F.col("_k1") != F.col("_k2"))).drop("_k1", "_k2")


def fault_payload(kind: Column, tool: Column, genuine: Column) -> Column:
    """Result text of a fault; the garbled kind passes an (already corrupted) genuine result."""
    return (
        F.when(kind == "timeout", F.format_string(TIMEOUT_TEXT, tool))
        .when(kind == "error_response", ERROR_TEXT).when(kind == "empty_result", EMPTY_TEXT)
        .otherwise(genuine)
    )


def fault_executed(kind: Column) -> Column:
    return kind == "garbled_payload"


@F.pandas_udf(types.BooleanType())
def _strict_json(text: pd.Series) -> pd.Series:
    def parses(t):
        if t is None:
            return False
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    return text.map(parses)


def parses_as_json(text: Column) -> Column:
    """Strict JSON check. Only texts that begin like a JSON value are sent to Python."""
    candidate = text.rlike(r'^[ \t\n\r]*[\[{"\-0-9tfnNI]')
    return F.coalesce(_strict_json(F.when(candidate, text)), F.lit(False))


def garble(df: DataFrame, text: str, key: tuple, out: str, design: Design = Design()) -> DataFrame:
    """``corrupt`` a text column; the result is then made to differ from any JSON value and from the original."""
    return never_json(corrupt(df, text, key, out, design), text, out)


def corrupt(df: DataFrame, text: str, key: tuple, out: str, design: Design = Design()) -> DataFrame:
    """Replace a hashed share of a text's characters and cut it at a hashed point.

    ``key`` identifies the call. The per-character draws are one array column, so each is hashed once. In rare cases what is
    left is a JSON value, as when both ends become quotes.
    """
    size = len(ALPHABET)

    def substitute(ch: Column, k: Column) -> Column:
        at = F.floor(D.unit("garble", *key, "sub", D.number(k)) * size).cast("int") % size
        new = F.substr(F.lit(ALPHABET), at + 1, F.lit(1))
        other = F.substr(F.lit(ALPHABET), (at + 1) % size + 1, F.lit(1))
        return F.when(new != ch, new).otherwise(other)

    original = F.col(text)
    n = F.char_length(original)
    hit = lambda k: D.unit("garble", *key, D.number(k)) < design.garble_fraction
    keep = n
    if design.garble_truncate:
        span = n * (F.lit(0.3) + F.lit(0.7) * D.unit("garble", *key, "cut"))
        keep = F.greatest(F.floor(span).cast("int"), F.lit(1))
    indexes = F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    marked = (
        df.withColumn("_hits", F.filter(indexes, hit))
        .withColumn("_hits", F.when(F.size("_hits") == 0, F.array(F.lit(0))).otherwise(F.col("_hits")))
        .withColumn("_keep", keep)
        .withColumn("_hits", F.filter("_hits", lambda k: k < F.col("_keep")))
    )
    # pieces: each replaced character followed by the untouched run up to the next one
    ends = F.concat(F.slice("_hits", 2, F.greatest(F.size("_hits"), F.lit(1))), F.array("_keep"))
    pieces = F.zip_with(
        "_hits", ends,
        lambda k, e: F.concat(
            substitute(F.substr(original, k + 1, F.lit(1)), k),
            F.substr(original, k + 2, F.greatest(e - k - 1, F.lit(0))),
        ),
    )
    first = F.coalesce(F.try_element_at("_hits", F.lit(1)), F.col("_keep"))
    long = F.concat(F.substr(original, F.lit(1), first), F.array_join(pieces, ""))
    short = substitute(F.substring(original, 1, 1), F.lit(0))
    return marked.withColumn(out, F.when(n <= 1, short).otherwise(long)).drop("_hits", "_keep")


def never_json(df: DataFrame, original: str, corrupted: str) -> DataFrame:
    """Append quotes until the corrupted text is no JSON and not the original (two suffice)."""
    once = F.concat(F.col(corrupted), F.lit('"'))
    bad = lambda c: parses_as_json(c) | (c == F.col(original))
    marked = df.withColumn("_bad0", bad(F.col(corrupted))).withColumn("_bad1", bad(once))
    tail = F.when(~F.col("_bad0"), "").when(~F.col("_bad1"), '"').otherwise('""')
    return marked.withColumn(corrupted, F.concat(F.col(corrupted), tail)).drop("_bad0", "_bad1")
