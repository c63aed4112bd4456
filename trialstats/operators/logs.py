"""What a run log says about its own production: stalls, sessions and served identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.plans.scale import previous

STALL_MINUTES = 20


def stall_gaps(log: DataFrame, key: Sequence[str], ts: str, minutes: int = STALL_MINUTES) -> DataFrame:
    """Rows that follow their predecessor by more than ``minutes``."""
    log = log.withColumn(ts, F.col(ts).cast("timestamp"))
    t = previous(log, key, ts, F.col(ts), "previous_ts")
    gap = F.unix_micros(ts) - F.unix_micros("previous_ts")
    return t.withColumn("gap_seconds", gap / F.lit(1_000_000.0)).where(
        F.col("gap_seconds") > minutes * 60)


def session_pairs(sessions: DataFrame, key: Sequence[str] = ("started",)) -> DataFrame:
    """Start and finish records of each session; a start without a finish was killed."""
    start, finish = F.col("event") == "start", F.col("event") == "finish"
    return sessions.groupBy(*key).agg(
        F.max(F.when(start, F.col("planned"))).alias("planned"),
        F.max(F.when(finish, F.col("completed"))).alias("completed"),
        F.bool_or(start).alias("_s"), F.bool_or(finish).alias("_f"),
    ).where("_s").withColumn("killed", ~F.col("_f")).drop("_s", "_f")


def served_identities(turns: DataFrame, g: Sequence[str] = ("model_id",)) -> DataFrame:
    """Per distinct served model string and fingerprint: turns and first and last date."""
    rows = F.array(
        F.struct(F.lit("model").alias("kind"), F.col("response_model").alias("value")),
        F.struct(F.lit("fingerprint").alias("kind"), F.col("fingerprint").alias("value")))
    long = turns.select(*g, "date", F.inline(rows)).where(F.col("value").isNotNull())
    return long.groupBy(*g, "kind", "value").agg(
        F.count(F.lit(1)).alias("turns"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"))


def model_turns(runs: DataFrame, g: Sequence[str] = ("model_id",)) -> DataFrame:
    """Model turns of a run log, one row per turn, from its event arrays."""
    turn = F.filter("events", lambda e: e["kind"] == "model_turn")
    text = lambda path: F.try_variant_get(F.col("_e.data"), path, "string")
    return runs.select(*g, F.explode(turn).alias("_e")).select(
        *g, text("$.response_model").alias("response_model"),
        text("$.fingerprint").alias("fingerprint"),
        F.substring(text("$.identity.request_date"), 1, 10).alias("date"))
