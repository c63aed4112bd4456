"""Row types of the run log and the projection every analysis starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT_EVENT = (
    "struct<turn:int,call_index:int,tool:string,args_sha256:string,kind:string,executed:boolean>"
)
RUN_FIELDS = (
    ("run_id", "string"), ("model_id", "string"), ("phase", "string"), ("mix", "string"),
    ("tools", "int"), ("fault_rate", "double"), ("index", "int"), ("doc_id", "string"),
    ("epoch", "int"), ("sample_seed", "bigint"), ("seed_offset", "int"),
    ("tool_list", "array<string>"), ("outcome", "string"), ("score", "double"),
    ("success", "boolean"), ("per_field", "map<string,double>"), ("turns", "int"),
    ("tool_calls", "int"), ("seconds", "double"),
    ("usage", "struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint>"),
    ("cost_usd", "double"), ("fault_events", f"array<{FAULT_EVENT}>"), ("first_fault_turn", "int"),
    ("recovered", "boolean"), ("submission", "variant"), ("response_models", "array<string>"),
    ("fingerprints", "array<string>"), ("identity", "variant"), ("transcript_path", "string"),
    ("events", "array<struct<kind:string,turn:int,data:variant>>"), ("transport_retries", "int"),
    ("malformed_calls", "int"), ("submission_attempted_in_text", "boolean"),
)
RUNS = ", ".join(f"{n} {t}" for n, t in RUN_FIELDS)
CORRUPT = "_corrupt_record"


def project_runs(df: DataFrame) -> DataFrame:
    """Exactly the row schema, in order; a missing column is an error."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in RUN_FIELDS])


def abort_cause(outcome: Column, events: Column) -> Column:
    """Cause of an aborted run: its first ``abort_cause`` event, ``unrecorded`` without one."""
    first = F.try_element_at(F.filter(events, lambda e: e["kind"] == "abort_cause"), F.lit(1))
    cause = F.try_variant_get(first["data"], "$.cause", "string")
    return F.when(outcome == "aborted_transport", F.coalesce(cause, F.lit("unrecorded")))


def classify_abort(error: Column, marker: str = "does not match the expected") -> Column:
    """Abort text to cause: the marker means the output could not be parsed."""
    return F.when(F.contains(error, F.lit(marker)), "unparseable_model_output").otherwise("transport")


def last_request_date(events: Column) -> Column:
    turns = F.filter(events, lambda e: e["kind"] == "model_turn")
    dates = F.transform(turns, lambda e: F.substring(
        F.try_variant_get(e["data"], "$.identity.request_date", "string"), 1, 10))
    return F.array_max(dates)


def percent(rate: Column) -> Column:
    """A fault rate in percent, as it stands: only digits that a binary fraction adds (beyond the ninth) are rounded off, so
    0.125 and 0.13 are two cells and 0.07 is 7.0."""
    return F.round(rate.cast("double") * 100, 9)


def normalize_runs(runs: DataFrame) -> DataFrame:
    """Analysis-ready columns of run rows, with the defaults for missing fields applied once."""
    events = F.coalesce(F.col("events"), F.array().cast(dict(RUN_FIELDS)["events"]))
    faults = F.coalesce(F.col("fault_events"), F.array().cast(dict(RUN_FIELDS)["fault_events"]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return runs.select(
        "run_id", "model_id", "mix", F.coalesce("phase", F.lit("sweep")).alias("phase"), "tools",
        percent(F.col("fault_rate")).alias("fault_pct"), "index", "doc_id",
        zero("epoch").alias("epoch"), "sample_seed", "outcome", "success", "score",
        (F.col("per_field")["total_amount"] == 1.0).alias("total_correct"),
        F.size(faults).alias("n_faults"),
        F.try_element_at(faults, F.lit(1))["kind"].alias("first_fault_kind"),
        "recovered", zero("turns").alias("turns"), F.col("seconds").cast("decimal(18,6)").alias("seconds"),
        zero("tool_calls").alias("tool_calls"), zero("malformed_calls").alias("malformed_calls"),
        abort_cause(F.col("outcome"), events).alias("abort_cause"),
        last_request_date(events).alias("request_date"),
        *[zero(f"usage.{u}_tokens").alias(f"{u}_tokens") for u in ("input", "output", "cache_read", "cache_write")],
    )
