"""Transcripts: canonical hashes, features, redaction, divergence and accepted submissions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from trialstats.functions import draws as D
from trialstats.functions.text import redacted

CALL = "struct<id:string,name:string,arguments_text:string,malformed:boolean>"
FAULT = "struct<turn:int,call_index:int,tool:string,args_sha256:string,kind:string,executed:boolean>"
RESULT = (
    "struct<call_id:string,name:string,content:string,is_error:boolean,executed:boolean,"
    f"model_error:boolean,fault:{FAULT}>"
)
BLOCK = "struct<type:string,text:string>"
MESSAGE = (
    f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_results:array<{RESULT}>,"
    f"raw_blocks:array<{BLOCK}>>"
)
FANOUT = 256


def _json(text: Column) -> Column:
    return F.when(text.isNull(), "null").otherwise(D.json_string(text))


def _json_list(items: Column, one) -> Column:
    body = F.array_join(F.transform(F.coalesce(items, F.array()), one), ",")
    return F.concat(F.lit("["), body, F.lit("]"))


def canonical_message(m: Column) -> Column:
    """Canonical JSON of one message: role, content, calls, results and reasoning texts.

    Call ids are left out because servers draw them at random.
    """
    calls = _json_list(
        F.coalesce(m["tool_calls"], F.array().cast(f"array<{CALL}>")),
        lambda c: F.concat(F.lit("["), _json(c["name"]), F.lit(","), _json(c["arguments_text"]), F.lit("]")))
    results = _json_list(
        F.coalesce(m["tool_results"], F.array().cast(f"array<{RESULT}>")),
        lambda r: F.concat(F.lit("["), _json(r["name"]), F.lit(","), _json(r["content"]), F.lit("]")))
    thoughts = _json_list(
        F.filter(F.coalesce(m["raw_blocks"], F.array().cast(f"array<{BLOCK}>")),
                 lambda b: b["type"] == "reasoning_content"),
        lambda b: _json(b["text"]))
    return F.concat(
        F.lit("["), _json(m["role"]), F.lit(","), _json(m["content"]), F.lit(","), calls,
        F.lit(","), results, F.lit(","), thoughts, F.lit("]"),
    )


def canonical_hash(messages: Column) -> Column:
    """Hash of a transcript stored as one array of messages; no shuffle is involved."""
    return F.sha2(_json_list(messages, canonical_message), 256)


def tree_digest(
    messages: DataFrame, key: Sequence[str], order: str, digest: str, levels: int = 4
) -> DataFrame:
    """Digest of each transcript held as one row per message, of any length.

    Digests of up to 256 consecutive messages are hashed together, then those hashes, and so on, so
    no task ever collects a whole long transcript. ``order`` is a message number from 0.
    """
    out = messages.select(*key, F.col(order).cast("bigint").alias("_o"), F.col(digest).alias("_d"))
    for _ in range(levels):
        parts = F.sort_array(F.collect_list(F.struct("_o", "_d")))
        out = (
            out.groupBy(*key, F.floor(F.col("_o") / FANOUT).alias("_up")).agg(parts.alias("_p"))
            .withColumn("_p", F.when(
                F.size("_p") > F.size(F.array_distinct(F.transform("_p", lambda x: x["_o"]))), F.raise_error(F.lit("a message number repeats")).cast(
                    "array<struct<_o:bigint,_d:string>>")).otherwise(F.col("_p")))
            .select(*key, F.col("_up").alias("_o"),
                    F.sha2(F.array_join(F.transform("_p", lambda x: x["_d"]), ""), 256).alias("_d"))
        )
    whole = F.when(F.col("_o") == 0, F.col("_d")).otherwise(
        F.raise_error(F.lit("a message number is beyond the levels of the tree")).cast("string"))
    return out.select(*key, whole.alias("transcript_hash"))


def hash_groups(hashes: DataFrame, key: str) -> DataFrame:
    """Identical transcripts: how many carry each hash, and the first of them."""
    return hashes.groupBy("transcript_hash").agg(
        F.count(F.lit(1)).alias("transcripts"), F.min(key).alias(f"first_{key}"))


def redact_message(m: Column) -> Column:
    """User text and tool payloads become hash and length; system and assistant text stays."""
    keep = m["role"].isin("system", "assistant")
    masked = lambda c: F.to_json(redacted(c))
    return F.struct(
        m["role"].alias("role"),
        F.when(keep, m["content"]).otherwise(masked(m["content"])).alias("content"),
        F.transform(m["tool_calls"], lambda c: F.struct(
            c["id"].alias("id"), c["name"].alias("name"),
            masked(c["arguments_text"]).alias("arguments_text"), c["malformed"].alias("malformed"),
        )).alias("tool_calls"),
        F.transform(m["tool_results"], lambda r: F.struct(
            r["call_id"].alias("call_id"), r["name"].alias("name"),
            masked(r["content"]).alias("content"), r["is_error"].alias("is_error"),
            r["executed"].alias("executed"), r["model_error"].alias("model_error"),
            r["fault"].alias("fault"),
        )).alias("tool_results"),
        m["raw_blocks"].alias("raw_blocks"),
    )


def redact(transcripts: DataFrame) -> DataFrame:
    return transcripts.withColumn("messages", F.transform("messages", redact_message))


def run_features(transcripts: DataFrame) -> DataFrame:
    """Turns, calls, faults, first fault turn and recovery of each stored transcript."""
    results = F.flatten(F.filter(F.transform("messages", lambda m: m["tool_results"]),
                                 lambda r: r.isNotNull()))
    faults = F.filter(F.transform(results, lambda r: r["fault"]), lambda f: f.isNotNull())
    acc = accepted_submission(F.col("messages"))
    return transcripts.select(
        "run_id",
        F.size(F.filter("messages", lambda m: m["role"] == "assistant")).alias("turns"),
        F.size(results).alias("tool_calls"),
        F.size(faults).alias("n_faults"),
        F.array_min(F.transform(faults, lambda f: f["turn"])).alias("first_fault_turn"),
        F.when(F.size(faults) > 0, acc["found"]).alias("recovered"),
    )


def message_features(messages: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The same per-transcript features from one row per message."""
    return messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col(role) == "assistant").alias("turns"),
        F.count_if(F.col(role) == "user").alias("user_messages"),
        F.sum(F.char_length(text)).alias("characters"),
        F.max(turn).alias("last_turn"),
    )


def accepted_submission(messages: Column) -> Column:
    """First executed submit result without a model error, and the arguments its call carried."""
    calls_type = f"array<{CALL}>"
    start = F.struct(
        F.lit(False).alias("found"), F.lit(None).cast("string").alias("arguments_text"),
        F.array().cast(calls_type).alias("calls"),
    )

    def step(acc: Column, m: Column) -> Column:
        calls = F.when(m["role"] == "assistant", F.coalesce(m["tool_calls"], F.array().cast(calls_type))).otherwise(acc["calls"])
        good = F.filter(
            F.coalesce(m["tool_results"], F.array().cast(f"array<{RESULT}>")),
            lambda r: (r["name"] == "submit_record") & F.coalesce(r["executed"], F.lit(False))
            & ~F.coalesce(r["model_error"], F.lit(False)))
        hit = F.get(good, F.lit(0))
        mine = F.filter(calls, lambda c: c["id"] == hit["call_id"])
        text = F.try_element_at(mine, F.lit(-1))["arguments_text"]
        fresh = ~acc["found"] & (F.size(good) > 0)
        return F.struct(
            (acc["found"] | (F.size(good) > 0)).alias("found"),
            F.when(fresh, text).otherwise(acc["arguments_text"]).alias("arguments_text"),
            calls.alias("calls"),
        )

    done = F.aggregate(messages, start, step)
    return F.struct(done["found"].alias("found"), done["arguments_text"].alias("arguments_text"))


def first_divergence(a: Column, b: Column) -> Column:
    """First position at which two arrays differ, or the shorter length; null when equal."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).cast("int")


def message_divergence(a: DataFrame, b: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First differing message of each transcript pair, one row per message on both sides.

    The pair of sets meets on (transcript, message number), so a long transcript spreads over tasks.
    """
    left = a.select(key, order, F.col(value).alias("_a"), F.lit(True).alias("_ia"))
    right = b.select(key, order, F.col(value).alias("_b"), F.lit(True).alias("_ib"))
    both = left.join(right, [key, order], "full_outer")
    same = F.col("_ia").isNotNull() & F.col("_ib").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(key).agg(
        F.min(F.when(~same, F.col(order))).alias("first_divergence"),
        F.count("_ia").alias("original_messages"), F.count("_ib").alias("replay_messages"),
    ).withColumn("identical", F.col("first_divergence").isNull())


def replay_comparison(original: DataFrame, replay: DataFrame) -> DataFrame:
    """Verdict per replayed run from two transcript sets with outcomes."""
    rows = lambda: F.transform("messages", canonical_message)
    a = original.select("run_id", rows().alias("_a"), canonical_hash(F.col("messages")).alias("original_hash"),
                        F.col("outcome").alias("original_outcome"))
    b = replay.select("run_id", rows().alias("_b"), canonical_hash(F.col("messages")).alias("replay_hash"),
                      F.col("outcome").alias("replay_outcome"))
    t = a.join(b, "run_id").withColumn("first_divergence", first_divergence(F.col("_a"), F.col("_b")))
    detail = F.when(F.col("original_hash") == F.col("replay_hash"), "identical transcript").otherwise(
        F.format_string("transcripts diverge at message %d of %d (original) and %d (replay)",
                        "first_divergence", F.size("_a"), F.size("_b")))
    return t.select(
        "run_id", (F.col("original_hash") == F.col("replay_hash")).alias("identical"),
        "original_hash", "replay_hash", "first_divergence", "original_outcome", "replay_outcome",
        detail.alias("detail"),
    )


@F.pandas_udf(types.BooleanType())
def _holds_object(text: pd.Series, key: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def holds(t, k):
        at = -1 if t is None else t.find("{")
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(t, at)
            except ValueError:
                found = None
            if isinstance(found, dict) and k in found:
                return True
            at = t.find("{", at + 1)
        return False

    return pd.Series([holds(t, k) for t, k in zip(text, key)])


def holds_json_object(text: Column, key: str) -> Column:
    """Whether a text holds a JSON object with ``key``; texts without the key skip Python."""
    candidate = F.contains(text, F.lit("{")) & F.contains(text, F.lit(f'"{key}"'))
    return F.coalesce(_holds_object(F.when(candidate, text), F.lit(key)), F.lit(False))


def argument_text(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", "{}").otherwise(raw)


@F.pandas_udf(types.BooleanType())
def _is_object(text: pd.Series) -> pd.Series:
    def check(t):
        try:
            return isinstance(json.loads(t), dict)
        except (TypeError, ValueError):
            return False

    return text.map(check)


def malformed_call(raw: Column) -> Column:
    """Arguments that are no JSON object; anything not in braces is decided without Python."""
    text = argument_text(raw)
    braced = text.rlike(r"^[ \t\n\r]*\{(?s:.*)\}[ \t\n\r]*\z")
    return ~(braced & F.coalesce(_is_object(F.when(braced, text)), F.lit(False)))


FINISH = {
    # Wire finish reasons and their normal form.
    "stop": "end", "tool_calls": "tool_calls", "length": "max_tokens", "content_filter": "refusal",
}


def finish_reason(raw: Column) -> Column:
    out = F.lit("other")
    for wire, name in FINISH.items():
        out = F.when(raw == wire, name).otherwise(out)
    return out


def uncached_usage(prompt: Column, cached: Column, output: Column) -> Column:
    """Usage of a wire format whose prompt count includes the cached part."""
    cached = F.coalesce(cached, F.lit(0))
    return F.struct(
        F.greatest(F.coalesce(prompt, F.lit(0)) - cached, F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(output, F.lit(0)).cast("bigint").alias("output_tokens"),
        cached.cast("bigint").alias("cache_read_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_tokens"),
    )


def determinism_gate(executions: DataFrame) -> DataFrame:
    """Specs whose replays disagree: distinct hashes and where each one occurred.

    Executions are first reduced to one row per spec, hash and place; a spec has as many places as
    the design has regimes and replays.
    """
    place = F.concat_ws("/r", "regime", F.col("replay").cast("string"))
    per_hash = executions.groupBy("run_id", "transcript_hash").agg(
        F.sort_array(F.collect_set(place)).alias("places"))
    return (
        per_hash.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("distinct_transcripts"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(
                F.substring("transcript_hash", 1, 12), "places")))).alias("where"),
        ).where(F.col("distinct_transcripts") > 1)
    )


def gate_result(executions: DataFrame) -> DataFrame:
    per_spec = executions.groupBy("model_id", "run_id").agg(
        F.min("transcript_hash").alias("_a"), F.max("transcript_hash").alias("_b"),
        F.count(F.lit(1)).alias("_n"))
    split = F.count_if(F.col("_a") != F.col("_b"))
    return per_spec.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("specs"), F.sum("_n").alias("executions"),
        split.alias("disagreeing"), (split == 0).alias("passed"),
        F.when(split == 0, "deterministic_verified").otherwise("non_deterministic").alias("label"),
    )
