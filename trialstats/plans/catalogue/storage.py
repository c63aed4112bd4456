"""Round trips through the sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialstats.functions.jsonsafe import json_rows
from trialstats.operators import transcripts as X
from trialstats.operators import verify as VF
from trialstats.schema import RUN_FIELDS, normalize_runs, project_runs
from trialstats.session import checkpoint_dir
from trialstats.sources import committed as CT
from trialstats.sources import files as FS
from trialstats.sources import runlog as RL
from trialstats.sources.adapters import table


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_rows(spark, sf_dir, *more):
    """Orders as run rows; fields that an order has no value for are null."""
    key = F.col("o_orderkey")
    values = {
        "run_id": F.concat(F.lit("r"), key.cast("string")), "model_id": F.col("o_orderpriority"),
        "mix": F.when(key % 2 == 0, "A").otherwise("B"), "tools": key % 6 + 1, "fault_rate": (key % 6) / 10.0,
        "doc_id": F.col("o_custkey").cast("string"), "outcome": F.lit("submitted"),
        "success": F.col("o_totalprice") > 100000, "turns": key % 9, "score": (key % 4) / 4.0,
    }
    rows = table(spark, sf_dir, "orders")
    return rows.select(*(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in RUN_FIELDS), *more)


def runlog_round_trip(spark, sf_dir):
    path = _folder(spark, "log")
    RL.write_log(run_rows(spark, sf_dir), path)
    return normalize_runs(RL.read_runs(spark, path)).select(
        "run_id", "model_id", "mix", "phase", "tools", F.col("fault_pct").cast("int").alias("fault_pct"), "doc_id", "success", "turns", F.round("score", 6).alias("score"))


def known_run_ids(spark, sf_dir):
    path = _folder(spark, "log")
    RL.write_log(run_rows(spark, sf_dir), path)
    return RL.known_ids(spark, path)


def append_once(spark, sf_dir):
    """Two overlapping appends leave each id once."""
    path, rows = _folder(spark, "runs"), run_rows(spark, sf_dir)
    CT.append_runs(rows.where(F.col("tools") <= 3), path)
    out = CT.append_runs(rows.where((F.col("tools") >= 2) & (F.col("tools") <= 5)), path)
    return project_runs(out).groupBy("model_id", "mix").agg(
        F.count("*").alias("n_rows"), F.countDistinct("run_id").alias("ids"), F.sum("tools").alias("tools"))


def transcript_round_trip(spark, sf_dir):
    path = _folder(spark, "transcripts")
    talk = table(spark, sf_dir, "conversations")
    entry = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    chats = talk.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("_m"))
    message = "transform(_m, m -> named_struct('role', m.role, 'content', m.text))"
    FS.write_transcripts(chats.select(
        F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("run_id"),
        F.from_json(F.to_json(F.expr(message)), f"array<{X.MESSAGE}>").alias("messages")), path)
    rows = FS.explode_messages(FS.read_transcripts(spark, path, lines=True))
    return rows.select("run_id", F.col("pos").cast("int").alias("pos"), "role", F.sha2("content", 256).alias("sha256"))


def price_round_trip(spark, sf_dir):
    """A price document per priority's mean order value."""
    path = _folder(spark, "prices")
    means = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").cast("double").alias("p"))
    price = F.struct(F.col("p").alias("input"), (F.col("p") * 2).alias("output"), F.lit(0.5).alias("cache_read"), F.lit(0.25).alias("cache_write"))
    doc = means.agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderpriority"), price))).alias("models"))  # a row per priority
    doc.select(F.lit("usd_per_token").alias("unit"), "models").coalesce(1).write.json(path)
    return FS.read_prices(spark, path)


def manifest_round_trip(spark, sf_dir):
    """A written manifest against the documents after some were changed, lost or added."""
    path = _folder(spark, "manifest")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    FS.write_manifest(docs.where("doc_id % 7 <> 3").select("path", "sha256"), path)
    found = docs.where("doc_id % 5 <> 2").select("path", F.when(F.col("doc_id") % 11 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return VF.manifest_differences(FS.read_manifest(spark, path), found).where("status is not null").select("path", "status")


def cells_csv_text(spark, sf_dir):
    path = _folder(spark, "csv")
    cells = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 6 * 10).cast("int").alias("fault_pct"), F.col("o_orderkey").alias("tools"),
        (F.col("o_totalprice").cast("double") / 7).alias("p"), (F.col("o_totalprice").cast("double") * 1e9).alias("large"))
    FS.write_cells_csv(cells, path)
    return spark.read.option("header", True).schema("fault_pct int, tools bigint, p string, large string").csv(path)


def strict_json_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, float("inf")).when(k % 4 == 1, float("-inf")).when(k % 4 == 2, float("nan")).otherwise(0.5)
    return json_rows(table(spark, sf_dir, "orders").select(k.alias("k"), value.alias("v"), F.array(value).alias("a")))


QUERIES = {
    "runlog_round_trip": runlog_round_trip,
    "known_run_ids": known_run_ids,
    "append_once": append_once,
    "transcript_round_trip": transcript_round_trip,
    "price_round_trip": price_round_trip,
    "manifest_round_trip": manifest_round_trip,
    "cells_csv_text": cells_csv_text,
    "strict_json_rows": strict_json_rows,
}

ORACLES = {
    "runlog_round_trip": """
select 'r' || o_orderkey as run_id, o_orderpriority as model_id, case when o_orderkey % 2 = 0 then 'A' else 'B' end as mix,
  'sweep' as phase, cast(o_orderkey % 6 + 1 as int) as tools, cast(o_orderkey % 6 * 10 as int) as fault_pct,
  cast(o_custkey as varchar) as doc_id, o_totalprice > 100000 as success, cast(o_orderkey % 9 as int) as turns,
  (o_orderkey % 4) / 4.0::double as score from orders""",
    "known_run_ids": "select 'r' || o_orderkey as run_id from orders",
    "append_once": """
select o_orderpriority as model_id, case when o_orderkey % 2 = 0 then 'A' else 'B' end as mix, count(*) as n_rows,
  count(distinct o_orderkey) as ids, cast(sum(o_orderkey % 6 + 1) as bigint) as tools
from orders where o_orderkey % 6 + 1 <= 5 group by all""",
    "transcript_round_trip": """
select lpad(cast(conv_id as varchar), 8, '0') as run_id,
  cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as int) as pos, role, sha256(text) as sha256
from conversations""",
    "price_round_trip": """
select o_orderpriority as model_id, min(cast(o_totalprice as double)) as input, 2 * min(cast(o_totalprice as double)) as output,
  0.5::double as cache_read, 0.25::double as cache_write from orders group by 1""",
    "manifest_round_trip": """
with l as (select doc_id, sha256(text) as h from documents where doc_id % 7 <> 3),
f as (select doc_id, case when doc_id % 11 = 0 then sha256(cast(doc_id as varchar)) else sha256(text) end as h from documents where doc_id % 5 <> 2),
s as (select coalesce(l.doc_id, f.doc_id) as doc_id, case when f.doc_id is null then 'missing' when l.doc_id is null then 'unlisted'
  when l.h <> f.h then 'mismatched' end as status from l full join f on l.doc_id = f.doc_id)
select cast(doc_id as varchar) as path, status from s where status is not null""",
    "cells_csv_text": """
select cast(o_orderkey % 6 * 10 as int) as fault_pct, o_orderkey as tools, format('{:.10g}', cast(o_totalprice as double) / 7) as p,
  format('{:.10g}', cast(o_totalprice as double) * 1e9) as large from orders""",
    "strict_json_rows": """
with v as (select o_orderkey as k, case o_orderkey % 4 when 0 then '"inf"' when 1 then '"-inf"' when 2 then 'null' else '0.5' end as v from orders)
select '{"a":[' || v || '],"k":' || k || ',"v":' || v || '}' as value from v""",
}
