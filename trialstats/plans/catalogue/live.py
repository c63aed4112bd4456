"""Streaming jobs run to completion, and nested outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialstats.operators import cost as M
from trialstats.plans import analysis as A
from trialstats.plans import snapshot as SN
from trialstats.plans.catalogue import sqltext as S
from trialstats.plans.catalogue.reports import prices
from trialstats.plans.catalogue.storage import run_rows
from trialstats.schema import RUN_FIELDS
from trialstats.session import checkpoint_dir, cut
from trialstats.sources import committed as CT
from trialstats.sources import tail as TL
from trialstats.sources.adapters import table, trials, trials_path
from trialstats.streaming import jobs as J


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _trial_stream(spark, sf_dir):
    batch = trials(spark, sf_dir)
    return spark.readStream.schema(batch.schema).parquet(trials_path(spark, sf_dir))


def stream_cell_counts(spark, sf_dir):
    out = _folder(spark, "live")
    cells = J.live_cells(J.once_per_id(_trial_stream(spark, sf_dir)))
    J.write_latest(cells, out, out + "-state").awaitTermination()
    return J.latest(spark, out)


def stream_ingest(spark, sf_dir):
    """Orders as run rows in logs of seven writers, ingested twice: the logs grow between, each first part ends in a torn
    line, a third of the ids is logged in both parts with other scores, and every tenth order adds a damaged line."""
    log, out = _folder(spark, "growing"), _folder(spark, "ingested")
    key = F.col("o_orderkey")
    names = [n for n, _ in RUN_FIELDS if n != "score"]
    orders = run_rows(spark, sf_dir, "o_orderkey", (F.col("o_custkey") % 7).alias("file"))

    def part(number: int, kept):
        scored = orders.where(kept).select(*names, F.lit(number / 4).alias("score"), "o_orderkey", "file")
        line = F.concat(F.to_json(F.struct(*(n for n, _ in RUN_FIELDS))), F.lit("\n"))
        extra = F.when(key % 10 == 0, F.concat(F.lit("damaged "), key.cast("string"), F.lit("\n"))).otherwise("")
        return scored.select("file", key.alias("place"), F.concat(extra, line).alias("text"))

    def run(source: str) -> None:
        J.ingest(spark, source, out, out + "-state").awaitTermination()
        J.keep_damaged(spark, source, out + "-damaged", out + "-damaged-state").awaitTermination()

    first, second = part(1, key % 3 <= 1), cut(part(2, key % 3 >= 1))
    torn = second.groupBy("file").agg(F.min("place").alias("place"))
    head = second.join(torn, ["file", "place"]).select("file", F.lit(1 << 60).alias("place"), F.substring("text", 1, 30).alias("text"))
    TL.append_lines(first.unionByName(head), log)
    run(log)
    rest = second.join(torn.withColumn("_torn", F.lit(True)), ["file", "place"], "left")
    TL.append_lines(rest.select("file", "place", F.when(F.col("_torn"), F.expr("substring(text, 31)")).otherwise(F.col("text")).alias("text")), log)
    run(log)
    good = CT.read_table(spark, out).select("run_id", "model_id", "tools", "score", F.lit(False).alias("damaged"))
    bad = spark.read.parquet(out + "-damaged").select(F.col("value").alias("run_id"), F.lit(True).alias("damaged"))
    return good.unionByName(bad, allowMissingColumns=True)


def _closed_sessions(spark, sf_dir):
    """Events and the closed activity spans per user that a stream of them wrote. The source is a copy of the events table."""
    source, out = _folder(spark, "events"), _folder(spark, "spans")
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    spans = J.activity_sessions(stream, ["user_id"], "ts")
    J_out = spans.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    J_out.awaitTermination()
    return spark.read.parquet(source), spark.read.parquet(out)


_SPAN = ("user_id", "unix_micros(first) as first_us", "unix_micros(closes) as closes_us", "runs")


def stream_sessions(spark, sf_dir):
    """Closed activity spans per user; ``stream_sessions_all`` has the open ones too."""
    return _closed_sessions(spark, sf_dir)[1].selectExpr(*_SPAN)


def stream_sessions_all(spark, sf_dir):
    """All activity spans per user: the closed ones of the stream and, as a second output, those still open at its end."""
    events, closed = _closed_sessions(spark, sf_dir)
    out = _folder(spark, "open-spans")
    J.open_sessions(events, closed, ["user_id"], "ts").write.parquet(out)
    return closed.selectExpr(*_SPAN, "true as closed").unionByName(
        spark.read.parquet(out).selectExpr(*_SPAN, "false as closed"))


def stream_spend_alerts(spark, sf_dir):
    out = _folder(spark, "alerts")
    p = prices(spark)
    priced = M.price_runs(_trial_stream(spark, sf_dir), p)
    J.spend_alerts(priced, 1.0, out, out + "-state").awaitTermination()
    return spark.read.parquet(out).groupBy("model_id").agg(
        F.round(F.max("spend_usd").cast("double"), 6).alias("spend_usd"))


def stream_spend_stops(spark, sf_dir):
    """The runs that the stop rule refuses first, from priced trials that arrive in three parts by the order of their ids."""
    source, out = _folder(spark, "priced"), _folder(spark, "stops")
    priced = M.price_runs(trials(spark, sf_dir).select("run_id", "model_id", *[f"{u}_tokens" for u in M.USAGE]), prices(spark))
    priced = priced.select("run_id", "model_id", "cost_usd")
    for low, high in (("", "5"), ("5", "a"), ("a", "~")):
        priced.where((F.col("run_id") >= low) & (F.col("run_id") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(priced.schema).parquet(source)
        J.spend_stops(stream, 20.0, out, out + "-state").awaitTermination()
    stops = spark.read.parquet(out).drop("batch")
    return stops.withColumn("spent_usd", F.round("spent_usd", 6))


def snapshot_entries(spark, sf_dir):
    tables = A.analyze(trials(spark, sf_dir), "s1")
    return SN.entry_json(SN.model_entries(tables, "s1", "defaults"))


from trialstats.plans.catalogue.reports import COST  # noqa: E402

QUERIES = {
    "stream_cell_counts": stream_cell_counts,
    "stream_ingest": stream_ingest,
    "stream_sessions": stream_sessions,
    "stream_sessions_all": stream_sessions_all,
    "stream_spend_alerts": stream_spend_alerts,
    "stream_spend_stops": stream_spend_stops,
    "snapshot_entries": snapshot_entries,
}

ORACLES = {
    "stream_cell_counts": f"""with {S.TRIALS}
select model_id, mix, tools, fault_pct, count(success) as n, count(*) filter (where success) as k,
       count(*) filter (where success is null) as aborted from trials group by all""",
    "stream_ingest": """
select 'r' || o_orderkey as run_id, o_orderpriority as model_id, cast(o_orderkey % 6 + 1 as int) as tools,
  case when o_orderkey % 3 = 2 then 0.5 else 0.25 end::double as score, false as damaged from orders
union all
select 'damaged ' || o_orderkey, null, null, null, true from orders, range(2) t(part)
where o_orderkey % 10 = 0 and (o_orderkey % 3 = 1 or (o_orderkey % 3 = 0 and part = 0) or (o_orderkey % 3 = 2 and part = 1))""",
    # a span is final once the watermark (last event minus one hour) has passed its end
    "stream_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 20 minutes then 1 else 0 end as brk
   from events window w as (partition by user_id order by ts)),
s as (select *, sum(brk) over (partition by user_id order by ts) as sid from g),
p as (select user_id, sid, min(ts) as f, max(ts) + interval 20 minutes as c, count(*) as runs from s group by all)
select user_id, epoch_us(f) as first_us, epoch_us(c) as closes_us, runs from p
where c <= (select max(ts) - interval 1 hour from events)""",
    "stream_sessions_all": """with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 20 minutes then 1 else 0 end as brk
   from events window w as (partition by user_id order by ts)),
s as (select *, sum(brk) over (partition by user_id order by ts) as sid from g),
p as (select user_id, sid, min(ts) as f, max(ts) + interval 20 minutes as c, count(*) as runs from s group by all)
select user_id, epoch_us(f) as first_us, epoch_us(c) as closes_us, runs,
       c <= (select max(ts) - interval 1 hour from events) as closed from p""",
    "stream_spend_stops": f"""with {S.TRIALS}, {COST},
w as (select *, coalesce(sum(cost) over (partition by model_id order by run_id rows between unbounded preceding and 1 preceding), 0)::double as s,
        row_number() over (partition by model_id order by run_id) - 1 as c from priced),
v as (select * from w where s + case when c > 0 then s/c else 0 end > 0.95*20.0)
select model_id, min(run_id) as stopped_at, arg_min(c, run_id) as started, round(arg_min(s, run_id), 6) as spent_usd from v group by 1""",
    "stream_spend_alerts": f"""with {S.TRIALS}, {COST}
select model_id, round(sum(cost)::double, 6) as spend_usd from priced group by all having sum(cost) > 0.95""",
}
