"""Calibration, noise floor, cost, log quality, verification and synthetic data."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialstats.functions import draws as D
from trialstats.functions import text as T
from trialstats.operators import calibrate as CAL
from trialstats.operators import cells as C
from trialstats.operators import cost as M
from trialstats.operators import floor as NF
from trialstats.operators import logs as L
from trialstats.operators import shape as SH
from trialstats.operators import synth as SY
from trialstats.operators import verify as VF
from trialstats.plans.catalogue import sqltext as S
from trialstats.plans.catalogue.cells import rounded
from trialstats.rules import Design, Rules
from trialstats.sources.adapters import spread, table, trials

# Prices per token of three models.
PRICES = [
    ("m0", 4.0e-06, 2.0e-05, 2.0e-07, 5.0e-06),
    ("m1", 5.0e-06, 2.5e-05, 5.0e-07, 6.25e-06),
    ("m2", 1.0e-06, 5.0e-06, 1.0e-07, 1.25e-06),
]
TAUS = (0.8, 0.9, 0.7)


def prices(spark):
    return spark.createDataFrame(
        PRICES, "model_id string, input double, output double, cache_read double, cache_write double")


def _pilot(spark, sf_dir):
    """Fault rows stand for the difficulty levels of a pilot."""
    return trials(spark, sf_dir).withColumn("level", F.col("fault_pct"))


def rate_table_by_tau(spark, sf_dir):
    return rounded(CAL.rate_table(_pilot(spark, sf_dir), TAUS), "p", "lo", "hi")


def level_summary(spark, sf_dir):
    return rounded(CAL.level_summary(_pilot(spark, sf_dir), Rules(max_malformed_rate=0.33)), "mean_score", "malformed_call_rate")


def recommend_option(spark, sf_dir):
    rules = Rules(max_malformed_rate=0.325, band=(0.3, 0.6))
    runs = _pilot(spark, sf_dir)
    rates = CAL.rate_table(runs, TAUS, rules)
    return rounded(CAL.rank_options(rates, CAL.level_summary(runs, rules), rules), "distance")


def noise_floor(spark, sf_dir):
    """Epochs of a cell as reruns over its documents; the row with the largest run id counts."""
    key = [*C.G, *C.CELL, "epoch", "doc_id"]
    rows = trials(spark, sf_dir).groupBy(*key).agg(
        F.max(F.struct("run_id", "success", "turns")).alias("r")
    ).select(
        "model_id", F.when(F.col("mix") == "A", "fixed_seed").otherwise("hosted_block").alias("protocol"),
        "mix", "tools", "fault_pct", F.col("epoch").alias("rerun"), F.col("doc_id").alias("index"),
        "r.success", F.sha2(F.col("r.turns").cast("string"), 256).alias("transcript_hash"))
    out = NF.noise_floor(rows)
    return rounded(out, "mean_rate", "jitter_sd", "flip_rate", "flip_lo", "flip_hi", "binomial_sd", "phi",
                   "identity_rate")


def spend_by_model(spark, sf_dir):
    return rounded(M.spend(M.price_runs(trials(spark, sf_dir), prices(spark))), "spend_usd", places=6)


def spend_cutoff(spark, sf_dir):
    """Runs of each model, in run-id order, that start before a cap of 20 dollars stops them."""
    priced = M.price_runs(trials(spark, sf_dir).select(
        "run_id", "model_id", *[f"{u}_tokens" for u in M.USAGE]), prices(spark))
    out = M.spend_cutoff(priced, 20.0, "run_id")
    return rounded(out, "spent_usd", places=6)


def transport_streaks(spark, sf_dir):
    t = trials(spark, sf_dir).select("run_id", "model_id", "outcome", "abort_cause")
    return M.transport_streaks(t, "run_id").select(
        "model_id", "run_id", "after_abort")


def forecast(spark, sf_dir):
    t = trials(spark, sf_dir)
    counts = t.groupBy("model_id", F.col("mix").alias("phase")).agg((F.count(F.lit(1)) * 3).alias("runs"))
    return M.forecast(M.token_means(t), prices(spark), counts, 100.0)


def token_means(spark, sf_dir):
    df = M.token_means(trials(spark, sf_dir))
    return rounded(df, *[c for c in df.columns if c.startswith("mean_")])


def session_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rounded(L.stall_gaps(e, ["user_id"], "ts"), "gap_seconds", places=6).select(
        "event_id", "user_id", "gap_seconds")


def served_identities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    turns = e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.col("event_type").alias("response_model"), F.get_json_object("props", "$.k").alias("fingerprint"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return L.served_identities(turns)


def session_pairs(spark, sf_dir):
    """Every event starts a session; those with a value above 50 also finish one."""
    e = table(spark, sf_dir, "events")
    logged = F.array(
        F.struct(F.lit("start").alias("event"), F.col("value").alias("planned"), F.lit(None).cast("double").alias("completed")),
        F.struct(F.lit("finish").alias("event"), F.lit(None).cast("double").alias("planned"), F.col("value").alias("completed")))
    kept = F.when(F.col("value") > 50, logged).otherwise(F.slice(logged, 1, 1))
    rows = e.select(F.col("event_id").alias("started"), "event_type", F.inline(kept))
    pairs = L.session_pairs(rows, ["event_type", "started"])
    return pairs.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("killed").alias("killed"))


def shape_fit(spark, sf_dir):
    fits = SH.shape_fit(C.cell_table(trials(spark, sf_dir)))
    return rounded(fits.select(*C.G, "tools", "label", "aic_lin", "aic_log3"), "aic_lin", "aic_log3", places=4)


def _manifests(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    listed = docs.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), T.text_sha256(F.col("text")).alias("sha256"),
        "doc_id")
    u = D.unit("manifest", D.number("doc_id"))
    found = listed.where(u > 0.02).select(
        F.when(u > 0.98, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("path"),
        F.when((u > 0.5) & (u < 0.53), F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return listed.drop("doc_id"), found


def manifest_diff(spark, sf_dir):
    return VF.manifest_differences(*_manifests(spark, sf_dir))


def document_copies(spark, sf_dir):
    """Groups of identical texts by content hash."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.groupBy(T.text_sha256(F.col("text")).alias("sha256")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id"))


def tolerant_diff(spark, sf_dir):
    """Cell tables of the registered and the re-thresholded reading, compared by value."""
    t = trials(spark, sf_dir)
    columns = ["n", "k", "p"]
    a = C.cell_table(t)
    b = C.cell_table(t.withColumn("success", C.success_at(0.8, -0.1)))
    d = VF.table_differences(a, b, [*C.G, *C.CELL], columns)
    return d.select(*C.G, *C.CELL, "column").where(F.col("column").isin(columns))


def json_diff(spark, sf_dir):
    """Nested JSON made of each event against an edited copy."""
    e = spread(table(spark, sf_dir, "events"))
    k = F.col("event_id") % 5
    build = lambda value, flag, items: F.parse_json(F.concat(
        F.lit('{"props":'), F.col("props"), F.lit(',"value":'), value, F.lit(',"flag":'), flag,
        F.lit(',"items":['), items, F.lit("]}")))
    text = F.col("user_id").cast("string")
    three = F.concat_ws(",", text, text, text)
    a = e.select("event_id", build(text, F.lit("true"), three).alias("v"))
    b = e.select("event_id", build(
        F.when(k == 1, F.concat(text, F.lit(".0000000000001"))).when(k == 2, F.concat(text, F.lit(".5"))).otherwise(text),
        F.when(k == 3, F.lit("1")).otherwise(F.lit("true")),
        F.when(k == 4, F.concat_ws(",", text, text)).otherwise(three)).alias("v"))
    return VF.json_differences(a, b, ["event_id"], "v").select("event_id", "path", "status")


def remeasurement(spark, sf_dir):
    """Registered outcomes against the same runs at a higher threshold, per cell."""
    t = trials(spark, sf_dir)
    old = t.select("run_id", "success", F.sha2(F.col("turns").cast("string"), 256).alias("transcript_hash"))
    again = t.select(
        "run_id", "model_id", "mix", "tools", "fault_pct", C.success_at(0.8, 0.1).alias("success"),
        F.sha2((F.col("turns") + F.when(F.col("epoch") == 0, 1).otherwise(0)).cast("string"), 256).alias("transcript_hash"))
    return rounded(VF.remeasurement(old, again, ["model_id", "mix", "tools", "fault_pct"]), "lo", "hi")


def path_redaction(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    named = docs.select("doc_id", F.concat(
        F.lit("C:\\Users\\u"), F.col("doc_id").cast("string"), F.lit("\\x.txt /home/me/"), "source", F.lit(" "), "text").alias("text"))
    clean = VF.require_no_user_folder(VF.redact_paths(named))
    return clean.select("doc_id", F.sha2("text", 256).alias("sha256"))


def totals_reconciliation(spark, sf_dir):
    """Line items against order totals, in exact decimals."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    zero = F.lit(0).cast("decimal(18,2)")
    total = F.col("o_totalprice").cast("decimal(18,2)")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), total.alias("subtotal"), zero.alias("tax"),
        zero.alias("shipping"), total.alias("total_amount"))
    return SY.reconcile(li, o, "l_orderkey")


# ---- SQL ---------------------------------------------------------------------------------------

_PV = ", ".join(f"('{m}', {a}::double, {b}::double, {c}::double, {d}::double)" for m, a, b, c, d in PRICES)
COST = f"""
price as (select * from (values {_PV}) v(model_id, p1, p2, p3, p4)),
priced as (select t.*, cast(input_tokens*cast(p1 as decimal(18,12)) + output_tokens*cast(p2 as decimal(18,12))
   + cache_read_tokens*cast(p3 as decimal(18,12)) + cache_write_tokens*cast(p4 as decimal(18,12)) as decimal(38,12)) as cost
   from trials t join price using (model_id))"""


def _rate_sql(band=(0.15, 0.95)) -> str:
    lo, hi = S.wilson("k", "n")
    rows = " union all ".join(
        f"select model_id, fault_pct as level, {i} as tau_rank, {t}::double as tau, count(*) filter (where score >= {t}) as k, count(score) as n from trials group by all"
        for i, t in enumerate(TAUS))
    return f"""
rt as (select *, k::double/n as p, {lo} as lo, {hi} as hi, k::double/n between {band[0]} and {band[1]} as in_band from ({rows})),
lv as (select model_id, fault_pct as level, count(*) as runs, sum(cast(score as decimal(18,12)))::double/count(score) as mean_score,
         sum(malformed_calls)::double/sum(tool_calls) as malformed_call_rate from trials group by all)"""


_FLO, _FHI = S.wilson("flipped", "n_per_rerun")
_RLO, _RHI = S.newcombe("k", "n", "pk", "pn")
_MU = S.unit("'[\"manifest\",' || cast(doc_id as varchar) || ']'")
_DOCS = "(select *, sha256(replace(text, chr(13) || chr(10), chr(10))) as h from documents)"


QUERIES = {
    "rate_table_by_tau": rate_table_by_tau,
    "level_summary": level_summary,
    "recommend_option": recommend_option,
    "noise_floor": noise_floor,
    "spend_by_model": spend_by_model,
    "spend_cutoff": spend_cutoff,
    "transport_streaks": transport_streaks,
    "token_means": token_means,
    "forecast": forecast,
    "session_gaps": session_gaps,
    "served_identities": served_identities,
    "session_pairs": session_pairs,
    "shape_fit": shape_fit,
    "manifest_diff": manifest_diff,
    "document_copies": document_copies,
    "tolerant_diff": tolerant_diff,
    "json_diff": json_diff,
    "remeasurement": remeasurement,
    "path_redaction": path_redaction,
    "totals_reconciliation": totals_reconciliation,
}

ORACLES = {
    "rate_table_by_tau": f"""with {S.TRIALS}, {_rate_sql()}
select model_id, level, tau_rank, tau, k, n, {S.r("p", "p")}, {S.r("lo", "lo")}, {S.r("hi", "hi")}, in_band from rt""",
    "level_summary": f"""with {S.TRIALS}, {_rate_sql()}
select model_id, level, runs, {S.r("mean_score", "mean_score")}, {S.r("malformed_call_rate", "malformed_call_rate")},
       malformed_call_rate <= 0.33 as eligible from lv""",
    "recommend_option": f"""with {S.TRIALS}, {_rate_sql((0.3, 0.6))},
o as (select tau_rank, tau, level, count(*) filter (where in_band and malformed_call_rate <= 0.325) as replicates,
        sum(cast(abs(p - 0.45) as decimal(18,12)))::double as distance from rt join lv using (model_id, level) group by all)
select tau_rank, tau, level, replicates, {S.r("distance", "distance")},
       row_number() over (order by replicates desc, tau_rank, distance, level) as rank from o""",
    "noise_floor": f"""with {S.TRIALS},
rw as (select model_id, case when mix = 'A' then 'fixed_seed' else 'hosted_block' end as protocol, mix, tools, fault_pct,
         epoch as rerun, doc_id, arg_max(struct_pack(s := success), run_id).s as success, arg_max(turns, run_id) as h
       from trials group by all),
rr as (select model_id, protocol, mix, tools, fault_pct, rerun, count(*) as planned, count(*) filter (where success is null) as ab,
         count(*) filter (where success)::double/count(success) as rate from rw group by all),
r as (select model_id, protocol, mix, tools, fault_pct, count(*) as reruns, sum(ab)::bigint as aborted,
        max(planned) filter (where rerun = 0) as n_per_rerun, avg(rate) as mean_rate, coalesce(stddev_samp(rate), 0) as jitter_sd from rr group by all),
fl as (select model_id, protocol, mix, tools, fault_pct, count(*) filter (where x) as flipped from (
        select model_id, protocol, mix, tools, fault_pct, doc_id, count(distinct success) > 1 as x from rw group by all) group by all),
idn as (select model_id, protocol, mix, tools, fault_pct, avg(case when same then 1.0 else 0.0 end) as identity_rate from (
        select b.model_id, b.protocol, b.mix, b.tools, b.fault_pct, b.rerun, bool_and(coalesce(b.h = a.h, false)) as same
        from rw b left join rw a on a.model_id = b.model_id and a.mix = b.mix and a.tools = b.tools and a.fault_pct = b.fault_pct
          and a.doc_id = b.doc_id and a.rerun = 0 where b.rerun > 0 group by all) group by all),
j as (select *, case when protocol <> 'fixed_seed' then sqrt(mean_rate*(1-mean_rate)/n_per_rerun) end as bsd
      from r join fl using (model_id, protocol, mix, tools, fault_pct) left join idn using (model_id, protocol, mix, tools, fault_pct))
select model_id, protocol, mix, tools, fault_pct, reruns, aborted, n_per_rerun, {S.r("mean_rate", "mean_rate")}, {S.r("jitter_sd", "jitter_sd")},
  flipped, {S.r("coalesce(identity_rate, 1.0)", "identity_rate")}, {S.r("flipped::double/n_per_rerun", "flip_rate")}, {S.r(_FLO, "flip_lo")},
  {S.r(_FHI, "flip_hi")}, {S.r("bsd", "binomial_sd")}, {S.r("case when bsd > 0 then jitter_sd/bsd end", "phi")} from j""",
    "spend_by_model": f"""with {S.TRIALS}, {COST}
select model_id, count(*) as priced_runs, round(sum(cost)::double, 6) as spend_usd from priced group by all""",
    "spend_cutoff": f"""with {S.TRIALS}, {COST},
w as (select *, coalesce(sum(cost) over (partition by model_id order by run_id rows between unbounded preceding and 1 preceding), 0)::double as s,
        row_number() over (partition by model_id order by run_id) - 1 as c from priced),
v as (select *, s + case when c > 0 then s/c else 0 end > 0.95*20.0 as over from w),
f as (select model_id, min(run_id) filter (where over) as stopped_at, count(*) as runs from v group by all)
select f.model_id, stopped_at, runs, count(v.run_id) as started, round(sum(v.cost)::double, 6) as spent_usd
from f left join v on v.model_id = f.model_id and (stopped_at is null or v.run_id < stopped_at) group by all""",
    "transport_streaks": f"""with {S.TRIALS},
d as (select model_id, run_id, outcome = 'aborted_transport' and abort_cause <> 'unparseable_model_output' as down from trials),
p as (select *, lag(down) over (partition by model_id order by run_id) as prev from d)
select model_id, run_id, coalesce(prev, false) as after_abort from p where down""",
    "token_means": f"""with {S.TRIALS}, u as (select * from trials where outcome <> 'aborted_transport')
select model_id, tools, fault_pct, count(*) as runs, {", ".join(S.r(f"sum({u}_tokens)::double/count(*)", f"mean_{u}_tokens") for u in M.USAGE)},
  {S.r("sum(turns)::double/count(*)", "mean_turns")} from u group by grouping sets ((model_id, tools, fault_pct), (model_id))""",
    "forecast": f"""with {S.TRIALS}, {COST},
m as (select model_id, (sum(input_tokens)::double/count(*))*any_value(p1) + (sum(output_tokens)::double/count(*))*any_value(p2)
        + (sum(cache_read_tokens)::double/count(*))*any_value(p3) + (sum(cache_write_tokens)::double/count(*))*any_value(p4) as rate
      from trials join price using (model_id) where outcome <> 'aborted_transport' group by all),
c as (select model_id, mix as phase, count(*)*3 as runs from trials group by all),
p as (select model_id, phase, runs, round(runs*rate, 2) as usd from c join m using (model_id))
select *, round(sum(usd) over (partition by model_id), 2) as total_usd, round(sum(usd) over (partition by model_id), 2) <= 95.0 as within_cap from p""",
    "session_gaps": """with g as (select event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)))/1000000.0::double as s from events)
select event_id, user_id, round(s, 6) as gap_seconds from g where s > 1200""",
    "served_identities": """with t as (select 'm' || cast(user_id % 3 as varchar) as model_id, event_type, props->>'$.k' as k, strftime(ts, '%Y-%m-%d') as d from events),
l as (select model_id, d, 'model' as kind, event_type as value from t union all select model_id, d, 'fingerprint', k from t)
select model_id, kind, value, count(*) as turns, min(d) as first_date, max(d) as last_date from l where value is not null group by all""",
    "session_pairs": """select event_type, count(*) as sessions, count(*) filter (where not coalesce(value > 50, false)) as killed from events group by all""",
    "manifest_diff": f"""with l as (select source || '/' || cast(doc_id as varchar) as path, h, doc_id, {_MU} as u from {_DOCS}),
f as (select case when u > 0.98 then path || '.bak' else path end as path, case when u > 0.5 and u < 0.53 then sha256(h) else h end as h from l where u > 0.02)
select * from (select coalesce(l.path, f.path) as path, case when f.path is null then 'missing' when l.path is null then 'unlisted'
   when l.h <> f.h then 'mismatched' end as status from l full join f on l.path = f.path) where status is not null""",
    "document_copies": f"select h as sha256, count(*) as copies, min(doc_id) as first_doc_id from {_DOCS} group by all",
    "tolerant_diff": f"""with {S.TRIALS},
x as (select model_id, mix, tools, fault_pct, count(*) filter (where score >= 0.8) as k1, count(*) filter (where score >= 0.7) as k2
      from trials group by all having count(score) > 0)
select model_id, mix, tools, fault_pct, unnest(['k', 'p']) as "column" from x where k1 <> k2""",
    "json_diff": """select event_id, '$.value' as path, 'different' as status from events where event_id % 5 = 2
union all select event_id, '$.flag', 'different' from events where event_id % 5 = 3
union all select event_id, '$.items', 'different' from events where event_id % 5 = 4
union all select event_id, '$.items[2]', 'present on one side only' from events where event_id % 5 = 4""",
    "remeasurement": f"""with {S.TRIALS},
c as (select model_id, mix, tools, fault_pct, count(*) filter (where success) as pk, count(success) as pn,
        count(*) filter (where score >= 0.9) as k, count(score) as n, count(*) filter (where epoch <> 0) as same, count(*) as cmp from trials group by all)
select model_id, mix, tools, fault_pct, pk as published_k, pn as published_n, k, n, same as identical_transcripts, cmp as compared_transcripts,
  {S.r(_RLO, "lo")}, {S.r(_RHI, "hi")}, {_RLO} <= 0 and {_RHI} >= 0 as consistent from c""",
    "path_redaction": r"""select doc_id, sha256('~\x.txt ~/' || source || ' ' || text) as sha256 from documents""",
    "totals_reconciliation": """with s as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as a, count(*) as c from lineitem group by all)
select o_orderkey as l_orderkey, coalesce(c, 0) as items, coalesce(a, 0) as item_sum, cast(o_totalprice as decimal(18,2)) as subtotal,
  cast(o_totalprice as decimal(18,2)) as total_amount, coalesce(a, 0) <> cast(o_totalprice as decimal(18,2)) as subtotal_off, false as total_off
from orders left join s on s.l_orderkey = o_orderkey""",
}

