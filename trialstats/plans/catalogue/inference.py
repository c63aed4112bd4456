"""Regression, bootstrap, recovery and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialstats.operators import boot as B
from trialstats.operators import cells as C
from trialstats.operators import counts as K
from trialstats.operators import fit as FT
from trialstats.operators import recovery as R
from trialstats.operators import sparse as SP
from trialstats.operators import verdict as V
from trialstats.plans import analysis as A
from trialstats.plans.catalogue import sqltext as S
from trialstats.plans.catalogue.cells import rounded
from trialstats.plans.catalogue.newtonsql import newton
from trialstats.session import cut
from trialstats.sources.adapters import trials

SNAPSHOT = "s1"
DRAWS = 2000
GK = "model_id, mix"


def p1_counts(spark, sf_dir):
    return K.document_counts(trials(spark, sf_dir)).drop("score_sum", "score_n")


def _placed(spark, sf_dir):
    counts = K.document_counts(trials(spark, sf_dir))
    return B.placed_documents(K.wide_counts(counts, K.grid()))


def document_positions(spark, sf_dir):
    return _placed(spark, sf_dir).select(*C.G, "doc_id", "pos", "size")


def boot_multiplicities(spark, sf_dir):
    """Draws and drawn documents per model, multiplicity and population size."""
    sizes = _placed(spark, sf_dir).select("model_id", "size").distinct()
    w = B.multiplicities(B.resample_index(sizes, DRAWS, SNAPSHOT, ["p1"]))
    return w.groupBy("model_id", "size", "w").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("draw").alias("draws"),
        F.sum("pos").alias("pos_sum"),
    )


def boot_cell_counts(spark, sf_dir):
    cells = K.grid()
    sums = B.draw_sums(_placed(spark, sf_dir), K.count_columns(cells), DRAWS, SNAPSHOT, ["p1"])
    label = [
        F.struct(F.lit(t).alias("tools"), F.lit(f).alias("fault_pct"), F.col(f"s_{i}").alias("s"),
                 F.col(f"n_{i}").alias("n"))
        for i, (t, f) in enumerate(cells)
    ]
    return sums.select(*C.G, "draw", F.inline(F.array(*label))).where(F.col("n") > 0)


def p1_fit(spark, sf_dir):
    fit = SP.fit(cut(K.document_counts(trials(spark, sf_dir)))).drop("reason")
    return rounded(fit, *[c for c in fit.columns if c.split("_")[0] in (*FT.COEFS, "peak")], places=6)


def fit_refusals(spark, sf_dir):
    """Status and reason of groups that cannot be estimated: one outcome, one document, too few cells."""
    t = trials(spark, sf_dir)
    first = F.lit(t.agg(F.min("doc_id")).scalar())
    cuts = {
        "successes": F.col("success"), "failures": ~F.col("success"), "one-document": F.col("doc_id") == first,
        "two-cells": F.col("tools").isin(2, 3) & (F.col("fault_pct") == 0),
        "one-column": (F.col("tools") == 4),
    }
    label = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cuts.items()))))
    runs = t.withColumn("_cut", label).withColumn("mix", F.concat_ws("/", "mix", "_cut"))
    return SP.estimate(cut(K.document_counts(runs))).select("model_id", "mix", "n_documents", "n_runs", "status", "reason")


def fractional_logit(spark, sf_dir):
    fit = SP.fractional_logit(cut(K.score_counts(trials(spark, sf_dir)))).drop("reason")
    return rounded(fit, *[c for c in fit.columns if c.split("_")[0] in (*FT.COEFS, "peak")], places=6)


def fractional_refusals(spark, sf_dir):
    """Status and reason of groups whose score tells nothing: constant, unknown, of one document.

    The runs are counted once; the three readings are made of the counts.
    """
    t = trials(spark, sf_dir)
    first = F.lit(t.agg(F.min("doc_id")).scalar())
    c = K.score_counts(t)
    half, none = F.lit(0.5).cast(c.schema["score_lo"].dataType), F.lit(None).cast(c.schema["score_lo"].dataType)
    reading = lambda cut_, s, n, lo, hi: F.struct(
        F.lit(cut_).alias("_cut"), s.alias("s"), n.alias("n"), lo.alias("score_lo"), hi.alias("score_hi"))
    readings = F.array_compact(F.array(
        reading("constant", F.col("runs") * 0.5, F.col("runs"), half, half),
        reading("unscored", F.lit(0.0), F.lit(0).cast("bigint"), none, none),
        F.when(F.col("doc_id") == first, reading("one-document", F.col("s"), F.col("n"), F.col("score_lo"), F.col("score_hi")))))
    counts = c.select("model_id", "mix", "doc_id", *C.CELL, F.inline(readings)).withColumn("mix", F.concat_ws("/", "mix", "_cut"))
    out = SP.fractional_logit(cut(counts.drop("_cut")))
    return out.select("model_id", "mix", "n_documents", "n_runs", "status", "reason", "const", "peak")


#: the declared cells, and three that no run has
ASKED = [*K.grid(), (4, 35), (4, 12.5), (9, 0)]


def fitted_surface(spark, sf_dir):
    out = SP.surface(cut(K.document_counts(trials(spark, sf_dir))), ASKED)
    return rounded(out, *[c for c, t in out.dtypes if t == "double" and c != "fault_pct"], places=6)


def p1_bootstrap(spark, sf_dir):
    p1 = A.first_decision(trials(spark, sf_dir), SNAPSHOT)
    names = [c for c in p1.boot.columns if c.startswith("boot_") or c.endswith("_fraction")]
    return rounded(p1.boot, *names, places=6)


def p1_verdict(spark, sf_dir):
    v = A.first_decision(trials(spark, sf_dir), SNAPSHOT).verdict
    passed = F.transform("conditions", lambda c: F.concat_ws("=", c["name"], c["passed"].cast("string")))
    v = v.withColumn("conditions", F.array_join(passed, ";"))
    return rounded(v, "peak", "boot_peak_lo", "boot_peak_hi", "drop_points", "drop_lo", "drop_hi",
                   places=6)


def sensitivity_verdicts(spark, sf_dir):
    v = A.sensitivity(trials(spark, sf_dir), SNAPSHOT)
    v = v.select("reading", *C.G, "verdict", "estimator", "peak", "boot_peak_lo", "boot_peak_hi",
                 "drop_points", "registered", "differs")
    return rounded(v, "peak", "boot_peak_lo", "boot_peak_hi", "drop_points", places=6)


def population_counts(spark, sf_dir):
    return R.population_counts(trials(spark, sf_dir))


def control_pairs(spark, sf_dir):
    return rounded(R.control_pairs(trials(spark, sf_dir)), "extra_seconds", places=6)


def recovery_by_kind_and_row(spark, sf_dir):
    return rounded(R.breakdowns(R.pair_sums(trials(spark, sf_dir))), "mean_extra_turns")


def recovery_means(spark, sf_dir):
    t = trials(spark, sf_dir)
    df = R.recovery_means(R.pair_sums(t), R.population_counts(t))
    return rounded(df, "r", "net", "seconds_mean")


def p2_bootstrap(spark, sf_dir):
    df = R.recovery_intervals(R.pair_sums(trials(spark, sf_dir)), SNAPSHOT)
    return rounded(df, "lo", "hi", "net_lo", "net_hi")


def p2_verdict(spark, sf_dir):
    table = R.recovery_table(trials(spark, sf_dir), SNAPSHOT)
    return rounded(V.verdict_p2(table).drop("conditions"), "r", "lo", "hi")


def statement_lines(spark, sf_dir):
    return A.analyze(trials(spark, sf_dir), SNAPSHOT)["statements"]


def drop_reading(spark, sf_dir):
    p1 = A.first_decision(trials(spark, sf_dir), SNAPSHOT).verdict
    return rounded(V.drop_reading(p1), "drop_points", "drop_lo", "drop_hi", places=6)


# ---- SQL ---------------------------------------------------------------------------------------

SCOPE = "tools >= 2 and success is not null and outcome <> 'aborted_transport'"
# ``trials_r`` is the trial table fanned out over readings; most statements use one reading.
COUNTS = f"""
cnt as (select {GK}, doc_id, tools, fault_pct, count(*) filter (where success) as s, count(*) as n
        from trials where {SCOPE} group by all),
docs as (select distinct {GK}, doc_id from cnt),
placed as (select *, row_number() over (partition by {GK} order by doc_id) - 1 as pos,
                  count(*) over (partition by {GK}) as size from docs),
tot as (select {GK}, tools - 4.0::double as tc, fault_pct/100.0::double as f, sum(s) as s, sum(n) as n
        from cnt group by all)"""


def _index(statistics: str, source: str, name: str = "idx") -> str:
    payload = S.u32(
        f"'[\"boot\",\"{SNAPSHOT}\",\"' || model_id || '\",\"' || statistic || '\",' || cast(draw as varchar) || ',' || cast(j as varchar) || ']'"
    )
    return f"""
{name} as (select model_id, size, statistic, draw, j, {payload} % size as pos
        from (select *, unnest(range(size)) as j from
             (select *, unnest(range({DRAWS})) as draw from
             (select *, unnest({statistics}) as statistic from
             (select distinct model_id, size from {source})))))"""


def _limits(value: str, name: str) -> str:
    """(k+1)-th value from each end of a sorted list of draws."""
    v = f"list_sort(list({value}) filter (where ({value}) is not null))"
    k = f"least(floor(len({v})*0.05::double/2 + 1e-9::double)::bigint, (len({v})-1)//2)"
    return (
        f"round({v}[({k}) + 1], 6) as {name}_lo, round({v}[len({v}) - ({k})], 6) as {name}_hi"
    )


BOOT_COUNTS = f"""{_index("['p1']", "placed")},
boot as (select c.model_id, c.mix, i.draw, c.tools, c.fault_pct, sum(c.s) as s, sum(c.n) as n,
                c.tools - 4.0::double as tc, c.fault_pct/100.0::double as f
         from idx i join placed p on i.model_id = p.model_id and i.size = p.size and i.pos = p.pos
         join cnt c on c.model_id = p.model_id and c.mix = p.mix and c.doc_id = p.doc_id
         group by all)"""

FIT = newton("fit", "tot", GK)
BFIT = newton("bfit", "boot", f"{GK}, draw")

ROBUST = """
pc as (select c.model_id, c.mix, c.doc_id, tools - 4.0::double as tc, fault_pct/100.0::double as f,
              n, s - n*p as e, n*p*(1.0::double-p) as w
       from (select c.*, 1.0::double/(1.0::double+exp(-(b0+b1*(tools-4)+b2*(tools-4)*(tools-4)
                       +b3*fault_pct/100.0::double))) as p
             from cnt c join fit b on c.model_id = b.model_id and c.mix = b.mix) c),
u as (select model_id, mix, doc_id, sum(e) as u0, sum(tc*e) as u1, sum(tc*tc*e) as u2, sum(f*e) as u3
      from pc group by all),
size as (select model_id, mix, count(distinct doc_id) as g, sum(n) as nn,
         {A} from pc group by all)"""


def _robust() -> str:
    """Cluster-robust standard errors: for each coefficient j, se^2 = sum_d (h_j . u_d)^2 * scale
    with h_j the j-th row of the inverse information."""
    from trialstats.plans.catalogue.newtonsql import UPPER, X, solve

    info = ", ".join(f"sum(w*({X[i]})*({X[j]})) as a{i}{j}" for i, j in UPPER)
    parts = [ROBUST.replace("{A}", info)]
    for j in range(4):
        unit = ", ".join(f"{1.0 if i == j else 0.0}::double as r{i}" for i in range(4))
        a = ", ".join(f"a{p}{q}" for p, q in UPPER)
        row = solve(f"select model_id, mix, {a}, {unit} from size", "model_id, mix")
        parts.append(
            f"h{j} as (select model_id, mix, d0, d1, d2, d3 from ({row})),\n"
            f"v{j} as (select u.model_id, u.mix, sum(power(d0*u0+d1*u1+d2*u2+d3*u3, 2)) as m from u "
            f"join h{j} h on u.model_id = h.model_id and u.mix = h.mix group by all)"
        )
    scale = "(g/(g-1.0::double))*((nn-1.0::double)/(nn-4.0::double))"
    se = ", ".join(f"sqrt(v{j}.m*{scale}) as e{j}" for j in range(4))
    joins = " ".join(f"join v{j} on v{j}.model_id = s.model_id and v{j}.mix = s.mix" for j in range(4))
    parts.append(
        f"wald as (select b.*, s.g as n_documents, s.nn as n_runs, {se} from fit b join size s on "
        f"b.model_id = s.model_id and b.mix = s.mix {joins})"
    )
    return ",\n".join(parts)


COEF = list(enumerate(("const", "tc", "tc2", "f")))


def _fit_select(status: str) -> str:
    coefs = ", ".join(
        f"round(b{j}, 6) as \"{n}\", round(b{j} - {S.Z}*e{j}, 6) as {n}_lo, round(b{j} + {S.Z}*e{j}, 6) as {n}_hi"
        for j, n in COEF
    )
    return f"""select model_id, mix, n_documents, n_runs::bigint as n_runs, '{status}' as status, {coefs},
       round(case when b2 < 0 then 4.0 - b1/(2.0*b2) end, 6) as peak from wald"""


def _drop_column(b1: str, b2: str) -> str:
    return f"(case when {b2} < 0 then floor(greatest(2.0, least(6.0, 4.0 - {b1}/(2.0*{b2}))) + 0.5) else 2 end)::integer"


PEAKDRAW = "case when b2 < 0 then 4.0 - b1/(2.0*b2) when b1 > 0 then 'inf'::double else '-inf'::double end"

BOOT_TABLE = f"""{BFIT},
col as (select model_id, mix, {_drop_column("b1", "b2")} as drop_column from fit),
bdrop as (select b.model_id, b.mix, b.draw,
            100.0*(max(s::double/n) filter (where tools = drop_column) - max(s::double/n) filter (where tools = 6)) as d
          from boot b join col c on b.model_id = c.model_id and b.mix = c.mix where fault_pct = 0 group by all),
bt as (select b.model_id, b.mix, count(*) as draws, {_limits(PEAKDRAW, "boot_peak")},
         {_limits("b0", "boot_const")}, {_limits("b1", "boot_tc")}, {_limits("b2", "boot_tc2")},
         {_limits("b3", "boot_f")}, {_limits("d", "boot_drop")},
         round(count(*) filter (where b2 < 0)/count(*)::double, 6) as b2_negative_fraction,
         0.0::double as failed_fraction, 0.0::double as firth_fraction
       from bfit b join bdrop d on b.model_id = d.model_id and b.mix = d.mix and b.draw = d.draw group by all)"""


def _verdict_tables() -> str:
    lo, hi = S.newcombe("ak", "an", "bk", "bn")
    return f"""{S.CELLS},
dr as (select c.model_id, c.mix, c.drop_column, a.k as ak, a.n as an, z.k as bk, z.n as bn
       from col c left join cells a on a.model_id = c.model_id and a.mix = c.mix and a.fault_pct = 0
              and a.tools = c.drop_column and c.drop_column <> 6
       left join cells z on z.model_id = c.model_id and z.mix = c.mix and z.fault_pct = 0 and z.tools = 6),
dd as (select model_id, mix, drop_column, 100.0*(ak::double/an - bk::double/bn) as drop_points,
              100.0*{lo} as drop_lo, 100.0*{hi} as drop_hi from dr),
vt as (select w.model_id, w.mix, w.b1, w.b2, w.b3, w.b2 - {S.Z}*w.e2 as b2_lo, w.b2 + {S.Z}*w.e2 as b2_hi,
         w.b3 - {S.Z}*w.e3 as b3_lo, w.b3 + {S.Z}*w.e3 as b3_hi, bt.boot_peak_lo, bt.boot_peak_hi,
         dd.drop_column, dd.drop_points, dd.drop_lo, dd.drop_hi,
         case when w.b2 < 0 then 4.0 - w.b1/(2.0*w.b2) end as peak
       from wald w join bt on w.model_id = bt.model_id and w.mix = bt.mix
       join dd on w.model_id = dd.model_id and w.mix = dd.mix),
vc as (select *, b3 <= 0 or (b3_lo <= 0 and b3_hi >= 0) as cap_ok, b2 < 0 and b2_hi < 0 as c1,
         boot_peak_lo >= 2 and boot_peak_hi <= 6 as c2, coalesce(peak is not null and drop_lo > 0, false) as c3,
         b2_lo > 0 or boot_peak_hi < 2 or boot_peak_lo > 6 or coalesce(drop_hi < 15, false) as restr,
         coalesce(b2_lo <= 0 and b2_hi >= 0 and drop_lo <= 0 and drop_hi >= 0 and drop_lo <= 15 and drop_hi >= 15, false) as swal
       from vt),
verdict as (select *, case when not cap_ok then 'blocked' when c1 and c2 and c3 then 'survives'
                when restr then 'restricted' else 'below_resolution' end as verdict from vc)"""


P1_CTES = f"with recursive {S.TRIALS}, {COUNTS}, {FIT}, {_robust()}, {BOOT_COUNTS}, {BOOT_TABLE}, {_verdict_tables()}"

# The same decision under other readings of success: the trial table is replaced, nothing else.
_READINGS = {
    "registered": ("success", "score"),
    "tau-0.1": ("case when score is null then success else score >= 0.7 end", "score"),
    "tau+0.1": ("case when score is null then success else score >= 0.9 end", "score"),
    "unparseable_as_failure": (
        "case when abort_cause = 'unparseable_model_output' then false else success end",
        "case when abort_cause = 'unparseable_model_output' then 0.0::double else score end",
    ),
}


def _reading_sql(name: str) -> str:
    success, score = _READINGS[name]
    base = S.TRIALS.replace("trials as (", "trials_base as (")
    ctes = P1_CTES.replace(
        S.TRIALS,
        f"{base},\ntrials as (select * replace ({success} as success, {score} as score) from trials_base)",
    )
    return f"""select '{name}' as reading, * from ({ctes}
select model_id, mix, verdict, 'mle' as estimator, round(case when cap_ok then peak end, 6) as peak,
       case when cap_ok then boot_peak_lo end as boot_peak_lo, case when cap_ok then boot_peak_hi end as boot_peak_hi,
       round(case when cap_ok then drop_points end, 6) as drop_points from verdict)"""


SENSITIVITY = f"""with v as ({" union all ".join(_reading_sql(n) for n in _READINGS)})
select v.*, r.verdict as registered, v.verdict <> r.verdict as differs
from v join v r on r.model_id = v.model_id and r.mix = v.mix and r.reading = 'registered'"""


PAIRS = f"""
ctl as (select {GK}, tools, doc_id, epoch, max(run_id) as control_id, arg_max(turns, run_id) as control_turns,
               arg_max(seconds, run_id) as control_seconds
        from trials where fault_pct = 0 and success is not null group by all),
pairs as (select t.*, c.control_id, t.turns - c.control_turns as extra_turns,
                 t.seconds - c.control_seconds as extra_seconds
          from trials t join ctl c using (model_id, mix, tools, doc_id, epoch)
          where tools >= 2 and n_faults > 0 and recovered)"""
POP = f"""
pop as (select {GK}, count(*) filter (where f) as faulted, count(*) filter (where f and recovered) as recovered
        from (select *, tools >= 2 and success is not null and n_faults > 0 as f from trials) group by all)"""
P2_BOOT = f"""
dsum as (select {GK}, doc_id, count(*) as pairs, sum(extra_turns) as extra, sum(extra_turns - n_faults) as net
         from pairs group by all),
dpos as (select *, row_number() over (partition by {GK} order by doc_id) - 1 as pos,
                count(*) over (partition by {GK}) as size from dsum),
{_index("['p2','p2_net']", "dpos", "idx2")},
bs as (select d.model_id, d.mix, i.statistic, i.draw,
         case when i.statistic = 'p2' then sum(extra)::double/sum(pairs) else sum(net)::double/sum(pairs) end as v
       from idx2 i join dpos d on i.model_id = d.model_id and i.size = d.size and i.pos = d.pos
       group by d.model_id, d.mix, i.statistic, i.draw),
bo as (select model_id, mix, statistic, v, row_number() over (partition by model_id, mix, statistic order by v) as rn,
              count(*) over (partition by model_id, mix, statistic) as b from bs),
p2b as (select model_id, mix,
   max(v) filter (where statistic = 'p2' and rn = 51) as lo, max(v) filter (where statistic = 'p2' and rn = b - 50) as hi,
   max(v) filter (where statistic = 'p2_net' and rn = 51) as net_lo,
   max(v) filter (where statistic = 'p2_net' and rn = b - 50) as net_hi from bo group by all)"""

QUERIES = {
    "p1_counts": p1_counts,
    "document_positions": document_positions,
    "boot_multiplicities": boot_multiplicities,
    "boot_cell_counts": boot_cell_counts,
    "p1_fit": p1_fit,
    "fit_refusals": fit_refusals,
    "fractional_logit": fractional_logit,
    "fractional_refusals": fractional_refusals,
    "fitted_surface": fitted_surface,
    "p1_bootstrap": p1_bootstrap,
    "p1_verdict": p1_verdict,
    "sensitivity_verdicts": sensitivity_verdicts,
    "population_counts": population_counts,
    "control_pairs": control_pairs,
    "recovery_by_kind_and_row": recovery_by_kind_and_row,
    "recovery_means": recovery_means,
    "p2_bootstrap": p2_bootstrap,
    "p2_verdict": p2_verdict,
    "statement_lines": statement_lines,
    "drop_reading": drop_reading,
}

_COND = (
    "case when not cap_ok then 'fault_cap=false' else "
    "'fault_cap=true;C1_curvature=' || c1 || ';C2_peak=' || c2 || ';C3_drop=' || c3 || "
    "case when c1 and c2 and c3 then '' when restr then ';restricted_reason' "
    "when swal then ';sesoi_equivalence=true' else ';residual_branch' end end"
)

ORACLES = {
    "p1_counts": f"with {S.TRIALS}, {COUNTS} select {GK}, doc_id, tools, fault_pct, s, n from cnt",
    "document_positions": f"with {S.TRIALS}, {COUNTS} select {GK}, doc_id, pos, size from placed",
    "boot_multiplicities": f"""with {S.TRIALS}, {COUNTS}, {_index("['p1']", "placed")}
select model_id, size, w, count(*) as documents, count(distinct draw) as draws, sum(pos)::bigint as pos_sum
from (select model_id, size, draw, pos, count(*) as w from idx group by all) group by all""",
    "boot_cell_counts": f"""with {S.TRIALS}, {COUNTS}, {BOOT_COUNTS}
select {GK}, draw, tools, fault_pct, s::bigint as s, n::bigint as n from boot""",
    "p1_fit": f"with recursive {S.TRIALS}, {COUNTS}, {FIT}, {_robust()} {_fit_select('mle')}",
    "fit_refusals": f"""with {S.TRIALS}, c as (select unnest(['successes', 'failures', 'one-document', 'two-cells', 'one-column']) as cut),
r as (select model_id, mix || '/' || cut as mix, doc_id, tools, fault_pct, success from trials, c where {SCOPE} and case cut
  when 'successes' then success when 'failures' then not success when 'one-document' then doc_id = (select min(doc_id) from trials)
  when 'two-cells' then tools in (2, 3) and fault_pct = 0 else tools = 4 end),
s as (select model_id, mix, count(distinct doc_id) as n_documents, count(*) as n_runs, count(*) filter (where success) as hits,
  least(3, count(distinct tools)) + least(1, count(distinct fault_pct) - 1) as rank from r group by all)
select model_id, mix, n_documents, n_runs, 'not_estimable' as status,
  case when hits = 0 then 'no variation in scope: every run is a failure' when hits = n_runs then 'no variation in scope: every run is a success'
    when n_documents < 2 then 'one document: a clustered covariance needs two or more'
    else 'the in-scope cells identify ' || rank || ' of 4 coefficients' end as reason from s""",
    "fractional_logit": f"with recursive {S.TRIALS}, "
    + COUNTS.replace("count(*) filter (where success) as s", "sum(score) as s")
    + f", {FIT}, {_robust()} {_fit_select('fitted')}",
    "fractional_refusals": f"""with {S.TRIALS}, c as (select unnest(['constant', 'unscored', 'one-document']) as cut),
r as (select model_id, mix || '/' || cut as mix, doc_id, case cut when 'constant' then 0.5::double when 'one-document' then score end as score
  from trials, c where {SCOPE} and (cut <> 'one-document' or doc_id = (select min(doc_id) from trials))),
s as (select model_id, mix, count(distinct case when score is not null then doc_id end) as n_documents, count(score) as n_runs,
  count(distinct score) as scores, sum(score) as mass from r group by all)
select model_id, mix, n_documents, n_runs, 'not_estimable' as status, case when n_runs = 0 then 'no score'
    when scores < 2 then 'no variation in score' else 'one document: a clustered covariance needs two or more' end as reason,
  null::double as "const", null::double as peak from s""",
    "fitted_surface": f"""with recursive {S.TRIALS}, {COUNTS}, {FIT}, {_robust()},
pts as (select unnest([{', '.join(f"{{'t': {t}, 'f': {float(f)}::double}}" for t, f in ASKED)}], recursive := true)),
pa as (select w.*, t, pts.f as pct, t - 4.0::double as x1, power(t - 4.0::double, 2) as x2, pts.f/100.0::double as x3,
  b0 + b1*(t-4) + b2*(t-4)*(t-4) + b3*pts.f/100.0::double as eta from wald w, pts),
pb as (select *, 1.0::double/(1.0::double+exp(-eta)) as p, b1 + 2*b2*x1 as st from pa),
ways as (select model_id, mix, t, pct, 0 as kind, 1.0::double as q0, x1 as q1, x2 as q2, x3 as q3 from pb
  union all select model_id, mix, t, pct, 1, {', '.join(f'p*(1-p)*({c} + (1-2*p)*st*{x})' for c, x in zip(('0', '1', '2*x1', '0'), ('1', 'x1', 'x2', 'x3'), strict=True))} from pb
  union all select model_id, mix, t, pct, 2, {', '.join(f'p*(1-p)*({c} + (1-2*p)*b3*{x})' for c, x in zip('0001', ('1', 'x1', 'x2', 'x3'), strict=True))} from pb),
hs as (select w.model_id, w.mix, t, pct, kind, {', '.join(f'q0*h0.d{i}+q1*h1.d{i}+q2*h2.d{i}+q3*h3.d{i} as r{i}' for i in range(4))} from ways w
  {' '.join(f'join h{j} on h{j}.model_id = w.model_id and h{j}.mix = w.mix' for j in range(4))}),
vs as (select hs.model_id, hs.mix, t, pct, kind, sum(power(r0*u0+r1*u1+r2*u2+r3*u3, 2)) as m from hs
  join u on u.model_id = hs.model_id and u.mix = hs.mix group by all),
se as (select model_id, mix, t, pct, {', '.join(f'sqrt(max(m) filter (where kind = {k})) as m{k}' for k in range(3))} from vs group by all),
sf as (select pb.*, exists (from cnt c where c.model_id = pb.model_id and c.mix = pb.mix and c.tools = t and c.fault_pct = pct) as here,
  {', '.join(f'{S.Z}*m{k}*sqrt((n_documents/(n_documents-1.0::double))*((n_runs-1.0::double)/(n_runs-4.0::double))) as k{k}' for k in range(3))}
  from pb join se using (model_id, mix, t, pct))
select model_id, mix, t as tools, pct as fault_pct, case when here then 'fitted' else 'off_grid' end as status,
  {', '.join(f'case when here then round({e}, 6) end as {n}' for n, e in (
      ('fitted', 'p'), ('fitted_lo', '1/(1+exp(-(eta-k0)))'), ('fitted_hi', '1/(1+exp(-(eta+k0)))'),
      ('per_tool', 'p*(1-p)*st'), ('per_tool_lo', 'p*(1-p)*st-k1'), ('per_tool_hi', 'p*(1-p)*st+k1'),
      ('per_fault', 'p*(1-p)*b3'), ('per_fault_lo', 'p*(1-p)*b3-k2'), ('per_fault_hi', 'p*(1-p)*b3+k2')))}
from sf""",
    "p1_bootstrap": f"{P1_CTES} select * from bt",
    "p1_verdict": f"""{P1_CTES}
select model_id, mix, verdict, 'mle' as estimator, round(case when cap_ok then peak end, 6) as peak,
       case when cap_ok then boot_peak_lo end as boot_peak_lo, case when cap_ok then boot_peak_hi end as boot_peak_hi,
       case when cap_ok then drop_column end as drop_column, round(case when cap_ok then drop_points end, 6) as drop_points,
       round(case when cap_ok then drop_lo end, 6) as drop_lo, round(case when cap_ok then drop_hi end, 6) as drop_hi,
       cap_ok and not (c1 and c2 and c3) and not restr and not swal as residual, {_COND} as conditions
from verdict""",
    "drop_reading": f"""{P1_CTES}
select model_id, mix, verdict, round(drop_points, 6) as drop_points, round(drop_lo, 6) as drop_lo,
       round(drop_hi, 6) as drop_hi,
       case when drop_points is null then 'no drop is defined: the fit has no interior peak, so there is no peak to drop from'
            when drop_lo >= 15 then 'the drop is at least the 15-point margin'
            when drop_hi < 15 then 'the drop is smaller than the 15-point margin'
            else 'the drop cannot be told apart from the 15-point margin' end as reading
from verdict""",
    "sensitivity_verdicts": SENSITIVITY,
    "statement_lines": f"""{P1_CTES}, {PAIRS}, {P2_BOOT},
m as (select {GK}, avg(extra_turns) as r from pairs group by all),
dt as (select {GK}, cast(max(request_date) as varchar) as d from trials group by all),
w as (select v.*, m.r, p2b.lo, p2b.hi, dt.d, case when p2b.lo > 0 then 'survives' when p2b.hi < 1 then 'restricted' else 'below resolution' end as v2,
        a.p between 0.15 - (a.hi - a.lo)/2 and 0.95 + (a.hi - a.lo)/2 as ok
      from verdict v join m on v.model_id = m.model_id and v.mix = m.mix join p2b on v.model_id = p2b.model_id and v.mix = p2b.mix
      join dt on v.model_id = dt.model_id and v.mix = dt.mix
      join cells a on v.model_id = a.model_id and v.mix = a.mix and a.tools = 2 and a.fault_pct = 0)
select model_id, mix, d || ' | s1 | ' || model_id || ' | mix ' || mix || ' | ' || case when not ok then 'instrument_out_of_calibration: neither proposition moves' else
  'P1: ' || replace(verdict, '_', ' ') || case when verdict = 'blocked' then '' else ' (' ||
  case when peak is null then 'peak undefined' else printf('peak %.1f tools [%.1f, %.1f]', peak, boot_peak_lo, boot_peak_hi) end || '; ' ||
  case when drop_points is null then 'drop undefined' else printf('drop %.0f points [%.0f, %.0f]', drop_points, drop_lo, drop_hi) end || ')' end ||
  ' | P2: ' || v2 || printf(' (%+.1f turns [%.1f, %.1f])', r, lo, hi) end as statement, ok as moves from w""",
    "population_counts": f"""with {S.TRIALS}, {POP}
select {GK}, faulted, recovered, faulted - recovered as unrecovered from pop""",
    "control_pairs": f"""with {S.TRIALS}, {PAIRS}
select {GK}, tools, doc_id, epoch, run_id, control_id, fault_pct, first_fault_kind, n_faults, extra_turns,
       round(extra_seconds, 6) as extra_seconds from pairs""",
    "recovery_by_kind_and_row": f"""with {S.TRIALS}, {PAIRS}
select {GK}, 'kind' as axis, first_fault_kind as level, count(*) as pairs,
       {S.r("avg(extra_turns)", "mean_extra_turns")} from pairs group by all
union all
select {GK}, 'row', cast(fault_pct as varchar), count(*), {S.r("avg(extra_turns)", "mean_extra_turns")}
from pairs group by model_id, mix, fault_pct""",
    "recovery_means": f"""with {S.TRIALS}, {PAIRS}, {POP},
m as (select {GK}, count(*) as n_pairs, count(distinct doc_id) as n_documents, avg(extra_turns) as r,
             avg(extra_turns - n_faults) as net, sum(extra_seconds)::double/count(*) as seconds_mean
      from pairs group by all)
select {GK}, n_pairs, n_documents, {S.r("r", "r")}, {S.r("net", "net")}, {S.r("seconds_mean", "seconds_mean")},
       faulted as n_faulted, faulted - recovered as n_unrecovered, recovered - n_pairs as n_without_control
from pop join m using (model_id, mix)""",
    "p2_bootstrap": f"""with {S.TRIALS}, {PAIRS}, {P2_BOOT}
select {GK}, {S.r("lo", "lo")}, {S.r("hi", "hi")}, {S.r("net_lo", "net_lo")}, {S.r("net_hi", "net_hi")} from p2b""",
    "p2_verdict": f"""with {S.TRIALS}, {PAIRS}, {P2_BOOT},
m as (select {GK}, count(*) as n_pairs, avg(extra_turns) as r from pairs group by all)
select {GK}, case when lo > 0 then 'survives' when hi < 1 then 'restricted' else 'below_resolution' end as verdict,
       {S.r("r", "r")}, {S.r("lo", "lo")}, {S.r("hi", "hi")}, n_pairs
from m join p2b using (model_id, mix)""",
}
