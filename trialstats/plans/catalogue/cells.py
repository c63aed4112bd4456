"""Cell rates and the tables built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialstats.operators import cells as ops
from trialstats.plans.catalogue import sqltext as S
from trialstats.sources.adapters import trials

GC = "model_id, mix, tools, fault_pct"


def rounded(df, *columns: str, places: int = 9):
    """Doubles rounded for comparison with another engine."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def cell_wilson(spark, sf_dir):
    df = ops.cell_table(trials(spark, sf_dir))
    return rounded(df, "p", "lo", "hi", "mean_score", "faults_per_run")


def cell_malformed_rate(spark, sf_dir):
    return rounded(ops.malformed_rates(trials(spark, sf_dir)), "rate")


def success_meaning(spark, sf_dir):
    df = ops.success_meaning(trials(spark, sf_dir))
    return rounded(df, *[c for c in df.columns if c.endswith(("_p", "_lo", "_hi"))])


def never_recovered(spark, sf_dir):
    return rounded(ops.never_recovered(trials(spark, sf_dir)), "share")


def abort_causes(spark, sf_dir):
    return ops.abort_causes(trials(spark, sf_dir))


def unparseable_as_failure_cells(spark, sf_dir):
    turned = ops.unparseable_as_failure(trials(spark, sf_dir))
    return (
        turned.groupBy(*ops.G, *ops.CELL)
        .agg(
            F.count("success").alias("n"),
            F.count_if("success").alias("k"),
            F.count_if("turned").alias("turned"),
        )
    )


def rethreshold_cells(spark, sf_dir):
    base = trials(spark, sf_dir)
    return base.groupBy(*ops.G, *ops.CELL).agg(
        F.count("success").alias("n"),
        F.count_if(ops.success_at(0.8, -0.1)).alias("k_low"),
        F.count_if("success").alias("k"),
        F.count_if(ops.success_at(0.8, 0.1)).alias("k_high"),
    )


def tool_step_effects(spark, sf_dir):
    return rounded(ops.tool_effects(trials(spark, sf_dir)), "diff", "lo", "hi")


def boundary_width(spark, sf_dir):
    return ops.boundary_width(ops.cell_table(trials(spark, sf_dir)))


def viable_fraction(spark, sf_dir):
    return rounded(ops.viable_fraction(ops.cell_table(trials(spark, sf_dir))), "point", "lower_bound")


def instrument_check(spark, sf_dir):
    cells = ops.cell_table(trials(spark, sf_dir))
    checked = ops.instrument_check(cells.select(*ops.G).distinct(), cells)
    return rounded(checked, "anchor_p", "anchor_lo", "anchor_hi")


def nearest_below(spark, sf_dir):
    return ops.nearest_below(ops.cell_table(trials(spark, sf_dir)), 0.5, 4, 0)


def run_counts(spark, sf_dir):
    return ops.run_counts(trials(spark, sf_dir))


def outcome_counts(spark, sf_dir):
    return ops.outcome_counts(trials(spark, sf_dir))


def _meaning_sql() -> str:
    cols = []
    for name in ("registered", "score_09", "total_correct", "fully_correct"):
        lo, hi = S.wilson(f"{name}_k", "n")
        cols += [f"{name}_k", S.r(f"{name}_k::double/n", f"{name}_p"), S.r(lo, f"{name}_lo"),
                 S.r(hi, f"{name}_hi")]
    return f"""with {S.TRIALS}
select {GC}, n, {", ".join(cols)} from (
  select {GC}, count(success) as n,
         count(*) filter (where success) as registered_k,
         count(*) filter (where score >= 0.9) as score_09_k,
         count(*) filter (where total_correct) as total_correct_k,
         count(*) filter (where score = 1.0) as fully_correct_k
  from trials where tools >= 2 group by all) where n > 0"""


def _steps_sql() -> str:
    lo, hi = S.newcombe("a.k", "a.n", "b.k", "b.n")
    return f"""with {S.TRIALS},
c as (select model_id, mix, tools, fault_pct, count(success) as n, count(*) filter (where success) as k
      from trials where tools >= 2 group by all),
x as (select model_id, mix, tools, fault_pct, sum(n) as n, sum(k) as k, 0 as pooled from c group by all
      union all
      select model_id, mix, tools, null, sum(n), sum(k), 1 from c group by model_id, mix, tools)
select a.model_id, a.mix, a.fault_pct, b.tools as from_tools, a.tools as to_tools,
       {S.r("a.k::double/a.n - b.k::double/b.n", "diff")}, {S.r(lo, "lo")}, {S.r(hi, "hi")}
from x a join x b on a.model_id = b.model_id and a.mix = b.mix and a.pooled = b.pooled
  and a.fault_pct is not distinct from b.fault_pct and b.tools = a.tools - 1"""


def _width_sql() -> str:
    lo, hi = S.newcombe("k", "n", "nk", "nn")
    return f"""with {S.TRIALS}, {S.CELLS},
r as (select *, row_number() over w - 1 as i, lead(k) over w as nk, lead(n) over w as nn
      from cells where in_scope window w as (partition by model_id, mix, fault_pct order by tools)),
s as (select *, case when nn is null then false else ({lo} > 0 or {hi} < 0) end as clear from r),
f as (select model_id, mix, fault_pct, min(i) filter (where p < 0.9) as ia, min(i) filter (where p < 0.1) as ib,
             min(tools) filter (where p < 0.9) as ta, min(tools) filter (where p < 0.1) as tb
      from s group by all)
select f.model_id, f.mix, f.fault_pct, ta as first_below_90, tb as first_below_10, tb - ta as width,
       coalesce((select bool_and(clear) from s where s.model_id = f.model_id and s.mix = f.mix
          and s.fault_pct = f.fault_pct and s.i >= greatest(f.ia - 1, 0) and s.i < f.ib), false) as claimed
from f"""


QUERIES = {
    "cell_wilson": cell_wilson,
    "cell_malformed_rate": cell_malformed_rate,
    "success_meaning": success_meaning,
    "never_recovered": never_recovered,
    "abort_causes": abort_causes,
    "unparseable_as_failure_cells": unparseable_as_failure_cells,
    "rethreshold_cells": rethreshold_cells,
    "tool_step_effects": tool_step_effects,
    "boundary_width": boundary_width,
    "viable_fraction": viable_fraction,
    "instrument_check": instrument_check,
    "nearest_below": nearest_below,
    "run_counts": run_counts,
    "outcome_counts": outcome_counts,
}

ORACLES = {
    "cell_wilson": f"""with {S.TRIALS}, {S.CELLS}
select {GC}, n, k, {S.r("p", "p")}, {S.r("lo", "lo")}, {S.r("hi", "hi")}, in_scope,
       {S.r("mean_score", "mean_score")}, {S.r("faults_per_run", "faults_per_run")} from cells""",
    "cell_malformed_rate": f"""with {S.TRIALS}
select {GC}, sum(malformed_calls)::bigint as malformed, sum(tool_calls)::bigint as calls,
       {S.r("sum(malformed_calls)::double/sum(tool_calls)", "rate")}
from trials where success is not null group by all""",
    "success_meaning": _meaning_sql(),
    "never_recovered": f"""with {S.TRIALS}
select *, {S.r("never::double/faulted", "share")} from (
  select {GC}, count(*) as faulted, count(*) filter (where outcome <> 'submitted') as never
  from trials where tools >= 2 and success is not null and n_faults > 0 group by all)""",
    "abort_causes": f"""with {S.TRIALS}
select {GC}, abort_cause as cause, count(*) as runs from trials
where tools >= 2 and outcome = 'aborted_transport' group by all""",
    "unparseable_as_failure_cells": f"""with {S.TRIALS}
select {GC}, count(*) filter (where success is not null or abort_cause = 'unparseable_model_output') as n,
       count(*) filter (where success) as k,
       count(*) filter (where abort_cause = 'unparseable_model_output') as turned
from trials group by all""",
    "rethreshold_cells": f"""with {S.TRIALS}
select {GC}, count(success) as n, count(*) filter (where score >= 0.7) as k_low,
       count(*) filter (where success) as k, count(*) filter (where score >= 0.9) as k_high
from trials group by all""",
    "tool_step_effects": _steps_sql(),
    "boundary_width": _width_sql(),
    "viable_fraction": f"""with {S.TRIALS}, {S.CELLS}
select model_id, mix, {S.r("avg(case when p > 0.5 then 1.0 else 0.0 end)", "point")},
       {S.r("avg(case when lo > 0.5 then 1.0 else 0.0 end)", "lower_bound")}, count(*) as n_cells
from cells where in_scope group by all""",
    "instrument_check": f"""with {S.TRIALS}, {S.CELLS}
select model_id, mix, {S.r("p", "anchor_p")}, {S.r("lo", "anchor_lo")}, {S.r("hi", "anchor_hi")},
       p between 0.15 - (hi - lo)/2 and 0.95 + (hi - lo)/2 as ok,
       case when p between 0.15 - (hi - lo)/2 and 0.95 + (hi - lo)/2 then 'in_calibration'
            else 'instrument_out_of_calibration' end as label
from cells where tools = 2 and fault_pct = 0""",
    "nearest_below": f"""with {S.TRIALS}, {S.CELLS},
d as (select model_id, mix, 'tools' as axis, tools - 4 as delta from cells
      where in_scope and lo < 0.5 and fault_pct = 0 and tools <> 4
      union all
      select model_id, mix, 'fault_pct', fault_pct from cells
      where in_scope and lo < 0.5 and tools = 4 and fault_pct <> 0)
select model_id, mix, axis, cast(sign(delta) as integer) as direction, min(abs(delta)) as distance
from d group by all""",
    "run_counts": f"""with {S.TRIALS}
select model_id, mix, count(*) as runs_analyzed, count(*) filter (where success is null) as aborted_transport,
       count(*) filter (where tools = 1) as rung1,
       count(*) filter (where tools >= 2 and success is not null) as in_scope_p1,
       count(distinct doc_id) filter (where tools >= 2 and success is not null) as documents_p1,
       sum(malformed_calls)::bigint as malformed_calls,
       cast(max(request_date) as varchar) as last_date, cast(min(request_date) as varchar) as first_date
from trials group by all""",
    "outcome_counts": f"""with {S.TRIALS}
select model_id, mix, outcome, count(*) as runs from trials group by all""",
}
