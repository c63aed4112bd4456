"""SQL text shared by the oracle statements (DuckDB spelling)."""

from __future__ import annotations

Z = "1.959963984540054::double"
Z2 = f"({Z}*{Z})"
SEED = 20261006


def unit(*pieces: str) -> str:
    """Uniform draw of a payload given as SQL string pieces."""
    h = f"sha256({' || '.join(pieces)})"
    return f"((cast('0x' || substr({h}, 1, 16) as ubigint) >> 11) / 9007199254740992.0::double)"


def u32(*pieces: str) -> str:
    return f"cast('0x' || substr(sha256({' || '.join(pieces)}), 1, 8) as bigint)"


def wilson(k: str, n: str) -> tuple[str, str]:
    k, n = f"({k})::double", f"({n})::double"
    scale = f"(1.0::double + {Z2}/({n}))"
    centre = f"(({k}/({n}) + {Z2}/(2.0::double*({n})))/{scale})"
    half = (
        f"({Z}*sqrt(({k}/({n}))*(1.0::double-{k}/({n}))/({n}) + {Z2}/(4.0::double*({n})*({n})))/{scale})"
    )
    lo = f"(case when {n} > 0 then greatest({centre}-{half}, 0.0::double) else 0.0::double end)"
    hi = f"(case when {n} > 0 then least({centre}+{half}, 1.0::double) else 0.0::double end)"
    return lo, hi


def newcombe(k1: str, n1: str, k2: str, n2: str) -> tuple[str, str]:
    l1, u1 = wilson(k1, n1)
    l2, u2 = wilson(k2, n2)
    p1, p2 = f"(({k1})::double/({n1}))", f"(({k2})::double/({n2}))"
    lo = f"({p1}-{p2}-sqrt(({p1}-{l1})*({p1}-{l1})+({u2}-{p2})*({u2}-{p2})))"
    hi = f"({p1}-{p2}+sqrt(({u1}-{p1})*({u1}-{p1})+({p2}-{l2})*({p2}-{l2})))"
    return lo, hi


def r(expr: str, name: str, places: int = 9) -> str:
    return f"round({expr}, {places}) as {name}"


def ascii_json(col: str) -> str:
    """Body of an ASCII JSON string literal, character by character."""
    u = "unicode(c)"
    hex4 = lambda e: f"lpad(lower(to_hex({e})), 4, '0')"
    one = (
        "case c when '\"' then '\\\"' when '\\' then '\\\\' when chr(10) then '\\n' when chr(13) then '\\r' "
        "when chr(9) then '\\t' when chr(8) then '\\b' when chr(12) then '\\f' else "
        f"case when {u} between 32 and 126 then c when {u} < 65536 then '\\u' || {hex4(u)} "
        f"else '\\u' || {hex4(f'55296 + (({u} - 65536) >> 10)')} || '\\u' || {hex4(f'56320 + (({u} - 65536) & 1023)')} end end"
    )
    chars = f"list_transform(range(1, length({col}) + 1), lambda i: substr({col}, i, 1))"
    return f"coalesce(array_to_string(list_transform({chars}, lambda c: {one}), ''), '')"


IDENT = "cast(l_orderkey as varchar) || ',' || cast(l_linenumber as varchar) || ',' || cast(l_partkey as varchar) || ',' || cast(l_suppkey as varchar) || ',' || cast(cast(l_quantity as integer) as varchar) || ',' || cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as varchar) || ']'"


def _call(scope: str, i: int) -> str:
    return unit(
        f"'[\"{scope}\",{SEED},\"' || model_id || '\",\"' || mix || '\",\"' || doc_id || '\",' || cast(epoch as varchar) || ',{i}]'"
    )


def _kind(i: int) -> str:
    u = _call("kind", i)
    return (
        f"case when {u} < 0.25 then 'timeout' when {u} < 0.5 then 'garbled_payload' "
        f"when {u} < 0.75 then 'error_response' else 'empty_result' end"
    )


# One row per line item, the same columns as the Spark adapter.
TRIALS = f"""
t0 as (
  select sha256('["run",' || {IDENT}) as run_id,
         'm' || cast(l_partkey % 3 as varchar) as model_id,
         case when l_linestatus = 'O' then 'A' else 'B' end as mix,
         (l_linenumber - 1) % 6 + 1 as tools,
         cast(least(floor(round(l_discount * 100) / 2), 5) * 10 as integer) as fault_pct,
         cast(l_suppkey as varchar) as doc_id,
         cast(l_quantity as integer) % 4 as epoch,
         {unit("'[" + '"trial",' + "'", IDENT)} as u,
         {unit("'[" + '"abort",' + "'", IDENT)} as u_abort,
         cast(l_quantity as integer) as tool_calls,
         case when cast(l_quantity as integer) % 3 = 0 then 1 else 0 end as malformed_calls,
         l_partkey % 4 as quality, l_tax, l_orderkey as ord,
         cast(l_shipdate as date) as request_date
  from lineitem),
t1 as (
  select *,
         {" + ".join(f"(case when {_call('fault', i)} < fault_pct/100.0::double then 1 else 0 end)" for i in range(6))} as n_faults,
         case {" ".join(f"when {_call('fault', i)} < fault_pct/100.0::double then {_kind(i)}" for i in range(6))} end as first_fault_kind,
         case when u_abort < 0.01 then null
              when tools >= 2 and u < 1.0::double/(1.0::double + exp(-(1.6::double - 0.6::double*(tools-4)
                     - 0.6::double*(tools-4)*(tools-4) - 3.0::double*fault_pct/100.0::double)))
              then case quality when 0 then 0.8::double when 1 then 0.9::double else 1.0::double end
              else round(l_tax * 9, 2) end as score
  from t0),
trials as (
  select run_id, model_id, mix, tools, fault_pct, doc_id, epoch, u, u_abort, tool_calls,
         malformed_calls, request_date, n_faults, first_fault_kind, score,
         case when score is null then null else score >= 0.8 end as success,
         case when score is null then 'aborted_transport' when score >= 0.3 then 'submitted'
              else 'no_submission' end as outcome,
         case when n_faults > 0 then coalesce(score >= 0.3, false) end as recovered,
         case when score is not null then null when u_abort < 0.001 then 'unrecorded'
              when u_abort < 0.004 then 'unparseable_model_output' else 'transport' end as abort_cause,
         case when score is not null then score >= 0.8 and quality <> 0 end as total_correct,
         3 + tool_calls % 7 + n_faults as turns,
         cast(3 + tool_calls % 7 + n_faults + l_tax as decimal(18,6)) as seconds,
         ord % 1000 + 200 as input_tokens, ord % 300 + 20 as output_tokens,
         ord % 4000 as cache_read_tokens, ord % 800 as cache_write_tokens
  from t1)"""


def _cells() -> str:
    lo, hi = wilson("k", "n")
    return f"""
cells as (
  select *, k::double/n as p, {lo} as lo, {hi} as hi, tools >= 2 as in_scope from (
    select model_id, mix, tools, fault_pct, count(success) as n,
           count(*) filter (where success) as k,
           sum(cast(score as decimal(18,12)))::double/count(score) as mean_score,
           sum(n_faults) filter (where success is not null)::double/count(success) as faults_per_run
    from trials group by all) where n > 0)"""


CELLS = _cells()
