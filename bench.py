"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "cell_wilson success_meaning tool_step_effects boundary_width run_counts p1_counts p1_fit "
    "p1_bootstrap p1_verdict control_pairs recovery_by_kind_and_row p2_bootstrap "
    "plan_grid plan_missing document_order_exact fault_assignment hash_draws "
    "amount_parse date_parse graded_scores normalized_texts transcript_hash_groups first_divergence "
    "noise_floor spend_cutoff forecast session_gaps json_diff manifest_diff tolerant_diff "
    "totals_reconciliation stream_cell_counts sensitivity_verdicts statement_lines fractional_logit"
).split()


def main() -> None:
    from trialstats.plans import catalogue
    from trialstats.session import local_session
    from trialstats.sources.adapters import trials

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    queries, seconds = catalogue.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    started = time.time()
    trials(spark, sf_dir).count()
    seconds["ingest_trials"] = round(time.time() - started, 3)
    for name in wanted:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))


if __name__ == "__main__":
    main()
