import json
import math
import os

import pytest
from pyspark.sql import functions as F

from trialstats.functions.jsonsafe import json_rows, significant
from trialstats.operators import logs as L
from trialstats.operators import transcripts as X
from trialstats.plans import snapshot as SN
from trialstats.schema import normalize_runs
from trialstats.sources import committed as CT
from trialstats.sources import files as FS
from trialstats.sources import runlog as RL
from trialstats.streaming import jobs as J


def run(i, **more):
    row = {"run_id": i, "model_id": "m", "phase": "sweep", "mix": "A", "tools": 2, "fault_rate": 0.1, "index": 0,
           "doc_id": "d", "epoch": 0, "outcome": "submitted", "score": 1.0, "success": True, "turns": 3,
           "per_field": {"total_amount": 1.0}, "submission": {"a": [1, True]},
           "fault_events": [{"turn": 1, "call_index": 0, "tool": "t", "args_sha256": "", "kind": "timeout", "executed": False}],
           "events": [{"kind": "model_turn", "turn": 1, "data": {"identity": {"request_date": "2026-01-02T00:00"}, "response_model": "r"}}]}
    return json.dumps({**row, **more})


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)


def test_torn_tail_is_skipped_and_damage_stops(spark, tmp_path):
    p = str(tmp_path / "runs.jsonl")
    write(p, run("aaaa") + "\n" + run("bbbb") + '\n{"run_id":"cc')
    assert sorted(r.run_id for r in RL.read_runs(spark, p).collect()) == ["aaaa", "bbbb"]
    i = RL.log_integrity(spark, p).first()
    assert (i.lines, i.torn, i.damaged) == (3, 1, 0)
    assert sorted(r.run_id for r in RL.known_ids(spark, p).collect()) == ["aaaa", "bbbb"]
    write(p, run("aaaa") + '\n{"run_id":"cc\n' + run("bbbb") + "\n")
    with pytest.raises(ValueError, match="not valid JSON"):
        RL.read_runs(spark, p)
    write(p, run("aaaa") + '\n{"run_id":"cc\n')
    with pytest.raises(ValueError):
        RL.read_runs(spark, p)


def test_normalized_rows(spark, tmp_path):
    p = str(tmp_path / "runs.jsonl")
    abort = run("b", outcome="aborted_transport", success=None, score=None, fault_events=None, phase=None,
                events=[{"kind": "abort_cause", "turn": 0, "data": {"cause": "transport"}}])
    write(p, run("a") + "\n" + abort + "\n" + run("c", outcome="aborted_transport", events=[]) + "\n")
    rows = {r.run_id: r for r in normalize_runs(RL.read_runs(spark, p)).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a.fault_pct, a.n_faults, a.first_fault_kind, a.request_date, a.total_correct) == (10, 1, "timeout", "2026-01-02", True)
    assert (b.phase, b.n_faults, b.abort_cause, b.success) == ("sweep", 0, "transport", None) and c.abort_cause == "unrecorded"
    ident = L.served_identities(L.model_turns(RL.read_runs(spark, p))).first()
    assert (ident.kind, ident.value, ident.turns) == ("model", "r", 1)


def test_append_is_once_per_id(spark, tmp_path):
    p, out = str(tmp_path / "runs.jsonl"), str(tmp_path / "table")
    write(p, run("a") + "\n" + run("b") + "\n" + run("a") + "\n")
    CT.append_runs(RL.read_runs(spark, p), out)
    write(p, run("b") + "\n" + run("c") + "\n")
    got = CT.append_runs(RL.read_runs(spark, p), out)
    assert sorted(r.run_id for r in got.collect()) == ["a", "b", "c"]
    log = str(tmp_path / "log")
    RL.write_log(got, log)
    again = RL.read_runs(spark, log)
    assert again.count() == 3 and json.loads(again.select(F.to_json("submission")).first()[0]) == {"a": [1, True]}


def test_documents_prices_sessions_transcripts(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    write(d / "inv-1.txt", "a\r\nb")
    write(d / "inv-2.txt", "c")
    assert {r.doc_id: r.text for r in FS.read_documents(spark, str(d)).collect()} == {"inv-1": "a\nb", "inv-2": "c"}
    h = {os.path.basename(r.path): r.sha256 for r in FS.file_hashes(spark, str(d), text=True).collect()}
    import hashlib
    assert h["inv-1.txt"] == hashlib.sha256(b"a\nb").hexdigest()
    price = {"input": 1e-6, "output": 2e-6, "cache_read": 0, "cache_write": 0}
    write(tmp_path / "p.json", json.dumps({"unit": "usd_per_token", "models": {"m": price}}))
    assert FS.read_prices(spark, str(tmp_path / "p.json")).first().output == 2e-6
    write(tmp_path / "p.json", json.dumps({"unit": "eur", "models": {"m": price}}))
    with pytest.raises(Exception, match="usd_per_token"):
        FS.read_prices(spark, str(tmp_path / "p.json")).collect()
    s = [{"event": "start", "started": "1", "planned": 5}, {"event": "finish", "started": "1", "completed": 5}, {"event": "start", "started": "2", "planned": 3}]
    write(tmp_path / "s.jsonl", "\n".join(map(json.dumps, s)))
    pairs = {r.started: r.killed for r in L.session_pairs(FS.read_sessions(spark, str(tmp_path / "s.jsonl"))).collect()}
    assert pairs == {"1": False, "2": True}
    t = spark.createDataFrame([("ab1", json.dumps([{"role": "user", "content": "hi"}]))], "run_id string, t string").select(
        "run_id", F.from_json("t", f"array<{X.MESSAGE}>").alias("messages"))
    FS.write_transcripts(t, str(tmp_path / "tr"))
    back = FS.explode_messages(spark.read.schema(f"run_id string, messages array<{X.MESSAGE}>").json(str(tmp_path / "tr"))).first()
    assert (back.run_id, back.pos, back.content) == ("ab1", 0, "hi") and os.path.isdir(tmp_path / "tr" / "shard=ab")


def test_strict_json_and_numbers(spark):
    df = spark.createDataFrame([(1, math.inf, [math.nan, -math.inf, 0.5])], "b int, a double, c array<double>")
    assert json_rows(df).first().value == '{"a":"inf","b":1,"c":[null,"-inf",0.5]}'
    vals = [0.1, 1 / 3, 2.0, 0.0, 123456.789, 1e-7, 0.123456789012, 100.0]
    rows = spark.createDataFrame([(v,) for v in vals], "v double").select("v", significant(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == ["%.10g" % v for v in vals]


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    os.mkdir(src)
    write(f"{src}/1.jsonl", run("a") + "\n" + run("b") + '\n{"run_id":"c')
    J.ingest(spark, src, out, state).awaitTermination()
    write(f"{src}/2.jsonl", run("b") + "\n" + run("c") + "\n")
    J.ingest(spark, src, out, state).awaitTermination()
    assert sorted(r.run_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_mixed_snapshots_are_refused(spark):
    df = spark.createDataFrame([("s1",), ("s2",)], "snapshot string")
    with pytest.raises(ValueError, match="more than one snapshot"):
        SN.require_one(df, "snapshot")
    SN.require_one(df.limit(1), "snapshot")


def test_a_row_without_its_newline_is_not_known(spark, tmp_path):
    p = str(tmp_path / "runs.jsonl")
    write(p, run("aaaa") + "\n" + run("bbbb"))
    assert [r.run_id for r in RL.known_ids(spark, p).collect()] == ["aaaa"]
    write(p, run("aaaa") + '\n{"run_id":"cc\n' + run("bbbb") + "\n")
    with pytest.raises(ValueError, match="not valid JSON"):
        RL.known_ids(spark, p)


def test_damaged_lines_are_kept_beside_the_stream(spark, tmp_path):
    from trialstats.streaming import jobs as J

    (tmp_path / "log").mkdir()
    write(str(tmp_path / "log" / "a.jsonl"), run("aaaa") + '\nno json\n\n{"run_id": null}\n' + run("bbbb") + "\n")
    paths = {n: str(tmp_path / n) for n in ("log", "rows", "bad", "s1", "s2")}
    J.ingest(spark, paths["log"], paths["rows"], paths["s1"]).awaitTermination()
    J.keep_damaged(spark, paths["log"], paths["bad"], paths["s2"]).awaitTermination()
    assert sorted(r.run_id for r in spark.read.parquet(paths["rows"]).collect()) == ["aaaa", "bbbb"]
    assert sorted(r.value for r in spark.read.parquet(paths["bad"]).collect()) == ["no json", '{"run_id": null}']


def test_rates_between_percents_stay_apart(spark):
    from trialstats.schema import percent

    rates = spark.createDataFrame([(0.07,), (0.125,), (0.13,), (0.3,), (1 / 3,), (None,)], "r double")
    got = [r.p for r in rates.select(percent(F.col("r")).alias("p")).collect()]
    assert got == [7.0, 12.5, 13.0, 30.0, 33.333333333, None]


def test_no_activity_span_is_lost(spark):
    from trialstats.plans.catalogue.live import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["stream_sessions_all"](spark, sf).collect()
    assert sum(r.runs for r in rows) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert {r.closed for r in rows} == {True, False}
    closed = {(r.user_id, r.first_us, r.closes_us, r.runs) for r in QUERIES["stream_sessions"](spark, sf).collect()}
    assert closed == {(r.user_id, r.first_us, r.closes_us, r.runs) for r in rows if r.closed}
    print("SPANS", len(rows), len(closed))
