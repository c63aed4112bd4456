"""Growing logs, committed batches and stateful spend: what a crash, a torn line or a replay leaves behind."""

import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_sources_and_streams import run, write
from trialstats.plans import scale as SC
from trialstats.sources import committed as CT
from trialstats.sources import runlog as RL
from trialstats.sources import tail as TL
from trialstats.streaming import jobs as J


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_splits_give_each_line_once(monkeypatch, block):
    monkeypatch.setattr(TL, "BLOCK", block)
    random.seed(block)
    for _ in range(60):
        data = b"".join(random.choice([b"", b"a", b"bcd", b"efghij"]) + b"\n" for _ in range(random.randint(1, 9)))
        start = random.choice([0] + [k + 1 for k, c in enumerate(data[:-1]) if c == 10])
        size = random.randint(1, 9)
        got = [x for at in range(start, len(data), size)
               for x in TL.lines_from(Bytes(data), start, at, min(at + size, len(data)), len(data))]
        want, at = [], start
        for line in io.BytesIO(data[start:]).readlines():
            want.append((at, line[:-1]))
            at += len(line)
        assert got == want


def test_offsets_follow_growth_and_forget_files_at_rest(tmp_path):
    name = str(tmp_path / "a.jsonl")
    write(name, "one\ntwo\nthr")
    reader = TL.TailReader({"path": str(tmp_path), "idle": "3600", "split": "5"})
    first = reader.latestOffset()
    assert first["files"][name]["end"] == 8
    spans = reader.partitions(reader.initialOffset(), first)
    assert [(s.begin, s.end, s.limit) for s in spans] == [(0, 5, 8), (5, 8, 8)]
    assert [v for s in spans for b in reader.read(s) for v in b.column("value").to_pylist()] == ["one", "two"]
    reader.commit(first)
    with open(name, "a") as f:
        f.write("ee\nfour\n")
    second = reader.latestOffset()
    assert [v for s in reader.partitions(first, second) for b in reader.read(s) for v in b.column("value").to_pylist()] == ["three", "four"]
    assert reader.partitions(second, second) == []
    reader.commit(second)
    os.utime(name, (1, 1))
    third = reader.latestOffset()
    assert third["files"] == {} and reader.partitions(second, third) == []
    again = TL.TailReader({"path": str(tmp_path), "idle": "3600"})  # restarted: knows the checkpoint's offset only
    assert again.partitions(third, again.latestOffset()) == []


def test_a_torn_line_waits_for_its_newline(spark, tmp_path):
    src, out, bad = (str(tmp_path / n) for n in ("log", "rows", "bad"))
    os.mkdir(src)
    write(f"{src}/1.jsonl", run("a") + "\n" + run("b", score=0.5) + "\nno json\n" + run("c")[:40])
    J.ingest(spark, src, out, out + "-s").awaitTermination()
    J.keep_damaged(spark, src, bad, bad + "-s").awaitTermination()
    assert sorted(r.run_id for r in CT.read_table(spark, out).collect()) == ["a", "b"]
    with open(f"{src}/1.jsonl", "a") as f:
        f.write(run("c")[40:] + "\n" + run("b", score=0.25) + '\n{"run_id": null}\n')
    write(f"{src}/2.jsonl", run("d") + "\n" + run("a") + "\n")
    with open(f"{src}/2.jsonl", "ab") as f:
        f.write(run("e").encode().replace(b'"m"', b'"\xff"') + b"\n")
    J.ingest(spark, src, out, out + "-s", split=100).awaitTermination()
    J.keep_damaged(spark, src, bad, bad + "-s").awaitTermination()
    assert sorted((r.run_id, r.score) for r in CT.read_table(spark, out).collect()) == [("a", 1.0), ("b", 0.5), ("c", 1.0), ("d", 1.0)]
    assert spark.read.parquet(bad).count() == 3


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path):
    log, out = str(tmp_path / "log.jsonl"), str(tmp_path / "table")
    write(log, run("a") + "\n" + run("b") + "\n")
    CT.append_runs(RL.read_runs(spark, log), out, "one")
    write(log, run("b") + "\n" + run("c") + "\n")
    rows = RL.read_runs(spark, log)
    assert CT.stage(rows, out, "two") == 1  # and then the writer dies
    assert sorted(r.run_id for r in CT.read_table(spark, out).collect()) == ["a", "b"]
    assert [r.batch for r in CT.staged_only(spark, out).collect()] == ["two"]
    for _ in range(2):  # tried again, and replayed
        assert sorted(r.run_id for r in CT.append_runs(rows, out, "two").collect()) == ["a", "b", "c"]
    assert sorted((r.batch, r.rows) for r in CT.committed(spark, out).collect()) == [("one", 2), ("two", 1)]
    assert CT.staged_only(spark, out).isEmpty()


def test_the_winner_among_equal_ids_is_stated(spark, tmp_path):
    log = str(tmp_path / "log.jsonl")
    write(log, "".join(run("a", score=s) + "\n" for s in (0.75, 0.25, 0.5)))
    rows = RL.read_runs(spark, log)
    assert {CT.one_per_id(rows.repartition(n)).first().score for n in (1, 2, 3)} == {0.25}
    assert CT.one_per_id(rows, [-F.col("score")]).first().score == 0.75
    with pytest.raises(Exception, match="no run id"):
        CT.one_per_id(rows.withColumn("run_id", F.lit(None).cast("string"))).collect()


def test_only_the_batch_partitions_are_read(spark, tmp_path):
    log, out = str(tmp_path / "log.jsonl"), str(tmp_path / "table")
    write(log, "".join(run(f"{m}{k}", model_id=m) + "\n" for m in ("m1", "m2", "m3") for k in range(20)))
    CT.append_runs(RL.read_runs(spark, log), out)
    write(log, "".join(run(f"m2{k}", model_id="m2") + "\n" for k in range(10, 30)))
    batch = CT.cut(CT.one_per_id(RL.read_runs(spark, log)))
    fresh = CT.unknown(batch, out)
    assert sorted(int(r.run_id[2:]) for r in fresh.collect()) == list(range(20, 30))
    filters = re.findall(r"PartitionFilters: \[([^\n]*)\], PushedFilters", fresh._jdf.queryExecution().toString())
    filters = [f for f in filters if f]  # the list of commits has none
    assert filters and all("<=> m2" in f for f in filters)


def test_bloom_filter_misses_no_id(spark):
    ids = SC.cut(spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("k")))
    words, size = SC.small_filter(ids, "k")
    met = SC.may_hold(spark.range(40_000).select(F.col("id").cast("string").alias("k"), "id"), "k", words, size)
    found = met.groupBy((F.col("id") % 2).alias("odd")).count().collect()
    held = {r.odd: r["count"] for r in found}
    assert held[0] == 20_000 and 0 < held[1] < 3000


def test_spend_stops_once_and_a_replayed_batch_adds_nothing(spark, tmp_path):
    from decimal import Decimal

    from trialstats.operators import cost as M

    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "model_id string, run_id string, cost_usd decimal(38,12)"
    random.seed(1)
    rows = [(m, f"{k:03d}", Decimal(random.randint(1, 100)) / 100) for m in ("m1", "m2") for k in range(60)] + [("cheap", "000", Decimal("0.01"))]
    for part in range(3):
        own = [r for r in rows if int(r[1]) // 20 == part]
        spark.createDataFrame(own, schema).repartition(3).write.mode("append").parquet(source)
        J.spend_stops(spark.readStream.schema(schema).parquet(source), 20.0, out, out + "-s").awaitTermination()
    want = {r.model_id: (r.stopped_at, r.started, round(r.spent_usd, 6))
            for r in M.spend_cutoff(spark.createDataFrame(rows, schema), 20.0, "run_id").where("stopped_at is not null").collect()}
    read = lambda: [(r.model_id, (r.stopped_at, r.started, round(r.spent_usd, 6))) for r in spark.read.parquet(out).collect()]
    assert dict(read()) == want and len(read()) == 2
    os.remove(f"{out}-s/commits/2")  # the last batch is taken as unfinished and run again
    if os.path.exists(f"{out}-s/commits/.2.crc"):
        os.remove(f"{out}-s/commits/.2.crc")
    J.spend_stops(spark.readStream.schema(schema).parquet(source), 20.0, out, out + "-s").awaitTermination()
    assert dict(read()) == want and len(read()) == 2
