"""Work that must not grow past the input: what is hashed, fanned out or walked, checked by what the operators are given."""

import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialstats.operators import boot as B
from trialstats.operators import cost as M
from trialstats.operators import counts as K
from trialstats.operators import faults as FL
from trialstats.operators import recovery as R
from trialstats.operators import sparse as SP
from trialstats.plans import analysis as A
from trialstats.plans import scale as SC
from trialstats.plans import snapshot as SN
from trialstats.plans.catalogue import design, inference
from trialstats.rules import Rules
from trialstats.session import cut
from trialstats.sources import adapters

SF = "/root/testdata/sf0.001"


def test_trials_are_derived_by_methods_that_the_jit_compiles(spark, capsys):
    # Spark's default limit, and a plan that is final before it runs
    asked = {"spark.sql.codegen.hugeMethodLimit": "65535", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        adapters.derive_trials(spark, SF).explain("codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_ranges_rise_with_the_order_and_hold_every_row(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"),
        F.when(F.col("id") % 997 == 0, None).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("o"))
    parts = SC.split(df, ["k"], "o", 20_000).groupBy("k", "_range").agg(
        F.count("*").alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi")).orderBy("k", "_range").collect()
    assert sum(p.n for p in parts) == 20_000 and max(p.n for p in parts) < 1000
    assert all(a.hi < b.lo for a, b in zip(parts, parts[1:]) if a.k == b.k and a.hi)


@pytest.mark.parametrize("line", [-1.0, 0.0, 3.0, 40.0, 900.0, 10.0**6])
def test_spend_cutoff_equals_the_rule_run_by_run(spark, line):
    u = (F.pmod(F.xxhash64("id"), F.lit(1000)) - 200) / 1000  # a fifth of the costs is negative
    runs = spark.range(6000).select(
        F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("m"), F.col("id") % 2)).alias("model_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("run_id"),
        F.when(F.col("id") % 11 != 0, u).cast("decimal(20,6)").alias("cost_usd"))
    got = {r.model_id: r for r in M.spend_cutoff(runs, line, "run_id", 50).collect()}
    w = Window.partitionBy("model_id").orderBy("run_id")
    seen = {}
    for r in runs.withColumn("k", F.row_number().over(w)).orderBy("model_id", "k").collect():
        seen.setdefault(r.model_id, []).append(r)
    assert set(got) == set(seen)
    for model, rows in seen.items():
        spent, at = Decimal(0), None
        for k, r in enumerate(rows):
            if float(spent) + (float(spent) / k if k else 0.0) > M.STOP_AT * line:
                at = r.run_id
                break
            spent += r.cost_usd or 0
        g = got[model]
        assert (g.stopped_at, g.runs, g.started) == (at, len(rows), k if at else len(rows))
        assert g.spent_usd == pytest.approx(float(spent))


def test_spend_cutoff_walks_only_runs_near_the_line(spark, monkeypatch):
    runs = spark.range(50_000).select(
        F.lit("m").alias("model_id"), F.sha2(F.col("id").cast("string"), 256).alias("run_id"), F.lit(Decimal("0.01")).alias("cost_usd"))
    walked, plain = [], M.running_before
    monkeypatch.setattr(M, "running_before", lambda df, *a: walked.append(df.count()) or plain(df, *a))
    r = M.spend_cutoff(runs, 20.0, "run_id", 500).first()
    assert (r.runs, r.started) == (50_000, 1900) and walked[0] <= 500


def test_runs_are_priced_where_they_lie(spark):
    prices = spark.createDataFrame([("m", 1.0, 1.0, 1.0, 1.0)], "model_id string, input double, output double, cache_read double, cache_write double")
    runs = spark.range(5000, numPartitions=5).select(F.lit("m").alias("model_id"), *[F.col("id").alias(f"{u}_tokens") for u in M.USAGE])
    priced = M.price_runs(runs, prices)
    assert priced.groupBy(F.spark_partition_id()).count().count() == 5  # a model's runs are not gathered in one task
    assert priced.agg(F.sum("cost_usd")).first()[0] == 4 * sum(range(5000))


def test_refusals_count_each_run_once(spark, monkeypatch):
    given, plain = [], K.score_counts
    monkeypatch.setattr(K, "score_counts", lambda runs, *a: given.append(runs.count()) or plain(runs, *a))
    inference.fractional_refusals(spark, SF)
    assert given == [adapters.trials(spark, SF).count()]


def test_equal_calls_are_drawn_once(spark, monkeypatch):
    given, plain = [], FL.assign_faults
    monkeypatch.setattr(FL, "assign_faults", lambda calls, *a: given.append(calls) or plain(calls, *a))
    total = design.fault_assignment(spark, SF).agg(F.sum("calls")).first()[0]
    key = ["model_id", "mix", "doc_id", "epoch", "fault_pct", "call_index"]
    assert given[0].count() == given[0].select(*key).distinct().count() < total
    assert total == 6 * adapters.trials(spark, SF).count()


def test_an_audit_grades_once(spark):
    """What was recorded is read, not graded again by the audit's filter (F19); no white space goes through regular expressions (F24)."""
    from trialstats.functions import text as T
    from trialstats.plans.catalogue import records

    audit = records.regraded_runs(spark, "/root/testdata/sf0.001")
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1  # one pairing of items
    odd = spark.createDataFrame([("\u3000 a\x85\x1c b.\u2003, ;",), (" .;",), (None,)], "t string")
    got = odd.select(T.strip(odd["t"]), T.tidy(odd["t"]))
    assert [tuple(r) for r in got.collect()] == [("a\x85\x1c b.\u2003, ;", "a b. ,"), (".;", ""), (None, "")]
    assert r"\z" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_is_hashed_once_for_all_sizes_and_is_no_row(spark, monkeypatch):
    """Populations of 40 and 25 documents of one model share the hashes of their draws (F1)."""
    rows = [("m", mix, f"d{i:02d}", 1) for mix, size in (("A", 40), ("B", 25)) for i in range(size)]
    placed = B.placed_documents(spark.createDataFrame(rows, "model_id string, mix string, doc_id string, c long"))
    index = B.resample_index(placed.select("model_id", "size").distinct(), 30, "s", ["x", "y"])
    at = placed.join(index, ["model_id", "size", "pos"])
    want = at.groupBy("model_id", "mix", "statistic", "draw").agg(F.sum("c").alias("c")).collect()
    blocks, plain = [], B._packed
    monkeypatch.setattr(B, "_packed", lambda df: blocks.append(df.count()) or plain(df))
    monkeypatch.delattr(B, "_positions")
    got = B.draw_sums(placed, ["c"], 30, "s", ["x", "y"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and blocks == [30 * 2]


@pytest.mark.parametrize("size,drawn", [(100, 100), (100, 9), (16, 3000), (5, 1)])
def test_packed_positions_come_back(size, drawn):
    pos = np.random.default_rng(size).integers(0, size, drawn)
    found = np.zeros((7, 16))
    for c, dense, at in B._ranges(pos, size, 16):
        assert len(at) <= 16  # never more than a byte a position
        found[c] += B._times([at], [dense], 16)[0]
    assert found.ravel()[:size].tolist() == np.bincount(pos, minlength=size).tolist() and not found.ravel()[size:].any()


def test_the_second_decision_pairs_once(spark, monkeypatch):
    """Means and intervals of the second decision come from one table by document, nulls and lone runs included (F2)."""
    row = "model_id string, mix string, tools int, doc_id string, epoch int, run_id string, fault_pct int, first_fault_kind string, " \
          "n_faults int, recovered boolean, success boolean, turns int, seconds decimal(18,6), phase string"
    runs = []
    for d in range(9):
        for k in range(5):
            turns = None if (d + k) % 4 == 3 else 3 + d + k  # a control without turns still pairs
            if (d, k) not in ((2, 1), (2, 2)):
                runs.append(("m", "A", 2 + k % 3, f"d{d}" if d else None, k, f"c{d}{k}" if d != 5 else None, 0, None, 0, None, True, turns, Decimal(k), None))
            runs += [("m", "A", 2 + k % 3, f"d{d}" if d else None, k, f"f{d}{k}{i}", 10, "x", 1 + i, True, True, 7 + d * i, Decimal(d), None)
                     for i in range(3)]
    runs = spark.createDataFrame(runs, row)
    rules = Rules(draws=40)
    pairs = R.pair_sums(runs, rules)
    means = R.recovery_means(pairs, R.population_counts(runs, rules)).first()
    limits = R.recovery_intervals(pairs, "s", rules=rules).first()
    calls, plain = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: calls.append(df.columns) or plain(df))
    table = R.recovery_table(runs, "s", rules=rules)
    got = table.first()
    assert {k: got[k] for k in (*means.asDict(), *limits.asDict())} == means.asDict() | limits.asDict() and got.n_pairs > 0
    assert calls == [["model_id", "mix", "doc_id", "pairs", "extra_turns", "faults", "net_turns", "extra_seconds"]]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "control_id" not in plan  # nothing pairs again


def test_counts_of_all_readings_are_written_once(spark, monkeypatch):
    """The four readings share one written row per document and cell (F5)."""
    written, plain = [], A.cut
    monkeypatch.setattr(A, "cut", lambda df: written.append((df.columns, df.count())) or plain(df))
    A.sensitivity(adapters.trials(spark, SF), "s", Rules(draws=20)).collect()
    key = ["model_id", "mix", "doc_id", "tools", "fault_pct"]
    counts = [(columns, n) for columns, n in written if "doc_id" in columns]
    assert len(counts) == 1 and "reading" not in counts[0][0]
    assert counts[0][1] == adapters.trials(spark, SF).select(*key).distinct().count()


@pytest.fixture
def planned(spark):
    """Plans are final before they run, and no join is broadcast by estimate."""
    asked = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


def test_counts_of_a_group_need_not_meet_in_one_task(spark, planned):
    """Documents are scored and made wide where they lie; few groups are not few tasks (F4)."""
    counts = cut(K.document_counts(adapters.trials(spark, SF)))
    met = planned(SP._products(counts, cut(SP.estimate(counts)), ["model_id", "mix"]))
    scores = met[met.index("doc_id"):]  # the first line with a document is the sum of its scores
    scores = scores.split("Exchange hashpartitioning(", 2)
    assert "BroadcastHashJoin" in scores[0] and "doc_id" in scores[1].split("\n")[0]  # short counts are dealt by document, then scored
    assert "HashAggregate" not in scores[1].split("Scan")[0] and "SortMergeJoin" not in scores[0]
    wide = planned(K.wide_counts(counts, K.grid()))
    assert wide.count("Exchange") == 1 and "HashAggregate" not in wide[wide.index("Exchange"):]


def test_the_snapshot_makes_no_row_of_an_index(spark, monkeypatch):
    """Every table of the snapshot comes without a row per drawn index, and its pairs are summed once (F3)."""
    monkeypatch.delattr(B, "_positions")
    folded, plain = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: folded.append(df.count()) or plain(df))
    tables = A.analyze(adapters.trials(spark, SF), "s", Rules(draws=20))
    rows = SN.model_entries(tables, "s", "defaults").collect()
    assert [sorted(r.mixes) for r in sorted(rows)] == [["A", "B"]] * 3 and len(folded) == 1
    assert all(r.mixes[m].recovery.lo <= r.mixes[m].recovery.r <= r.mixes[m].recovery.hi for r in rows for m in r.mix_names)
