import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trialstats.operators import boot as B
from trialstats.operators import calibrate as CAL
from trialstats.operators import cells as C
from trialstats.operators import cost as M
from trialstats.operators import counts as K
from trialstats.operators import fit as FT
from trialstats.operators import floor as NF
from trialstats.operators import recovery as R
from trialstats.operators import shape as SH
from trialstats.operators import sparse as SP
from trialstats.operators import synth as SY
from trialstats.operators import verdict as V
from trialstats.plans import analysis as A
from trialstats.rules import TRUTHS, Rules
from trialstats.session import cut

FAULTS = (0, 10, 20, 30, 40, 50)
SURVIVES = [(88, 93, 90, 61, 33), (85, 90, 86, 56, 30), (74, 81, 75, 47, 25), (52, 58, 53, 35, 20),
            (30, 33, 31, 24, 15), (18, 19, 18, 15, 11)]
FLAT = [(90, 92, 91, 89, 88), (84, 86, 85, 83, 82), (72, 74, 73, 71, 70), (55, 57, 56, 54, 53),
        (36, 37, 36, 35, 34), (21, 22, 21, 20, 20)]


def cells_of(spark, table):
    rows = [("m", "A", t + 2, f, 100, k) for f, line in zip(FAULTS, table) for t, k in enumerate(line)]
    df = spark.createDataFrame(rows, "model_id string, mix string, tools int, fault_pct int, n long, k long")
    from trialstats.functions.intervals import wilson
    lo, hi = wilson("k", "n")
    return df.select("*", (F.col("k") / F.col("n")).alias("p"), lo.alias("lo"), hi.alias("hi"), F.lit(True).alias("in_scope"))


def decide(spark, table, b1, b2, b2_iv, peak_iv, b3=-4.0, status="mle", b3_iv=(-5.0, -3.0)):
    peak = 4 - b1 / (2 * b2) if b2 < 0 else None
    fit = spark.createDataFrame([Row(model_id="m", mix="A", status=status, reason=None, tc=b1, tc2=b2, f=b3, peak=peak,
                                     tc2_lo=b2_iv[0], tc2_hi=b2_iv[1], f_lo=b3_iv[0], f_hi=b3_iv[1])],
                                "model_id string, mix string, status string, reason string, tc double, tc2 double, f double, peak double,"
                                "tc2_lo double, tc2_hi double, f_lo double, f_hi double")
    boot = spark.createDataFrame([("m", "A", peak_iv[0], peak_iv[1], b2_iv[0], b2_iv[1], *b3_iv)],
                                 "model_id string, mix string, boot_peak_lo double, boot_peak_hi double,"
                                 "boot_tc2_lo double, boot_tc2_hi double, boot_f_lo double, boot_f_hi double")
    return V.verdict_p1(fit, boot, cells_of(spark, table)).first()


def test_golden_grids(spark):
    a = decide(spark, SURVIVES, -0.7, -0.35, (-0.5, -0.2), (2.5, 3.6))
    assert a.verdict == "survives" and a.peak == pytest.approx(3.0) and a.drop_points == pytest.approx(60)
    b = decide(spark, FLAT, 0.0, -0.01, (-0.05, 0.03), (1.0, 9.0))
    assert b.verdict == "restricted"
    assert decide(spark, SURVIVES, -0.7, -0.35, (-0.5, -0.2), (2.5, 3.6), b3=2.0, b3_iv=(1.0, 3.0)).verdict == "blocked"
    inf = float("inf")
    no_peak = decide(spark, SURVIVES, -0.7, 0.1, (-0.1, 0.3), (-inf, inf))
    assert no_peak.verdict == "below_resolution" and no_peak.residual and no_peak.drop_column == 2


def test_boundary_width_rules(spark):
    line = [(95, 93, 60, 20, 5)]
    rows = [("m", "A", t + 2, 0, 100, k) for t, k in enumerate(line[0])]
    df = spark.createDataFrame(rows, "model_id string, mix string, tools int, fault_pct int, n long, k long").select(
        "*", (F.col("k") / 100).alias("p"), F.lit(True).alias("in_scope"))
    r = C.boundary_width(df).first()
    assert (r.first_below_90, r.first_below_10, r.width, r.claimed) == (4, 6, 2, True)


def test_steps_skip_a_missing_rung(spark):
    counts = spark.createDataFrame([("m", "A", 2, 0, 10, 5), ("m", "A", 4, 0, 10, 6), ("m", "A", 5, 0, 10, 6)],
                                   "model_id string, mix string, tools int, fault_pct int, n long, k long")
    got = C.step_effects(counts).where("fault_pct is not null").collect()
    assert [(r.from_tools, r.to_tools) for r in got] == [(4, 5)]


def test_newton_agrees_with_the_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    docs = spark.range(60).select(F.lit("cov-0").alias("scope"), F.col("id").alias("d"))
    runs = SY.simulate(docs, TRUTHS["band"])
    cells = K.grid()
    fit = FT.fit_groups(K.wide_counts(K.document_counts(runs, g=SY.SNAP), cells, SY.SNAP), cells, SY.SNAP).first()
    rows = runs.where("tools >= 2").select(
        F.col("success").cast("double").alias("y"), (F.col("tools") - 4.0).alias("tc"),
        ((F.col("tools") - 4.0) ** 2).alias("tc2"), (F.col("fault_pct") / 100.0).alias("f"))
    data = VectorAssembler(inputCols=["tc", "tc2", "f"], outputCol="x").transform(rows)
    glm = GeneralizedLinearRegression(family="binomial", labelCol="y", featuresCol="x", tol=1e-10, maxIter=50).fit(data)
    assert fit.status == "mle" and fit.n_documents == 60
    assert [fit.tc, fit.tc2, fit.f] == pytest.approx(list(glm.coefficients), abs=1e-5)
    assert fit.const == pytest.approx(glm.intercept, abs=1e-5)
    assert fit.tc2_lo < fit.tc2 < fit.tc2_hi


def test_ladder_statuses(spark):
    x = FT.covariates(K.grid())
    n = np.full((1, 30), 20.0)
    separated = np.where(x[:, 1] < 0, 20.0, 0.0)[None, :]
    beta, ok, moved = FT.ladder(x, separated, n, 15.0)
    assert moved[0] and ok[0] and np.isfinite(beta).all()
    doc = lambda d, t, f, s: ("m", "A", d, t, f, s, 5)
    schema = "model_id string, mix string, doc_id string, tools int, fault_pct int, s long, n long"
    cases = {
        "no variation": [doc(d, t, f, 5) for d in "ab" for t in (2, 3, 4) for f in (0, 10)],
        "one document": [doc("a", t, f, t - 1) for t in (2, 3, 4) for f in (0, 10)],
        "identify 2 of 4": [doc(d, t, 0, t) for d in "ab" for t in (2, 3)],
    }
    for words, rows in cases.items():
        wide = K.wide_counts(spark.createDataFrame(rows, schema), K.grid())
        r = FT.fit_groups(wide, K.grid()).first()
        assert r.status == "not_estimable" and words in r.reason and r.const is None
    with pytest.raises(Exception, match="outside the declared grid"):
        K.wide_counts(spark.createDataFrame([doc("a", 9, 0, 1)], schema), K.grid()).collect()


def recovery_runs(spark):
    rows = []
    for d, extra in (("d1", 2), ("d2", 4)):
        for tools in (2, 3):
            base = dict(model_id="m", mix="A", tools=tools, doc_id=d, epoch=0, phase="sweep")
            rows += [
                Row(**base, run_id=f"c{d}{tools}", fault_pct=0, success=True, turns=3, seconds=3.0, n_faults=0, first_fault_kind=None, recovered=None),
                Row(**base, run_id=f"f{d}{tools}", fault_pct=20, success=True, turns=3 + extra, seconds=5.0, n_faults=1, first_fault_kind="timeout", recovered=True),
                Row(**base, run_id=f"u{d}{tools}", fault_pct=20, success=False, turns=9, seconds=9.0, n_faults=1, first_fault_kind="timeout", recovered=False),
            ]
    return spark.createDataFrame(rows, "model_id string, mix string, tools int, doc_id string, epoch int, phase string, run_id string, fault_pct int, success boolean, turns int, seconds double, n_faults int, first_fault_kind string, recovered boolean")


def test_recovery_pairs(spark):
    runs = recovery_runs(spark)
    t = R.recovery_table(runs, "s", rules=Rules(draws=200)).first()
    assert (t.n_pairs, t.n_documents, t.r, t.net, t.n_faulted, t.n_unrecovered, t.n_without_control) == (4, 2, 3.0, 2.0, 8, 4, 0)
    assert t.lo == 2.0 and t.hi == 4.0
    kinds = {(r.axis, r.level): r.mean_extra_turns for r in R.breakdowns(R.pair_sums(runs)).collect()}
    assert kinds == {("kind", "timeout"): 3.0, ("row", "20"): 3.0}
    assert R.control_pairs(runs).count() == 4
    alone = R.recovery_table(runs.where("fault_pct > 0"), "s", rules=Rules(draws=50))
    r = alone.first()
    assert (r.n_pairs, r.n_without_control, r.r) == (0, 4, None)
    assert V.verdict_p2(alone).first().verdict == "not_estimable"


def floor_rows(spark, success, texts=None, protocol="fixed_seed"):
    rows = [("m", protocol, "A", 3, 20, r, i, s, (texts[r][i] if texts else "x"))
            for r, line in enumerate(success) for i, s in enumerate(line)]
    return spark.createDataFrame(rows, "model_id string, protocol string, mix string, tools int, fault_pct int, rerun int, index int, success boolean, transcript_hash string")


def test_noise_floor(spark):
    T, N = True, False
    f = NF.noise_floor(floor_rows(spark, [[T, N], [T, N], [T, T]], ["ab", "ab", "ac"])).first()
    assert (f.identity_rate, f.flipped, f.n_per_rerun, f.phi) == (0.5, 1, 2, None)
    v = NF.noise_floor(floor_rows(spark, [[T, T, N, N], [T, T, T, N], [T, N, N, N]], protocol="varied_seed")).first()
    assert v.jitter_sd == pytest.approx(0.25) and v.phi == pytest.approx(1.0) and v.flipped == 2 and v.identity_rate is None
    a = NF.rerun_rates(floor_rows(spark, [[T, N, N, None]])).first()
    assert a.rate == pytest.approx(1 / 3) and a.aborted == 1
    plan = floor_rows(spark, [[T, N]]).select(F.col("index").cast("string").alias("run_id"))
    with pytest.raises(ValueError, match="1 planned"):
        NF.require_complete(plan, plan.where("run_id = '0'"))


def test_calibration_counts(spark):
    runs = spark.createDataFrame([("m", 1, s, 10, 1) for s in (1.0, 0.9, 0.8, 0.7, 0.6, None)],
                                 "model_id string, level int, score double, tool_calls int, malformed_calls int")
    got = {r.tau: (r.k, r.n) for r in CAL.rate_table(runs, [0.8, 0.9, 0.7]).collect()}
    assert got == {0.8: (3, 5), 0.9: (2, 5), 0.7: (4, 5)}
    assert CAL.level_summary(runs).first().eligible


def test_forecast_cap_and_missing_price(spark):
    prices = spark.createDataFrame([("m", 5e-6, 2.5e-5, 5e-7, 6.25e-6)], "model_id string, input double, output double, cache_read double, cache_write double")
    runs = spark.createDataFrame([("m", 2, 0, "submitted", 3, 1000, 200, 4000, 800)],
                                 "model_id string, tools int, fault_pct int, outcome string, turns int, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    for n, ok in ((100, True), (1000, False)):
        counts = spark.createDataFrame([("m", "sweep", n)], "model_id string, phase string, runs long")
        r = M.forecast(M.token_means(runs), prices, counts, 10.0).first()
        assert r.usd == pytest.approx(round(n * 0.017, 2)) and r.within_cap == ok
    with pytest.raises(Exception, match="no prices"):
        M.price_runs(runs.withColumn("model_id", F.lit("z")), prices).collect()


def test_shape_labels():
    f = np.array([0, .1, .2, .3, .4, .5])
    n = np.full(6, 400.0)
    cliff = np.round(n * np.array([.95, .95, .93, .2, .02, .01]))
    slope = np.round(n * (0.9 - 1.4 * f))
    assert SH.shape_one(f, cliff, n)["label"] == "cliff"
    s = SH.shape_one(f, slope, n)
    assert s["label"] != "cliff" and s["lin_slope"] == pytest.approx(-1.4, abs=0.05)
    grid = [(a, b) for a in np.linspace(0.6, 1.1, 101) for b in np.linspace(-2, -1, 101)]
    p = np.clip(np.array([a + b * f for a, b in grid]), 1e-6, 1 - 1e-6)
    best = (slope * np.log(p) + (n - slope) * np.log1p(-p)).sum(axis=1).max()
    q = np.clip(s["lin_intercept"] + s["lin_slope"] * f, 1e-6, 1 - 1e-6)
    assert (slope * np.log(q) + (n - slope) * np.log1p(-q)).sum() >= best - 1e-6


def test_coverage_experiment(spark):
    docs = spark.range(60).select(F.col("id").alias("d")).withColumn("scope", F.explode(F.lit([f"t{i}" for i in range(8)])))
    band = SY.coverage_experiment(docs, TRUTHS["band"], "sim", rules=Rules(draws=200)).first()
    assert band.snapshots == 8 and band.power >= 0.75 and 0.9 <= band.wilson_coverage <= 1.0
    flat = SY.coverage_experiment(docs, TRUTHS["continent"], "sim", rules=Rules(draws=200)).first()
    assert flat.false_survival <= 0.2 and flat.peak_coverage is None


def test_draw_sums_do_not_depend_on_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([("m", "A", f"d{i:03d}", i, 1) for i in range(37)], "model_id string, mix string, doc_id string, v long, c long")
    placed = B.placed_documents(docs)
    small = B.draw_sums(placed, ["v", "c"], 50, "s", ["x"])
    monkeypatch.setattr(B, "broadcast_if_small", lambda d: d.hint("merge"))
    large = B.draw_sums(placed, ["v", "c"], 50, "s", ["x"])
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert small.agg(F.min("c"), F.max("c")).first() == (37, 37)


def test_draw_sums_over_ranges_of_positions(spark, monkeypatch):
    """Several blocks, ranges, slots of groups and series of draws give what a plain loop over the indices gives."""
    from hashlib import sha256

    size, draws, snapshot = 83, 30, 'sn"ü'
    rows = [("m", mix, f"d{i:03d}", i * k, None if i % 7 == 0 else i, k) for k, mix in enumerate("ABC") for i in range(size)]
    rows += [("n", "A", f"d{i}", i, 1, 1) for i in range(5)] + [("n", "Z", f"d{i}", 2**50 + i, None, 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "model_id string, mix string, doc_id string, v long, w long, c long")
    for name, value in (("BLOCK", 20), ("CHUNK", 16), ("COLUMNS", 6), ("SERIES", 12), ("BATCH", 5)):
        monkeypatch.setattr(B, name, value)
    monkeypatch.setattr(B, "broadcast_if_small", lambda d: d.hint("merge"))
    got = {(r.model_id, r.mix, r.statistic, r.draw): (r.v, r.w, r.c)
           for r in B.draw_sums(B.placed_documents(docs), ["v", "w", "c"], draws, snapshot, ["x", "y"]).collect()}
    want = {}
    for model, mix in {r[:2] for r in rows}:
        own = [r[3:] for r in sorted((r for r in rows if r[:2] == (model, mix)), key=lambda r: r[2])]
        for statistic in "xy":
            for draw in range(draws):
                picked = [own[int(sha256(json.dumps(["boot", snapshot, model, statistic, draw, j], separators=(",", ":")).encode())
                                  .hexdigest()[:8], 16) % len(own)] for j in range(len(own))]
                columns = [[x for x in c if x is not None] for c in zip(*picked, strict=True)]
                want[model, mix, statistic, draw] = tuple(sum(c) if c else None for c in columns)
    assert got == want


def test_readings(spark):
    runs = spark.createDataFrame([(0.75, False, "x", "submitted"), (None, None, "unparseable_model_output", "aborted_transport")],
                                 "score double, success boolean, abort_cause string, outcome string")
    got = {(r.reading, r.abort_cause): r.success for r in A.readings(runs).collect()}
    assert got[("tau-0.1", "x")] is True and got[("tau+0.1", "x")] is False
    assert got[("unparseable_as_failure", "unparseable_model_output")] is False
    assert got[("registered", "unparseable_model_output")] is None


def odd_rate_counts(spark, documents=40):
    """Counts whose rates no declared grid holds, two of them half a percent apart."""
    random = np.random.default_rng(4)
    rows = []
    for mix, shift in (("A", 0.0), ("B", 0.6)):
        for d in range(documents):
            for t in (2, 3, 4, 5, 6):
                for f in (0.0, 12.5, 13.0, 100 / 3, 41.7):
                    tc = t - 4.0
                    p = 1 / (1 + np.exp(-(1.0 + shift - 0.4 * tc - 0.3 * tc * tc - 2.5 * f / 100)))
                    rows.append(("m", mix, f"d{d}", t, f, int(random.binomial(3, p)), 3))
    rows += [("m", "separated", f"d{d}", t, f, 3 if t < 4 else 0, 3) for d in range(9) for t in (2, 3, 4, 5) for f in (0.0, 12.5)]
    rows += [("m", "one", "d0", t, f, 1, 3) for t in (2, 3, 4, 5) for f in (0.0, 12.5)]
    rows += [("m", "few", f"d{d}", t, 12.5, 1, 3) for d in range(3) for t in (2, 3)]
    rows += [("m", "same", f"d{d}", t, f, 3, 3) for d in range(3) for t in (2, 3, 5) for f in (0.0, 12.5)]
    return cut(spark.createDataFrame(rows, "model_id string, mix string, doc_id string, tools int, fault_pct double, s long, n long"))


def test_sparse_fit_equals_the_wide_fit_on_any_rates(spark):
    counts = odd_rate_counts(spark)
    grid = K.measured_grid(counts)
    assert {c[1] for c in grid} >= {12.5, 13.0, 41.7} and len(grid) == 30 + 5 * 4
    wide = {r.mix: r for r in FT.fit_groups(K.wide_counts(counts, grid), grid).collect()}
    quick = counts.where("mix in ('A', 'B', 'one', 'same')")  # separated groups take all hundred steps
    for rows, cells in ((counts, SP.CELLS), (quick, 0)):  # in one row a group, and by sums over Spark
        found = {r.mix: r for r in SP.fit(rows, cells=cells).collect()}
        assert len(found) == rows.select("mix").distinct().count()
        for mix, got in found.items():
            want = wide[mix]
            assert (got.status, got.n_documents, got.n_runs) == (want.status, want.n_documents, want.n_runs)
            for c in (*FT.COEFS, *(f"{n}_{s}" for n in FT.COEFS for s in ("lo", "hi")), "peak"):
                assert got[c] == (None if want[c] is None else pytest.approx(want[c], rel=1e-6, abs=1e-6)), (mix, c)
            if want.status != "firth":
                assert got.reason == want.reason
    assert {m: r.status for m, r in wide.items()} == {
        "A": "mle", "B": "mle", "separated": "firth", "one": "not_estimable", "few": "not_estimable", "same": "not_estimable"}


def test_penalized_newton_by_sums(spark):
    counts = odd_rate_counts(spark).where("mix = 'A'")
    grid = K.measured_grid(counts)
    row = K.wide_counts(counts, grid).groupBy("mix").agg(*[F.sum(c).alias(c) for c in K.count_columns(grid)]).first()
    s, n = (np.array([[float(row[f"{k}_{i}"]) for i in range(len(grid))]]) for k in "sn")
    want, ok = FT.newton(FT.covariates(grid), s, n, firth=True)
    got = SP.newton_by_sums(cut(SP.cell_totals(counts)), ["model_id", "mix"], firth=True).first()
    assert ok[0] and got.done == 1.0 and [got[c] for c in FT.COEFS] == pytest.approx(want[0].tolist(), abs=1e-7)


def test_readings_are_counted_in_one_pass(spark):
    from trialstats.sources.adapters import trials

    runs = trials(spark, "/root/testdata/sf0.001")
    cells, counts = A.reading_counts(runs)
    fanned, keys = A.readings(runs), ["reading", "model_id", "mix"]
    columns = [*keys, "tools", "fault_pct"]
    want = C.cell_table(fanned, g=keys).select(*columns, "n", "k", "p", "lo", "hi", "in_scope")
    assert sorted(map(tuple, cells.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    want = K.document_counts(fanned, g=keys).select(*columns, "doc_id", "s", "n")
    assert sorted(map(tuple, counts.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    scans = [p for p in (cells, counts) if "explode" in p._jdf.queryExecution().optimizedPlan().toString().lower()]
    assert not scans  # the runs are never fanned out


def test_scores_that_tell_nothing_are_refused(spark):
    cells = [(t, f) for t in (2, 3, 5) for f in (0, 20)]
    score = {"varied": lambda i, d: ((i + d) % 5) / 4, "constant": lambda i, d: 0.5, "unknown": lambda i, d: None}
    rows = [("m", mix, f"d{d}", t, f, score[mix](i, d)) for mix in score for d in range(6) for i, (t, f) in enumerate(cells)]
    runs = spark.createDataFrame(rows, "model_id string, mix string, doc_id string, tools int, fault_pct int, score double")
    runs = runs.selectExpr("*", "true as success", "'submitted' as outcome", "'sweep' as phase")
    found = {r.mix: r for r in SP.fractional_logit(cut(K.score_counts(runs))).collect()}
    assert {m: (r.status, r.reason, r.n_documents, r.n_runs) for m, r in found.items()} == {
        "varied": ("fitted", None, 6, 36), "constant": ("not_estimable", "no variation in score", 6, 36),
        "unknown": ("not_estimable", "no score", 0, 0)}
    assert found["varied"].const_lo < found["varied"].const < found["varied"].const_hi
    assert found["constant"].const is None and found["constant"].peak is None
    assert SP.fractional_logit(cut(K.score_counts(runs.limit(0)))).count() == 0


def test_surface_slopes_are_those_of_the_fitted_rate(spark):
    counts = odd_rate_counts(spark)
    fit = {r.mix: r for r in SP.fit(counts).collect()}
    ran = {(r.mix, r.tools, r.fault_pct) for r in counts.collect()}
    points = sorted({(t, f) for _, t, f in ran})[:6] + [(4, 99.0), (3, 12.5)]
    rows = SP.surface(counts, points).collect()
    assert len(rows) == len(fit) * len(points)

    def rate(b, t, f):
        return 1 / (1 + np.exp(-(b.const + b.tc * (t - 4) + b.tc2 * (t - 4) ** 2 + b.f * f / 100)))

    for r in rows:
        b, t, f, step = fit[r.mix], r.tools, r.fault_pct, 1e-5
        want = "off_grid" if (r.mix, t, f) not in ran else "fitted" if b.status == "mle" else "not_estimable"
        assert r.status == want
        if want != "fitted":
            assert r.fitted is None and r.per_tool_lo is None and r.per_fault_hi is None
            continue
        assert r.fitted == pytest.approx(rate(b, t, f)) and r.fitted_lo < r.fitted < r.fitted_hi
        assert r.per_tool == pytest.approx((rate(b, t + step, f) - rate(b, t - step, f)) / (2 * step), rel=1e-5, abs=1e-8)
        assert r.per_fault == pytest.approx((rate(b, t, f + step) - rate(b, t, f - step)) / (2 * step / 100), rel=1e-4, abs=1e-7)
        assert r.per_tool_lo < r.per_tool < r.per_tool_hi and r.per_fault_lo < r.per_fault < r.per_fault_hi
    assert {r.status for r in rows} == {"fitted", "off_grid", "not_estimable"}


def test_surface_limits_are_those_of_the_coefficient_at_the_centre(spark):
    """At tools 4 and no faults the linear part is the constant, so its limits are the constant's."""
    counts = odd_rate_counts(spark).where("mix = 'A'")
    fit, at = SP.fit(counts).first(), SP.surface(counts, [(4, 0.0)]).first()
    logit = lambda p: np.log(p / (1 - p))
    assert at.status == "fitted"
    assert [logit(at[c]) for c in ("fitted_lo", "fitted", "fitted_hi")] == pytest.approx([fit.const_lo, fit.const, fit.const_hi])
