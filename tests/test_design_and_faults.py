import hashlib
import json

from pyspark.sql import functions as F

from trialstats.functions import draws as D
from trialstats.operators import design as P
from trialstats.operators import faults as FL
from trialstats.rules import Design


def unit(*parts):
    h = hashlib.sha256(json.dumps(list(parts), separators=(",", ":")).encode()).digest()
    return (int.from_bytes(h[:8], "big") >> 11) / float(1 << 53)


def docs(spark, n):
    return spark.range(n).select(F.format_string("inv-%04d", F.col("id")).alias("doc_id"))


def test_exact_permutation_equals_sequential_swaps(spark):
    d = Design()
    for n in (1, 2, 7, 100):
        order = [f"inv-{i:04d}" for i in range(n)]
        for i in range(n - 1, 0, -1):
            j = int(unit("perm", d.root_seed, "m", i) * (i + 1))
            order[i], order[j] = order[j], order[i]
        got = P.exact_permutation(docs(spark, n), ["m"], d).orderBy("pos").collect()
        assert [r.doc_id for r in got] == order


def test_run_ids_and_pairing(spark):
    d = Design(epochs=2)
    perm = P.hashed_permutation(docs(spark, 15), ["m"], d)
    plan = P.sweep_plan(perm, d).collect()
    for r in plan[::97]:
        ident = dict(model_id="m", mix=r.mix, tools=r.tools, fault_rate=r.fault_pct / 100,
                     index=r["index"], phase="sweep", seed_offset=None)
        want = hashlib.sha256(json.dumps(ident, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:16]
        assert r.run_id == want
    seen = {}
    for r in plan:
        assert seen.setdefault(r["index"], (r.doc_id, r.sample_seed, r.epoch)) == (r.doc_id, r.sample_seed, r.epoch)
    assert len({r.run_id for r in plan}) == len(plan)
    assert sum(r.tools == 1 for r in plan) == 20 * 6 * 2
    assert [r.tool_list for r in plan if r.tools == 1][0] == ["fetch_document"]


def test_planned_counts_match_the_plan(spark):
    d = Design()
    perm = P.hashed_permutation(docs(spark, 25), ["m"], d)
    got = {r.phase: r.runs for r in P.phase_counts(
        P.sweep_plan(perm, d), P.probe_plan(perm, "A", d), P.noise_floor_plan(perm, "A", d)).collect()}
    want = P.planned_counts(d, 25)
    assert got["sweep"] == want["sweep"] and got["probe"] == want["probe"]
    assert got["floor_fixed"] + got["floor_varied"] == want["noise_floor"]
    assert got["floor_hosted"] == P.planned_counts(d, 25, hosted=True)["noise_floor"]


def test_resume_and_drift(spark):
    d = Design()
    plan = P.sweep_plan(P.hashed_permutation(docs(spark, 5), ["m"], d), d)
    done = plan.where("fault_pct < 30")
    left = P.not_recorded(plan, done)
    assert left.count() + done.count() == plan.count() and left.where("fault_pct < 30").isEmpty()
    assert P.drift(done, plan).isEmpty()
    assert P.drift(done.withColumn("doc_id", F.lit("x")), plan).count() == done.count()
    assert P.only_cells(plan, ["2:0.1", "3:0.5"]).select("tools", "fault_pct").distinct().count() == 2


def test_roles(spark):
    df = spark.createDataFrame(
        [("openai", "http://127.0.0.1:8080/v1"), ("openai", "https://api.example.com/v1"),
         ("anthropic", None), ("synthetic", None), ("openai", "http://[::1]:9/v1")], "p string, u string")
    got = [r[0] for r in df.select(P.model_role(F.col("p"), F.col("u"))).collect()]
    assert got == ["local", "hosted", "hosted", "synthetic", "local"]


def test_faults_nest_along_the_rate(spark):
    calls = spark.range(40).select(
        F.lit("m").alias("model_id"), F.lit("A").alias("mix"), F.col("id").cast("string").alias("doc_id"),
        F.lit(0).alias("epoch"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("call_index"))
    assert FL.nesting_violations(calls).isEmpty()
    a = FL.assign_faults(calls.withColumn("fault_pct", F.lit(30))).collect()
    for r in a[::13]:
        u = unit("fault", 20261006, "m", "A", r.doc_id, 0, r.call_index)
        assert r.fires == (u < 0.3) and (r.kind is None) == (u >= 0.3)
    assert FL.assign_faults(calls.withColumn("fault_pct", F.lit(0))).where("fires").isEmpty()


def brute_garble(text, key, fraction=0.2):
    a = FL.ALPHABET

    def sub(c, k):
        i = int(unit("garble", *key, "sub", k) * len(a)) % len(a)
        return a[i] if a[i] != c else a[(i + 1) % len(a)]

    if len(text) <= 1:
        out = sub(text[:1], 0)
    else:
        chars = list(text)
        hits = [k for k in range(len(chars)) if unit("garble", *key, k) < fraction] or [0]
        for k in hits:
            chars[k] = sub(chars[k], k)
        out = "".join(chars[: max(int(len(chars) * (0.3 + 0.7 * unit("garble", *key, "cut"))), 1)])

    def parses(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    while parses(out) or out == text:
        out += '"'
    return out


def test_garble_matches_its_definition(spark):
    texts = ["", "x", "7", '{"a": 1}', "12345678", "öäü straße 😀 text", "true", "[1,2,3]", "a" * 300, '"q"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = FL.garble(df, "t", (5, D.number("i")), "g").collect()
    for r in got:
        assert r.g == brute_garble(r.t, (5, r.i))


def test_garbled_payloads_follow_their_sql_where_the_corruption_is_json(spark, tmp_path):
    import duckdb

    from trialstats.plans.catalogue import design as Q

    talk = spark.range(400).select(
        F.col("id").alias("conv_id"), F.lit(3).alias("turn"), F.lit("user").alias("role"),
        F.when(F.col("id") % 2 == 0, "ab").otherwise("xy z").alias("text"))
    talk.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.garbled for r in Q.garbled_payloads(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == {r[0]: r[2] for r in con.execute(Q.ORACLES["garbled_payloads"]).fetchall()}
    assert any(t.isdigit() for t in got.values())
    guarded = FL.garble(talk, "text", (7, D.number("conv_id")), "garbled")
    assert guarded.where(FL.parses_as_json(F.col("garbled"))).isEmpty()


def test_plans_are_not_broadcast(spark, capsys):
    """A plan is exploded from few documents, so its size is underrated by the planner."""
    plan = P.sweep_plan(P.hashed_permutation(docs(spark, 40), ["m"]), Design())
    for joined in (P.drift(plan, plan), P.not_recorded(plan, plan)):
        joined.explain()
        shown = capsys.readouterr().out
        # the offsets of the permutation may be broadcast, the plans not
        assert "SortMergeJoin [run_id" in shown
