"""Trial plans: which runs an experiment consists of, in which order, with which seeds.

Run ``i`` of every cell has the same document and sampling seed, so cells differ only in their dose
and fault rate. All values are functions of the design and the row itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialstats.functions import draws as D
from trialstats.plans.scale import hashed_order, positions
from trialstats.rules import Design
from trialstats.session import cut


def run_id(
    model: Column, mix: Column, tools: Column, fault_pct: Column, index: Column, phase: Column,
    seed_offset: Column | None = None, rerun: Column | None = None,
) -> Column:
    """16 hex digits of the hashed identity; ``rerun`` enters only when it is given."""
    offset = F.lit("null") if seed_offset is None else F.coalesce(
        seed_offset.cast("string"), F.lit("null"))
    rate = (fault_pct / F.lit(100.0)).cast("string")
    parts = [
        F.lit('{"fault_rate":'), rate, F.lit(',"index":'), index.cast("string"),
        F.lit(',"mix":'), D.json_string(mix), F.lit(',"model_id":'), D.json_string(model),
        F.lit(',"phase":'), D.json_string(phase),
    ]
    if rerun is not None:
        parts += [F.lit(',"rerun":'), rerun.cast("string")]
    parts += [F.lit(',"seed_offset":'), offset, F.lit(',"tools":'), tools.cast("string"), F.lit("}")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def tool_list(mix: Column, k: Column, design: Design = Design()) -> Column:
    """Tools offered at rung k: the single rung-1 list, else the first k of the mix."""
    chain = None
    for name, tools in design.mixes.items():
        if tools[: len(design.required_tools)] != design.required_tools:
            raise ValueError(f"mix {name!r} must start with {design.required_tools}")
        offered = F.array(*[F.lit(t) for t in tools])
        offered = F.when(
            k > len(tools), F.raise_error(F.concat(F.lit("rung exceeds mix "), mix)).cast(
                "array<string>")
        ).otherwise(F.slice(offered, 1, k))
        test = mix == name
        chain = F.when(test, offered) if chain is None else chain.when(test, offered)
    return F.when(k == 1, F.array(*[F.lit(t) for t in design.rung1_tools])).otherwise(chain)


def per_model(docs: DataFrame, models: Sequence[str]) -> DataFrame:
    return docs.select("doc_id", F.explode(F.lit(list(models))).alias("model_id"))


def hashed_permutation(docs: DataFrame, models: Sequence[str], design: Design = Design()) -> DataFrame:
    """Document order per model by one hashed draw per document: fully parallel.

    This is a different (equally valid) order from ``exact_permutation``.
    """
    drawn = per_model(docs, models).withColumn(
        "u", D.unit("perm", design.root_seed, D.json_string("model_id"), D.json_string("doc_id"))
    )
    return hashed_order(drawn, ["model_id"], "u", "doc_id").drop("u")


def exact_permutation(docs: DataFrame, models: Sequence[str], design: Design = Design()) -> DataFrame:
    """The swap-by-swap shuffle of the sorted documents, computed without running the swaps in
    sequence.

    Step i exchanges slots i and j(i) <= i, from the last slot down. Slot i ends with what slot
    j(i) held at that moment: the start of the chain of later steps that wrote to it. Chains are
    followed for all slots at once by pointer doubling.
    """
    placed = positions(per_model(docs, models), ["model_id"], "doc_id")
    u = D.unit("perm", design.root_seed, D.json_string("model_id"), D.number("pos"))
    steps = placed.select(
        "model_id", "size", F.col("pos").alias("i"),
        F.when(F.col("pos") == 0, F.lit(0).cast("bigint"))
        .otherwise(F.floor(u * (F.col("pos") + 1))).alias("j"),
    )
    same_slot = Window.partitionBy("model_id", "j").orderBy("i")
    steps = steps.withColumn("hop", F.lead("i").over(same_slot))
    writers = steps.where(F.col("i") > F.col("j")).groupBy("model_id", F.col("j").alias("k")).agg(
        F.min("i").alias("to"))
    jump = (
        steps.select("model_id", F.col("i").alias("k")).join(writers, ["model_id", "k"], "left")
        .select("model_id", "k", F.coalesce("to", "k").alias("to"))
    )
    while True:
        jump = cut(jump)
        far = jump.select("model_id", F.col("k").alias("to"), F.col("to").alias("_far"))
        nxt = jump.join(far, ["model_id", "to"])
        if nxt.where(F.col("_far") != F.col("to")).isEmpty():
            break
        jump = nxt.select("model_id", "k", F.col("_far").alias("to"))
    ends = jump.select("model_id", F.col("k").alias("hop"), F.col("to").alias("_end"))
    source = steps.join(ends, ["model_id", "hop"], "left").select(
        "model_id", "size", F.col("i").alias("slot"),
        F.coalesce("_end", "j").alias("pos"),
    )
    return source.join(placed.drop("size"), ["model_id", "pos"]).select(
        "model_id", "doc_id", F.col("slot").alias("pos"), "size"
    )


def expand(
    permutation: DataFrame,
    cells: Sequence[tuple[int, int]],
    mixes: Sequence[str],
    design: Design = Design(),
    phase: str = "sweep",
    n_runs: int | None = None,
    reruns: int | None = None,
    vary_seed: bool = False,
) -> DataFrame:
    """Planned runs of the given cells: one row per cell, index (and rerun).

    ``n_runs`` bounds the index; by default a cell has documents x epochs runs, and a rung-1 cell
    its own fixed number.
    """
    axis = F.array(*[
        F.struct(F.lit(t).alias("tools"), F.lit(f).alias("fault_pct")) for t, f in cells
    ])
    per_doc = F.col("size") * design.epochs
    limit = F.lit(n_runs).cast("bigint") if n_runs is not None else F.when(
        F.col("_cell.tools") == 1, F.lit(design.rung1_runs)).otherwise(per_doc)
    most = F.lit(n_runs).cast("bigint") if n_runs is not None else F.greatest(F.lit(design.rung1_runs).cast("bigint"), per_doc)
    last = F.ceil(most / F.col("size")) - 1
    # all cells share the seed of an index, so it is drawn before they part
    rows = (
        permutation.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("index", F.col("epoch") * F.col("size") + F.col("pos"))
        .withColumn("_seed", D.seed64("sample", design.root_seed, D.json_string("model_id"), D.number("index")))
        .withColumn("mix", F.explode(F.lit(list(mixes))))
        .withColumn("_cell", F.explode(axis))
        .where(F.col("index") < limit)
    )
    if reruns is not None:
        rows = rows.withColumn("rerun", F.explode(F.sequence(F.lit(0), F.lit(reruns - 1))))
    rerun = F.col("rerun") if reruns is not None else F.lit(None).cast("int")
    offset = rerun if vary_seed else F.lit(None).cast("int")
    seed_parts = (design.root_seed, D.json_string("model_id"), D.number("index"))
    seed = D.seed64("sample", *seed_parts, "varied", D.number(rerun)) if vary_seed else F.col("_seed")
    ident = run_id(
        F.col("model_id"), F.col("mix"), F.col("_cell.tools"), F.col("_cell.fault_pct"),
        F.col("index"), F.lit(phase), offset if vary_seed else None,
        rerun if reruns is not None and not vary_seed else None,
    )
    return rows.select(
        ident.alias("run_id"), "model_id", F.lit(phase).alias("phase"), "mix", "_cell.tools",
        "_cell.fault_pct", "index", "doc_id", "epoch", seed.alias("sample_seed"),
        offset.alias("seed_offset"), rerun.alias("rerun"),
        tool_list(F.col("mix"), F.col("_cell.tools"), design).alias("tool_list"),
    )


def sweep_cells(design: Design = Design()) -> list[tuple[int, int]]:
    return [(t, f) for t in design.tools_axis for f in design.fault_pct_axis]


def sweep_plan(permutation: DataFrame, design: Design = Design()) -> DataFrame:
    return expand(permutation, sweep_cells(design), list(design.mixes), design)


def probe_plan(permutation: DataFrame, mix: str, design: Design = Design()) -> DataFrame:
    cells = [(t, f) for t in design.probe_tools for f in design.probe_fault_pct]
    return expand(permutation, cells, [mix], design, "probe", design.probe_runs)


def gate_plan(permutation: DataFrame, mix: str, design: Design = Design()) -> DataFrame:
    return expand(permutation, [(2, 0)], [mix], design, "gate", design.gate_specs)


def noise_floor_plan(permutation: DataFrame, mix: str, design: Design = Design()) -> DataFrame:
    """Fixed-seed, varied-seed and hosted blocks in one table, told apart by ``protocol``."""
    fixed = expand(permutation, [design.floor_cell], [mix], design, "floor_fixed",
                   design.floor_fixed_documents, design.floor_fixed_reruns)
    varied = expand(permutation, [design.floor_cell], [mix], design, "floor_varied", None,
                    design.floor_varied_reruns, vary_seed=True)
    hosted = expand(permutation, list(design.hosted_cells), [mix], design, "floor_hosted",
                    design.hosted_documents, design.hosted_reruns)
    named = {"fixed_seed": fixed, "varied_seed": varied, "hosted_block": hosted}
    out = None
    for name, df in named.items():
        df = df.withColumn("protocol", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def round_robin(plan: DataFrame) -> DataFrame:
    """The i-th run of every cell before the (i+1)-th run of any."""
    return plan.orderBy("index", "mix", "tools", "fault_pct", "phase", "model_id")


def phase_counts(*plans: DataFrame) -> DataFrame:
    out = plans[0].select("model_id", "phase")
    for p in plans[1:]:
        out = out.unionByName(p.select("model_id", "phase"))
    return out.groupBy("model_id", "phase").agg(F.count(F.lit(1)).alias("runs"))


def planned_counts(design: Design, documents: int, hosted: bool = False) -> dict[str, int]:
    """The same counts in closed form from the design alone."""
    faults = len(design.fault_pct_axis)
    in_scope = sum(t >= 2 for t in design.tools_axis) * faults * documents * design.epochs
    rung1 = (1 in design.tools_axis) * faults * design.rung1_runs
    out = {
        "calibration": design.pilot_runs * len(design.difficulty_levels),
        "probe": len(design.probe_tools) * len(design.probe_fault_pct) * design.probe_runs,
        "sweep": (in_scope + rung1) * len(design.mixes),
    }
    if hosted:
        out["noise_floor"] = len(design.hosted_cells) * design.hosted_reruns * design.hosted_documents
    else:
        block = design.floor_fixed_documents or documents
        out["noise_floor"] = (
            design.floor_fixed_reruns * block + design.floor_varied_reruns * documents
        )
        out["determinism_gate"] = design.gate_specs * design.gate_replays * 3
    return out


def only_cells(plan: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rows of the cells given as ``TOOLS:FAULT`` texts."""
    pairs = []
    for text in wanted:
        tools, fault = text.split(":")
        pairs.append((F.col("tools") == int(tools)) & (F.col("fault_pct") == round(float(fault) * 100)))
    keep = F.lit(False)
    for p in pairs:
        keep = keep | p
    return plan.where(keep)


def not_recorded(plan: DataFrame, recorded: DataFrame) -> DataFrame:
    """Planned runs without a recorded row. Neither side is broadcast: the planner takes an exploded plan for a small table."""
    return plan.join(recorded.select("run_id").hint("merge"), "run_id", "left_anti")


def drift(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Recorded runs that the plan does not reproduce, with the reason.

    The plan is never broadcast: the planner takes an exploded table for a small one.
    """
    p = plan.select("run_id", F.col("doc_id").alias("_doc"), F.col("sample_seed").alias("_seed"))
    why = (
        F.when(F.col("_doc").isNull(), "run_id")
        .when(~F.col("doc_id").eqNullSafe(F.col("_doc")), "document")
        .when(~F.col("sample_seed").eqNullSafe(F.col("_seed")), "seed")
    )
    return (
        runs.select("run_id", "doc_id", "sample_seed").join(p.hint("merge"), "run_id", "left")
        .withColumn("differs", why).where("differs is not null").drop("_doc", "_seed")
    )


def model_role(provider: Column, base_url: Column) -> Column:
    """hosted, local or synthetic, from the provider name and the host it is served from."""
    rest = F.element_at(F.split(F.coalesce(base_url, F.lit("")), "://", 2), -1)
    host = F.regexp_extract(rest, r"^(\[[^\]]*\]|[^/:]*)", 1)
    local = host.isin("127.0.0.1", "localhost", "::1", "[::1]")
    return (
        F.when(provider == "synthetic", "synthetic")
        .when((provider != "anthropic") & local, "local").otherwise("hosted")
    )


def pairing_label(role: Column, gate_passed: Column) -> Column:
    return (
        F.when(role == "hosted", "in_expectation_hosted")
        .when(F.coalesce(gate_passed, F.lit(False)), "exact_invariant_stack")
        .otherwise("in_expectation_unverified_stack")
    )
