"""Trials of known truth, coverage of the intervals on them, and structured invoices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions import draws as D
from trialstats.functions.intervals import sigmoid
from trialstats.operators import cells as C
from trialstats.plans.analysis import first_decision
from trialstats.rules import Design, Rules, Truth

SNAP = ("snapshot", "model_id", "mix")


def document_effects(docs: DataFrame, truth: Truth) -> DataFrame:
    """Add the document effect to (scope, d): scope names the snapshot, d numbers its documents."""
    effect = F.lit(truth.document_sd) * D.normal(
        "sim-doc", D.json_string("scope"), truth.name, D.number("d"))
    return docs.withColumn("gamma", effect)


def _eta(truth: Truth):
    tc = F.col("tools") - F.lit(4.0)
    return (
        F.lit(truth.b0) + F.lit(truth.b1) * tc + F.lit(truth.b2) * tc * tc
        + F.lit(truth.b3) * F.col("fault_pct") / F.lit(100.0)
    )


def simulate(docs: DataFrame, truth: Truth, epochs: int = 1, design: Design = Design(),
             mix: str = "A", turns: int = 3) -> DataFrame:
    """Full grid of trials for every (scope, d); dose 1 never succeeds."""
    rows = (
        document_effects(docs, truth)
        .withColumn("tools", F.explode(F.lit(list(design.tools_axis))))
        .withColumn("fault_pct", F.explode(F.lit(list(design.fault_pct_axis))))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    )
    u = D.unit(
        "sim-run", D.json_string("scope"), truth.name, D.number("d"), D.number("epoch"),
        D.number("tools"), D.number("fault_pct"),
    )
    success = (F.col("tools") >= 2) & (u < sigmoid(_eta(truth) + F.col("gamma")))
    ident = F.concat_ws("-", F.lit("sim"), "scope", "tools", "fault_pct", "epoch", "d")
    return rows.select(
        F.col("scope").alias("snapshot"), ident.alias("run_id"), F.lit("sim").alias("model_id"),
        F.lit("sweep").alias("phase"), F.lit(mix).alias("mix"), "tools", "fault_pct",
        F.concat(F.lit("inv-"), F.lpad((F.col("d") + 1).cast("string"), 12, "0")).alias("doc_id"),
        "epoch", F.when(success, "submitted").otherwise("no_submission").alias("outcome"),
        success.alias("success"), success.cast("double").alias("score"), F.lit(turns).alias("turns"),
        F.lit(1.0).alias("seconds"), F.lit(0).alias("n_faults"),
        F.lit(None).cast("string").alias("first_fault_kind"),
        F.lit(None).cast("boolean").alias("recovered"),
        F.lit(None).cast("string").alias("abort_cause"),
    )


def true_rates(docs: DataFrame, truth: Truth, design: Design = Design()) -> DataFrame:
    """Mean success probability over the documents of each snapshot, per cell."""
    rows = (
        document_effects(docs, truth)
        .withColumn("tools", F.explode(F.lit(list(design.tools_axis))))
        .withColumn("fault_pct", F.explode(F.lit(list(design.fault_pct_axis))))
    )
    p = F.when(F.col("tools") < 2, 0.0).otherwise(sigmoid(_eta(truth) + F.col("gamma")))
    return rows.groupBy(F.col("scope").alias("snapshot"), "tools", "fault_pct").agg(
        (F.sum(p.cast("decimal(20,15)")).cast("double") / F.count(F.lit(1))).alias("true_rate"))


def wilson_coverage(cells: DataFrame, rates: DataFrame, by: Sequence[str] = ("tools", "fault_pct")) -> DataFrame:
    """Share of in-scope cells whose interval covers the true rate."""
    hit = F.col("true_rate").between(F.col("lo"), F.col("hi"))
    return (
        cells.where("in_scope").join(rates, ["snapshot", "tools", "fault_pct"])
        .groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_if(hit).alias("covered"))
        .withColumn("coverage", F.col("covered") / F.col("cells"))
    )


def coverage_experiment(
    docs: DataFrame, truth: Truth, snapshot_id: str, epochs: int = 1, rules: Rules = Rules(),
    design: Design = Design(),
) -> DataFrame:
    """One row: coverage, power or false survival, and verdict counts over all snapshots.

    The snapshot is part of the grouping key, so the whole experiment is one run of the analysis.
    """
    runs = simulate(docs, truth, epochs, design)
    p1 = first_decision(runs, snapshot_id, SNAP, rules, design)
    wilson = wilson_coverage(p1.cells, true_rates(docs, truth, design), by=())
    t = p1.verdict.join(p1.boot.select(*SNAP, "failed_fraction"), list(SNAP), "left")
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    survived = share(F.col("verdict") == "survives")
    none = F.lit(None).cast("double")
    peaked = truth.peak is not None
    covers = F.lit(truth.peak).between(F.col("boot_peak_lo"), F.col("boot_peak_hi")) if peaked else F.lit(False)
    out = t.agg(
        F.count(F.lit(1)).alias("snapshots"),
        (share(covers) if peaked else none).alias("peak_coverage"),
        (none if peaked else survived).alias("false_survival"),
        (survived if peaked else none).alias("power"),
        share(F.col("verdict") == "not_estimable").alias("not_estimable_rate"),
        share(F.col("estimator") == "firth").alias("firth_rate"),
        F.avg(F.coalesce("failed_fraction", F.lit(0.0))).alias("mean_failed_fraction"),
        share(F.col("residual")).alias("residual_rate"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in (
            "survives", "restricted", "below_resolution", "blocked")],
    )
    coverage = wilson.select("coverage").scalar()
    return out.select(F.lit(truth.name).alias("truth"), coverage.alias("wilson_coverage"), "*")


# Fixed values of the invoice generator.
CATALOGUE = (
    ("A4 copy paper", "4.25"), ("Ballpoint pens", "12.00"), ("Heavy duty stapler", "24.99"),
    ("Whiteboard markers", "7.10"), ("Desk lamp", "39.50"), ("Archive boxes", "3.75"),
    ("Label printer", "89.00"), ("Packing tape", "2.15"), ("Cable organizer", "6.40"),
    ("Notebook, ruled", "1.95"),
)
CURRENCIES = ("USD", "EUR", "GBP")
TAX_RATES = ("0.00", "0.07", "0.19", "0.20")


def invoices(numbers: DataFrame, seed: int, level: int = 4, id_column: str = "n") -> DataFrame:
    """Structured invoices, one per row: items without replacement, amounts rounded half up, tax,
    shipping and totals. Every value is a hashed draw of the document number."""
    at = lambda *field: D.unit("dataset", seed, level, D.number(id_column), *field)
    money = "decimal(18,2)"
    choices = F.array(*[
        F.struct(
            at("item-order", i).alias("u"), F.lit(name).alias("description"),
            F.lit(price).cast(money).alias("unit_price"),
            D.integer(at("quantity", i), 1, 12).cast("int").alias("quantity"),
        )
        for i, (name, price) in enumerate(CATALOGUE)
    ])
    n_items = D.integer(at("n_items"), 2, 6).cast("int")
    line = lambda c: F.struct(
        c["description"].alias("description"), c["quantity"].alias("quantity"),
        c["unit_price"].alias("unit_price"),
        F.round(c["unit_price"] * c["quantity"], 2).cast(money).alias("amount"))
    drawn = numbers.select(
        "*", F.transform(F.slice(F.array_sort(choices), F.lit(1), n_items), line).alias("line_items"),
        D.pick(at("tax"), TAX_RATES).cast("decimal(4,2)").alias("tax_rate"),
        F.when(D.chance(at("has_shipping"), 0.4),
               (D.integer(at("shipping"), 495, 2995) / 100).cast(money)).otherwise(F.lit(0).cast(money)).alias("shipping"),
        D.pick(at("currency"), CURRENCIES).alias("currency"),
        F.date_add(F.lit("2025-01-01").cast("date"), D.integer(at("date"), 0, 364).cast("int")).alias("invoice_date"),
        F.format_string("INV-%s-%04d", F.lpad(F.col(id_column).cast("string"), 8, "0"),
                        D.integer(at("number"), 1000, 9999)).alias("invoice_number"),
    )
    subtotal = F.aggregate("line_items", F.lit(0).cast("decimal(28,2)"),
                           lambda acc, i: (acc + i["amount"]).cast("decimal(28,2)"))
    t = drawn.withColumn("subtotal", subtotal.cast(money))
    t = t.withColumn("tax", F.round(F.col("subtotal") * F.col("tax_rate"), 2).cast(money))
    return t.withColumn("total_amount", (F.col("subtotal") + F.col("tax") + F.col("shipping")).cast(money))


def reconcile(items: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Invoices whose items do not add up to the subtotal, or whose parts miss the total."""
    sums = items.groupBy(key).agg(F.sum("amount").alias("_items"), F.count(F.lit(1)).alias("items"))
    off_sub = ~F.coalesce(F.col("_items"), F.lit(0)).eqNullSafe(F.col("subtotal"))
    off_total = ~(F.col("subtotal") + F.col("tax") + F.col("shipping")).eqNullSafe(F.col("total_amount"))
    return totals.join(sums, key, "left").select(
        key, F.coalesce("items", F.lit(0)).alias("items"),
        F.coalesce(F.col("_items"), F.lit(0)).alias("item_sum"), "subtotal", "total_amount",
        off_sub.alias("subtotal_off"), off_total.alias("total_off"),
    )
