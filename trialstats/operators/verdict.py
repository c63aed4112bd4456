"""Mechanical decisions over joined result tables. The first rule that holds wins, and every
condition is kept beside the decision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions.intervals import drop_column, newcombe
from trialstats.operators.cells import G
from trialstats.rules import Rules

INF = math.inf


def drop_contrast(
    fit: DataFrame, cells: DataFrame, g: Sequence[str] = G, rules: Rules = Rules()
) -> DataFrame:
    """Rate of the drop column against the last column in the zero-fault row, in points.

    The zero row has one entry per tool count, so it is folded into a map per group instead of
    joining the cell table twice.
    """
    lo_t, hi_t = rules.peak_range
    row = cells.where((F.col("fault_pct") == rules.drop_fault_pct) & (F.col("n") > 0)).groupBy(*g).agg(
        F.map_from_entries(F.collect_list(F.struct("tools", F.struct("k", "n")))).alias("_row")
    )
    a = F.try_element_at("_row", F.col("drop_column"))
    b = F.try_element_at("_row", F.lit(hi_t))
    joined = (
        fit.withColumn("drop_column", drop_column("peak", lo_t, hi_t)).join(row, list(g), "left")
        .withColumn("_a", F.when(F.col("drop_column") != hi_t, a)).withColumn("_b", b)
    )
    lo, hi = newcombe("_a.k", "_a.n", "_b.k", "_b.n", rules.alpha)
    points = 100.0 * (F.col("_a.k") / F.col("_a.n") - F.col("_b.k") / F.col("_b.n"))
    return joined.select(
        *fit.columns, "drop_column", points.alias("drop_points"),
        (100.0 * lo).alias("drop_lo"), (100.0 * hi).alias("drop_hi"),
    )


def _condition(name: str, passed: Column, detail: str | Column, **values) -> Column:
    shown = F.create_map(
        *[e for k, v in values.items() for e in (F.lit(k), v.cast("double"))]
    ) if values else F.create_map().cast("map<string,double>")
    return F.struct(
        F.lit(name).alias("name"), shown.alias("value"), passed.alias("passed"),
        (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"),
    )


def verdict_p1(
    fit: DataFrame, boot: DataFrame, cells: DataFrame, g: Sequence[str] = G, rules: Rules = Rules()
) -> DataFrame:
    """First decision per group: not_estimable, blocked, survives, restricted, below_resolution."""
    lo_r, hi_r = rules.peak_range
    t = drop_contrast(fit, cells, g, rules).join(boot, list(g), "left")
    mle = F.col("status") == "mle"

    def limits(name: str) -> tuple[Column, Column]:
        pick = lambda side, default: F.when(mle, F.col(f"{name}_{side}")).otherwise(
            F.coalesce(F.col(f"boot_{name}_{side}"), F.lit(default))
        )
        return pick("lo", -INF), pick("hi", INF)

    b2_lo, b2_hi = limits("tc2")
    b3_lo, b3_hi = limits("f")
    estimable = F.col("status") != "not_estimable"
    cap_ok = (F.col("f") <= 0) | F.coalesce((b3_lo <= 0) & (b3_hi >= 0), F.lit(False))
    c1 = F.coalesce((F.col("tc2") < 0) & (b2_hi < 0), F.lit(False))
    c2 = F.coalesce(
        (F.col("boot_peak_lo") >= lo_r) & (F.col("boot_peak_hi") <= hi_r), F.lit(False)
    )
    c3 = F.coalesce(F.col("peak").isNotNull() & (F.col("drop_lo") > 0), F.lit(False))
    small = F.coalesce(F.col("drop_hi") < rules.sesoi_points, F.lit(False))
    outside = F.coalesce(
        (F.col("boot_peak_hi") < lo_r) | (F.col("boot_peak_lo") > hi_r), F.lit(False)
    )
    restricted = F.coalesce(b2_lo > 0, F.lit(False)) | outside | small
    swallowed = F.coalesce(
        (b2_lo <= 0) & (b2_hi >= 0) & (F.col("drop_lo") <= 0) & (F.col("drop_hi") >= 0)
        & (F.col("drop_lo") <= rules.sesoi_points) & (F.col("drop_hi") >= rules.sesoi_points),
        F.lit(False),
    )
    survives = c1 & c2 & c3
    verdict = (
        F.when(~estimable, "not_estimable").when(~cap_ok, "blocked").when(survives, "survives")
        .when(restricted, "restricted").otherwise("below_resolution")
    )
    unknown = F.lit(None).cast("boolean")
    read = [
        _condition("fault_cap", cap_ok, "fault slope <= 0 or its interval includes 0", b3=F.col("f")),
        _condition("C1_curvature", c1, "b2 < 0 with its interval excluding 0",
                   b2=F.col("tc2"), lo=b2_lo, hi=b2_hi),
        _condition("C2_peak", c2, f"bootstrap interval inside [{lo_r}, {hi_r}]",
                   peak=F.col("peak"), lo=F.col("boot_peak_lo"), hi=F.col("boot_peak_hi")),
        _condition("C3_drop", c3, "difference to the last column excludes 0 in the zero row",
                   column=F.col("drop_column"), points=F.col("drop_points"),
                   lo=F.col("drop_lo"), hi=F.col("drop_hi")),
    ]
    closing = (
        F.when(survives, F.array().cast(_conditions_type()))
        .when(restricted, F.array(_condition(
            "restricted_reason", unknown,
            "b2 interval above 0, or peak interval outside the range, or drop below the margin")))
        .when(swallowed, F.array(_condition(
            "sesoi_equivalence", F.lit(True), "intervals include 0 and the margin")))
        .otherwise(F.array(_condition("residual_branch", unknown, "no named branch matched")))
    )
    conditions = (
        F.when(~estimable, F.array(_condition("estimable", F.lit(False), F.coalesce("reason", F.lit("not estimable")))))
        .when(~cap_ok, F.array(read[0]))
        .otherwise(F.concat(F.array(*read), closing))
    )
    decided = estimable & cap_ok
    shown = lambda c: F.when(decided, F.col(c)).alias(c)
    return t.select(
        *g, verdict.alias("verdict"), F.col("status").alias("estimator"),
        shown("peak"), shown("boot_peak_lo"), shown("boot_peak_hi"),
        shown("drop_column"), shown("drop_points"), shown("drop_lo"), shown("drop_hi"),
        (decided & ~survives & ~restricted & ~swallowed).alias("residual"),
        conditions.alias("conditions"),
    )


def _conditions_type() -> str:
    return "array<struct<name:string,value:map<string,double>,passed:boolean,detail:string>>"


def verdict_p2(recovery: DataFrame, g: Sequence[str] = G, rules: Rules = Rules()) -> DataFrame:
    """Second decision per group from the recovery interval."""
    none = F.coalesce(F.col("n_pairs"), F.lit(0)) == 0
    lo, hi = F.col("lo"), F.col("hi")
    verdict = (
        F.when(none, "not_estimable").when(lo > 0, "survives")
        .when(hi < rules.sesoi_turns, "restricted").otherwise("below_resolution")
    )
    conditions = F.when(
        none, F.array(_condition("n_pairs", F.lit(False), "no recovered faulted run with a control"))
    ).otherwise(F.array(
        _condition("lower_bound_above_zero", lo > 0, "survives when true", lo=lo),
        _condition("interval_includes_zero", (lo <= 0) & (hi >= 0), "", lo=lo, hi=hi),
        _condition("upper_below_sesoi", hi < rules.sesoi_turns, "below the margin in turns", hi=hi),
        _condition("n_pairs", F.lit(None).cast("boolean"), "recovered runs only",
                   n=F.col("n_pairs")),
    ))
    return recovery.select(
        *g, verdict.alias("verdict"), "r", "lo", "hi", "n_pairs", conditions.alias("conditions")
    )


def fixed(value: Column, places: int, signed: bool = False) -> Column:
    """Fixed-point text of a double with ``inf`` and ``nan`` spelled in lower case."""
    text = F.format_string(f"%{'+' if signed else ''}.{places}f", value)
    return (
        F.when(F.isnan(value), "nan")
        .when(value == INF, "+inf" if signed else "inf").when(value == -INF, "-inf")
        .otherwise(text)
    )


def _interval(lo: str, hi: str, places: int = 1) -> Column:
    both = F.concat(
        F.lit("["), fixed(F.col(lo), places), F.lit(", "), fixed(F.col(hi), places), F.lit("]")
    )
    return F.when(F.col(lo).isNull(), "[n/a]").otherwise(both)


def statements(
    p1: DataFrame, p2: DataFrame, instrument: DataFrame, dates: DataFrame, snapshot: str,
    g: Sequence[str] = G, reading: str | None = None,
) -> DataFrame:
    """One line of text per group in the fixed pipe-separated format, and whether it moves."""
    words = lambda c: F.regexp_replace(c, "_", " ")
    a = p1.select(*g, *[F.col(c).alias(f"a_{c}") for c in (
        "verdict", "peak", "boot_peak_lo", "boot_peak_hi", "drop_points", "drop_lo", "drop_hi")])
    b = p2.select(*g, *[F.col(c).alias(f"b_{c}") for c in ("verdict", "r", "lo", "hi")])
    t = (
        instrument.select(*g, "ok", "label").join(a, list(g)).join(b, list(g), "left")
        .join(dates.select(*g, "last_date"), list(g), "left")
    )
    peak = F.when(F.col("a_peak").isNull(), "peak undefined").otherwise(F.concat(
        F.lit("peak "), fixed(F.col("a_peak"), 1), F.lit(" tools "),
        _interval("a_boot_peak_lo", "a_boot_peak_hi")))
    drop = F.when(F.col("a_drop_points").isNull(), "drop undefined").otherwise(F.concat(
        F.lit("drop "), fixed(F.col("a_drop_points"), 0), F.lit(" points "),
        _interval("a_drop_lo", "a_drop_hi", 0)))
    one = F.concat(F.lit("P1: "), words(F.col("a_verdict")))
    one = F.when(F.col("a_verdict").isin("not_estimable", "blocked"), one).otherwise(
        F.concat(one, F.lit(" ("), peak, F.lit("; "), drop, F.lit(")")))
    p2_verdict = F.coalesce(F.col("b_verdict"), F.lit("not_estimable"))
    two = F.when(p2_verdict == "not_estimable", "P2: not estimable").otherwise(F.concat(
        F.lit("P2: "), words(p2_verdict), F.lit(" ("), fixed(F.col("b_r"), 1, True),
        F.lit(" turns "), _interval("b_lo", "b_hi"), F.lit(")")))
    head = F.concat_ws(
        " | ", F.coalesce(F.col("last_date"), F.lit("undated")), F.lit(snapshot), F.col("model_id"),
        F.concat(F.lit("mix "), F.col("mix")),
    )
    line = F.when(F.col("ok"), F.concat_ws(" | ", head, one, two)).otherwise(
        F.concat(head, F.lit(" | "), F.col("label"), F.lit(": neither proposition moves")))
    if reading is not None:
        line = F.concat(F.lit(f"DESCRIPTIVE ({reading}) | "), line)
    moves = F.col("ok") if reading is None else F.lit(False)
    return t.select(*g, line.alias("statement"), moves.alias("moves"))


def drop_reading(p1: DataFrame, g: Sequence[str] = G, rules: Rules = Rules()) -> DataFrame:
    """The drop against its margin in words."""
    m = f"{rules.sesoi_points:g}"
    words = (
        F.when(F.col("drop_points").isNull(),
               "no drop is defined: the fit has no interior peak, so there is no peak to drop from")
        .when(F.col("drop_lo") >= rules.sesoi_points, f"the drop is at least the {m}-point margin")
        .when(F.col("drop_hi") < rules.sesoi_points,
              f"the drop is smaller than the {m}-point margin")
        .otherwise(f"the drop cannot be told apart from the {m}-point margin")
    )
    return p1.select(*g, "verdict", "drop_points", "drop_lo", "drop_hi", words.alias("reading"))


def reading_differs(registered: DataFrame, other: DataFrame, g: Sequence[str] = G) -> DataFrame:
    """Whether a descriptive reading decides differently from the registered one."""
    return registered.select(*g, F.col("verdict").alias("registered")).join(
        other.select(*g, F.col("verdict").alias("reading")), list(g)
    ).withColumn("differs", F.col("registered") != F.col("reading"))
