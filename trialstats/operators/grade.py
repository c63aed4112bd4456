"""Grading of structured submissions against gold records, row by row inside Spark.

A submission is a VARIANT: any JSON type may stand in any field. All matching happens inside the
row with array expressions, so grading needs no shuffle beyond the join that brings the gold record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.functions import text as T
from trialstats.functions import values as V
from trialstats.rules import ABORTED, Rules

# Field weights and the similarity threshold 3/5.
WEIGHTS = {
    "invoice_number": 2, "invoice_date": 1, "vendor_name": 1, "currency": 1, "total_amount": 2,
    "line_items": 3,
}
SIMILAR = (3, 5)

GOLD_ITEM = "struct<description:string,quantity:decimal(38,10),unit_price:decimal(38,10),amount:decimal(38,10)>"
GOLD_TYPE = (
    "struct<invoice_number:string,invoice_date:string,vendor_name:string,currency:string,"
    f"total_amount:decimal(38,10),line_items:array<{GOLD_ITEM}>>"
)
NO_ITEMS = "array<struct<g:int,s:int>>"


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column, name: str) -> Column:
    """Text of a scalar field. Booleans, numbers and strings have one; null and containers do not."""
    kind = _type(_field(v, name))
    held = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(~F.coalesce(held, F.lit(False)), F.try_variant_get(v, f"$.{name}", "string"))


def _amount_text(v: Column, name: str) -> Column:
    """Text to read an amount from; booleans and containers have none."""
    return F.when(_type(_field(v, name)) != "BOOLEAN", _text(v, name))


def _number(v: Column, name: str) -> Column:
    """Numbers are taken as they are; only strings go through the amount reader."""
    kind = _type(_field(v, name))
    numeric = (kind != "STRING") & (kind != "BOOLEAN")
    return F.when(numeric, _text(v, name).try_cast(V.AMOUNT))


def _indexes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _copies(texts: Column) -> Column:
    """Each text with the number of equal texts before it, so equal copies pair up in order."""
    return F.transform(texts, lambda t, i: F.concat(
        F.size(F.filter(F.slice(texts, F.lit(1), i), lambda x: x == t)).cast("string"), F.lit(":"), t))


def pair_items(gold: Column, sub: Column) -> Column:
    """(gold index, submitted index) pairs of two arrays of normalized descriptions.

    First equal texts (the k-th copy with the k-th copy), then token overlap of at least 3/5 taken
    in order of similarity, gold index and submitted index. Overlaps are computed only between
    items the first pass left over. Arrays used inside a lambda are bound once with ``let``.
    """
    num, den = SIMILAR

    def exact(g: Column, s: Column) -> Column:
        found = T.let(_copies(s), lambda sk: F.transform(_copies(g), lambda k, i: F.struct(
            i.alias("g"), (F.array_position(sk, k) - 1).cast("int").alias("s"))))
        return F.filter(found, lambda p: (p["s"] >= 0) & (F.get(g, p["g"]) != "")).cast(NO_ITEMS)

    def similar(g: Column, s: Column, pairs: Column) -> Column:
        free_g = F.array_except(_indexes(F.size(g)), F.transform(pairs, lambda p: p["g"]))
        free_s = F.filter(
            F.array_except(_indexes(F.size(s)), F.transform(pairs, lambda p: p["s"])),
            lambda i: F.get(s, i) != "")
        words = lambda free, texts: F.transform(free, lambda i: F.struct(
            i.alias("i"), T.tokens(F.get(texts, i)).alias("t")))

        def one(x: Column, y: Column) -> Column:
            return T.let(F.size(F.array_intersect(x["t"], y["t"])), lambda n: F.struct(
                (-n / F.greatest(F.size(x["t"]) + F.size(y["t"]) - n, F.lit(1))).alias("order"),
                x["i"].alias("g"), y["i"].alias("s"),
                ((n > 0) & (n * den >= (F.size(x["t"]) + F.size(y["t"]) - n) * num)).alias("near")))

        cands = T.let(words(free_s, s), lambda st: F.flatten(F.transform(
            words(free_g, g),
            lambda x: F.filter(F.transform(st, lambda y: one(x, y)), lambda c: c["near"]))))
        return F.aggregate(
            F.array_sort(cands), pairs,
            lambda acc, c: F.when(
                F.exists(acc, lambda p: (p["g"] == c["g"]) | (p["s"] == c["s"])), acc
            ).otherwise(F.array_append(acc, F.struct(c["g"].alias("g"), c["s"].alias("s")))),
        )

    return T.let(gold, lambda g: T.let(sub, lambda s: T.let(
        exact(g, s), lambda pairs: similar(g, s, pairs))))


def score(df: DataFrame) -> DataFrame:
    """Add ``score``, ``per_field`` and ``notes`` to rows with ``submission`` and ``gold``."""
    v, gold = F.col("submission"), F.col("gold")
    is_object = F.coalesce(_type(v).startswith("OBJECT"), F.lit(False))
    items = F.try_variant_get(v, "$.line_items", "array<variant>")
    item_of = lambda it: F.struct(
        _text(it, "description").alias("description"),
        *[_amount_text(it, n).alias(n) for n in ("quantity", "unit_price", "amount")],
        *[_number(it, n).alias(f"{n}_n") for n in ("quantity", "unit_price", "amount")],
    )
    t = (
        df.withColumn("_items", F.when(is_object, F.transform(items, item_of)))
        .withColumn("_gold", F.coalesce(gold["line_items"], F.array().cast(f"array<{GOLD_ITEM}>")))
        .withColumn("_sd", T.fold_all(F.transform("_items", lambda i: i["description"])))
        .withColumn("_gd", T.fold_all(F.transform("_gold", lambda i: i["description"])))
        .withColumn("sub_desc", F.coalesce(
            F.transform("_sd", lambda d: T.tidy(F.coalesce(d, F.lit("")))), F.array().cast("array<string>")))
        .withColumn("gold_desc", F.transform("_gd", lambda d: T.tidy(F.coalesce(d, F.lit("")))))
    )
    t = t.withColumn("pairs", pair_items(F.col("gold_desc"), F.col("sub_desc")))
    texts = lambda n: F.transform("_items", lambda i: i[n])
    for n in ("quantity", "unit_price", "amount"):
        t = t.withColumn(f"_{n}", T.fold_all(texts(n)))

    names = ("quantity", "unit_price", "amount")

    def parsed(n: str) -> Column:
        """Amounts of one item field: numbers as they are, strings through the reader."""
        return F.zip_with(
            F.transform("_items", lambda i: i[f"{n}_n"]), F.col(f"_{n}"),
            lambda number, text: F.coalesce(number, V.amount_of_folded(text)))

    def quarters_of(gold_items, q, u, a) -> Column:
        def one(p: Column) -> Column:
            g = F.get(gold_items, p["g"])
            hits = [V.amounts_match(F.get(c, p["s"]), g[n]).cast("int") for c, n in zip((q, u, a), names)]
            return hits[0] + hits[1] + hits[2] + 1

        return F.aggregate(F.transform("pairs", one), F.lit(0), lambda acc, x: acc + x)

    quarters = T.let(F.col("_gold"), lambda gi: T.let(parsed("quantity"), lambda q: T.let(
        parsed("unit_price"), lambda u: T.let(parsed("amount"), lambda a: quarters_of(gi, q, u, a)))))
    longest = F.greatest(F.size("gold_desc"), F.size("sub_desc"))
    listed = F.col("_items").isNotNull()
    item_credit = F.when(~listed, 0.0).when(longest == 0, 1.0).otherwise(quarters / 4.0 / longest)

    t = t.withColumns({
        "_number": T.normalize_string(_text(v, "invoice_number")),
        "_vendor": T.normalize_string(_text(v, "vendor_name")),
        "_date": V.normalize_date(_text(v, "invoice_date")),
        "_code": V.normalize_currency(_text(v, "currency")),
        "_total": F.coalesce(
            _number(v, "total_amount"), V.normalize_amount(_amount_text(v, "total_amount"))),
        "_credit": item_credit,
    })
    match = {
        "invoice_number": (F.col("_number") != "")
        & (F.col("_number") == T.normalize_string(gold["invoice_number"])),
        "invoice_date": F.col("_date") == V.normalize_date(gold["invoice_date"]),
        "vendor_name": (F.col("_vendor") != "")
        & (F.col("_vendor") == T.normalize_string(gold["vendor_name"])),
        "currency": (F.col("_code") != "") & (F.col("_code") == V.normalize_currency(gold["currency"])),
        "total_amount": V.amounts_match(F.col("_total"), gold["total_amount"]),
    }
    credit, note = {}, {}
    for name in WEIGHTS:
        there = is_object & _field(v, name).isNotNull()
        if name == "line_items":
            c = F.when(there, F.col("_credit")).otherwise(0.0)
            words = F.when(~listed, "not a list").when(longest == 0, "both empty").otherwise(
                F.format_string("%d of %d gold items matched; %d submitted", F.size("pairs"),
                                F.size("gold_desc"), F.size("sub_desc")))
        else:
            hit = F.coalesce(match[name], F.lit(False))
            c = F.when(there & hit, 1.0).otherwise(0.0)
            words = F.when(hit, "match").otherwise("mismatch")
        credit[name], note[name] = c, F.when(~there, "missing").otherwise(words)
    graded = t.withColumn("per_field", F.create_map(
        *[e for n, c in credit.items() for e in (F.lit(n), c)])
    ).withColumn("notes", F.create_map(*[e for n, c in note.items() for e in (F.lit(n), c)]))
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(float(weight)) * F.col("per_field")[name]
    out = graded.withColumn("score", total / float(sum(WEIGHTS.values())))
    return out.select(*df.columns, "score", "per_field", "notes")


def grade_runs(runs: DataFrame, gold: DataFrame, rules: Rules = Rules(),
               small: bool = False) -> DataFrame:
    """Score every run against the gold record of its document; aborted runs stay ungraded.

    A run whose document has no gold record stays, with ``grading`` missing_gold and no score.
    """
    lookup = F.broadcast(gold) if small else gold
    scored = score(runs.drop("score", "per_field", "success").join(lookup, "doc_id", "left"))
    grading = (
        F.when(F.col("outcome") == ABORTED, "aborted").when(F.col("gold").isNull(), "missing_gold").otherwise("graded"))
    graded = F.col("grading") == "graded"
    return scored.withColumn("grading", grading).withColumns({
        "success": F.when(graded, F.col("score") >= rules.tau),
        "score": F.when(graded, F.col("score")),
        "per_field": F.when(graded, F.col("per_field")),
    }).drop("gold")


def regrade_audit(runs: DataFrame, transcripts: DataFrame, gold: DataFrame,
                  rules: Rules = Rules()) -> DataFrame:
    """Status of every graded run against its transcript and a fresh grading."""
    from trialstats.operators.transcripts import accepted_submission

    stored = runs.where(F.col("success").isNotNull())
    read = transcripts.select("run_id", accepted_submission(F.col("messages")).alias("_acc"),
                              F.lit(True).alias("_there"))
    joined = stored.join(read, "run_id", "left")
    record = F.try_parse_json(F.get_json_object(F.col("_acc.arguments_text"), "$.record"))
    flat = joined.withColumns({
        "_stored": F.col("score"), "_success": F.col("success"),
        "_missing": F.col("_there").isNull(),
        "_record": F.to_json(record),
        "_kept": F.to_json(F.col("submission")),
    }).drop("score", "success", "per_field", "_acc", "_there")
    again = score(flat.join(gold, "doc_id", "left"))
    near = F.abs(F.col("score") - F.col("_stored")) <= F.greatest(
        F.lit(1e-9) * F.greatest(F.abs("score"), F.abs("_stored")), F.lit(1e-12))
    status = (
        F.when(F.col("_missing"), "missing_transcript").when(F.col("gold").isNull(), "missing_gold")
        .when(~F.col("_record").eqNullSafe(F.col("_kept")), "submission_mismatch")
        .when(~near | ((F.col("score") >= rules.tau) != F.col("_success")), "score_mismatch")
        .otherwise("ok")
    )
    return again.select("run_id", status.alias("status"), F.col("_stored").alias("recorded"),
                        F.when(F.col("gold").isNotNull(), F.col("score")).alias("regraded"))
