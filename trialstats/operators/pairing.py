"""Pairing of submitted items with gold items over tables of items, for records of any length.

The rule is that of ``grade.pair_items``: equal texts first, the k-th copy with the k-th copy; then token overlap of at
least 3/5, taken in order of overlap, gold item and submitted item. There one row holds a record; here one row holds an
item, and a record with millions of items is work for many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.functions import text as T
from trialstats.operators.grade import SIMILAR
from trialstats.plans.scale import positions
from trialstats.session import cut


def _exact(gold: DataFrame, sub: DataFrame) -> DataFrame:
    """The k-th copy of a text with the k-th copy of it."""
    g = positions(gold.where("text <> ''"), ["record", "text"], "g").select("record", "text", "pos", "g")
    s = positions(sub.where("text <> ''"), ["record", "text"], "s").select("record", "text", "pos", "s")
    return g.join(s, ["record", "text", "pos"]).select("record", "g", "s")


def _classes(items: DataFrame, item: str, name: str) -> DataFrame:
    """Items that are left, in classes of equal token sets: record, class (its first item), pos in it, item, size, set."""
    sets = items.select("record", item, F.array_sort(T.tokens(F.col("text"))).alias("set")).where("size(set) > 0")
    first = sets.groupBy("record", "set").agg(F.min(item).alias(name))
    return cut(positions(sets, ["record", "set"], item).join(first, ["record", "set"]).drop("set").join(
        first, ["record", name]))


def _candidates(gold: DataFrame, sub: DataFrame) -> DataFrame:
    """Pairs of classes whose sets overlap enough, by inverted lists of each set's rarest tokens.

    Two sets with an overlap of 3/5 share one of the first n - ceil(3n/5) + 1 tokens of each, in one order of tokens;
    in that of rising frequency the lists are short.
    """
    num, den = SIMILAR
    a = gold.where("pos = 0").select("record", "a", "set")
    b = sub.where("pos = 0").select("record", "b", "set")
    words = [x.select("record", F.col(n).alias("id"), F.lit(n).alias("side"), "set", F.explode("set").alias("token"))
             for n, x in (("a", a), ("b", b))]
    words = words[0].unionAll(words[1])
    often = words.groupBy("record", "token").agg(F.count("*").alias("sets"))
    ranked = words.join(often, ["record", "token"]).groupBy("record", "side", "id").agg(
        F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("by"))  # a set's own tokens, as many as it has
    keep = F.size("by") - F.ceil(F.size("by") * num / den) + 1
    lists = ranked.select("record", "side", "id", F.explode(F.slice("by", F.lit(1), keep.cast("int"))["token"]).alias("token"))
    lists = cut(lists)
    met = lists.where("side = 'a'").select("record", "token", F.col("id").alias("a")).join(
        lists.where("side = 'b'").select("record", "token", F.col("id").alias("b")), ["record", "token"])
    met = met.select("record", "a", "b").distinct()
    pairs = met.join(a.withColumnRenamed("set", "x"), ["record", "a"]).join(b.withColumnRenamed("set", "y"), ["record", "b"])
    shared, total = T.overlap(F.col("x"), F.col("y"))
    return pairs.where(shared * den >= total * num).select("record", "a", "b", (shared / total).alias("near"))


def _first(order: list[Column], *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1


def _round(pairs: DataFrame) -> DataFrame:
    """Pairs of classes that are each other's best, with the number of items they take from each other now.

    Members of a class differ in their number only, and go in its order. A pair that leads on both sides without a tie
    takes all it can at once, any other takes its first items.
    """
    top_a, top_b = (F.max("near").over(Window.partitionBy("record", n)) for n in ("a", "b"))
    seen = pairs.withColumns({"_ta": top_a, "_tb": top_b})
    alone = [F.sum((F.col("near") == F.col(t)).cast("int")).over(Window.partitionBy("record", n)) == 1
             for n, t in (("a", "_ta"), ("b", "_tb"))]
    seen = seen.withColumns({
        "_alone": alone[0] & alone[1], "_fa": _first([F.desc("near"), F.col("s")], "record", "a"),
        "_fb": _first([F.desc("near"), F.col("g")], "record", "b")})
    amount = F.when(F.col("_alone"), F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))).otherwise(F.lit(1))
    return seen.where("_fa and _fb").select("record", "a", "b", "ua", "ub", amount.cast("bigint").alias("taken"))


def _matched(gold: DataFrame, sub: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rounds over classes that still have items and partners; a pair of locally best items is one of the greedy order."""
    heads_a = gold.select("record", "a", F.col("pos").alias("ua"), "g", F.col("size").alias("na"))
    heads_b = sub.select("record", "b", F.col("pos").alias("ub"), "s", F.col("size").alias("nb"))
    zero = F.lit(0).cast("bigint")
    live = cut(candidates.withColumns({"ua": zero, "ub": zero}))
    taken: list[DataFrame] = []
    while not live.isEmpty():
        now = cut(_round(live.join(heads_a, ["record", "a", "ua"]).join(heads_b, ["record", "b", "ub"])))
        taken.append(now)
        for name, used in (("a", "ua"), ("b", "ub")):
            live = live.join(now.select("record", name, F.col("taken").alias("_t")), ["record", name], "left")
            live = live.withColumn(used, F.col(used) + F.coalesce("_t", zero)).drop("_t")
        # a class without items left has no head
        live = cut(live.join(heads_a, ["record", "a", "ua"], "left_semi").join(heads_b, ["record", "b", "ub"], "left_semi"))
    if not taken:
        return gold.sparkSession.createDataFrame([], f"record {candidates.schema['record'].dataType.simpleString()}, "
                                                 f"g {gold.schema['g'].dataType.simpleString()}, s {sub.schema['s'].dataType.simpleString()}")
    runs = reduce(DataFrame.unionAll, taken).withColumn("_k", F.explode(F.sequence(zero, F.col("taken") - 1)))
    runs = runs.withColumns({"ua": F.col("ua") + F.col("_k"), "ub": F.col("ub") + F.col("_k")})
    return runs.join(heads_a, ["record", "a", "ua"]).join(heads_b, ["record", "b", "ub"]).select("record", "g", "s")


def item_pairs(gold: DataFrame, sub: DataFrame) -> DataFrame:
    """record, g, s and exact of the matched items of ``gold`` (record, g, text) and ``sub`` (record, s, text).

    Texts are in comparison form (``text.normalize_string``); g and s are numbers, distinct within a record. An empty or
    null text, one without word characters beyond equality, and a null record match nothing. The number of rounds is the
    longest chain of ties and of pairs that wait for a better one; every round is a fixed number of shuffles.
    """
    gold = gold.select("record", "g", "text").where("record is not null and text <> ''")
    sub = sub.select("record", "s", "text").where("record is not null and text <> ''")
    exact = cut(_exact(gold, sub))
    a = _classes(gold.join(exact, ["record", "g"], "left_anti"), "g", "a")
    b = _classes(sub.join(exact, ["record", "s"], "left_anti"), "s", "b")
    near = _matched(a, b, _candidates(a, b))
    return exact.withColumn("exact", F.lit(True)).unionAll(near.withColumn("exact", F.lit(False)))
