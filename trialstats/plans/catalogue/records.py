"""Lenient readers, grading and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialstats.functions import draws as D
from trialstats.functions import text as T
from trialstats.functions import values as V
from trialstats.functions.arguments import args_sha256, matches_schema
from trialstats.operators import grade as G
from trialstats.operators import transcripts as X
from trialstats.plans.catalogue import sqltext as S
from trialstats.session import cut
from trialstats.sources.adapters import spread, table


def _orders(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders"))


def amount_parse(spark, sf_dir):
    """Order totals printed in eight layouts and read back."""
    o = _orders(spark, sf_dir)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    us = F.format_number(whole.cast("double"), 0)
    eu, sp = F.replace(us, F.lit(","), F.lit(".")), F.replace(us, F.lit(","), F.lit(" "))
    layouts = [
        F.concat(F.lit("$"), us, F.lit("."), part),
        F.concat(eu, F.lit(","), part, F.lit(" €")),
        F.concat(F.lit("("), us, F.lit("."), part, F.lit(")")),
        F.concat(F.lit("EUR "), sp, F.lit(","), part),
        F.concat(whole.cast("string"), F.lit("."), part, F.lit(" usd")),
        F.concat(F.lit("-£"), us, F.lit("."), part),
        us,
        F.concat(whole.cast("string"), F.lit("e3")),
    ]
    printed = F.get(F.array(*layouts), (F.col("o_orderkey") % len(layouts)).cast("int"))
    return o.select("o_orderkey", printed.alias("printed")).select(
        "o_orderkey", "printed", V.normalize_amount("printed").cast("decimal(38,2)").alias("amount"))


def date_parse(spark, sf_dir):
    """Order dates printed in nine layouts (two of them invalid) and read back."""
    o = _orders(spark, sf_dir).withColumn("d", F.col("o_orderdate").cast("date"))
    fmt = lambda f: F.date_format("d", f)
    layouts = [
        fmt("yyyy-M-d"), fmt("dd/MM/yyyy"), fmt("d.M.yyyy"), fmt("d MMMM yyyy"),
        F.upper(fmt("MMMM d, yyyy")), fmt("yyyyMMdd"), fmt("MM/dd/yyyy"), fmt("dd/MM/yy"),
        F.concat(fmt("yyyy"), F.lit("-02-30")),
    ]
    printed = F.get(F.array(*layouts), (F.col("o_orderkey") % len(layouts)).cast("int"))
    return o.select("o_orderkey", printed.alias("printed")).select(
        "o_orderkey", V.normalize_date("printed").alias("parsed"))


def currency_parse(spark, sf_dir):
    o = _orders(spark, sf_dir)
    forms = ["usd", " EUR ", "€", "£", "$", "Euro", "US$", "gbp."]
    printed = F.get(F.lit(forms), (F.col("o_orderkey") % len(forms)).cast("int"))
    return o.select("o_orderkey", printed.alias("printed")).groupBy(
        "printed", V.normalize_currency("printed").alias("code")
    ).agg(F.count(F.lit(1)).alias("orders"))


def normalized_texts(spark, sf_dir):
    """Hash of the comparison form of every document text."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.sha2(T.normalize_string("text"), 256).alias("normal_sha256"))


def jaccard_pairs(spark, sf_dir):
    """Token overlap of each message with the next one of its conversation."""
    talk = spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", T.tokens(F.lower("text")).alias("a"))
    nxt = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    shared, total = T.overlap(F.col("a"), F.col("b"))
    return talk.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", shared.alias("shared"), total.alias("total"),
        ((shared * 5 >= total * 3) & (total > 0)).alias("similar"))


def _graded_input(spark, sf_dir):
    """Gold records and edited submissions, one per conversation message.

    The sentences of a message are the line items. A hashed kind per message decides which field of
    the submission is wrong, so the expected score is known.
    """
    talk = spread(table(spark, sf_dir, "conversations"))
    sentences = F.filter(
        F.transform(F.split("text", r"[.\n]"), lambda t: F.trim(t)), lambda t: F.char_length(t) > 0)
    item = lambda t, i: F.struct(
        t.alias("description"), (F.char_length(t) % 9 + 1).alias("quantity"),
        F.lit("4.25").cast("decimal(38,10)").alias("unit_price"),
        ((i + 1) * F.lit("2.50").cast("decimal(5,2)")).cast("decimal(38,10)").alias("amount"))
    base = talk.withColumn("_items", F.transform(sentences, item)).withColumn(
        "kind", ((F.col("conv_id") * 7 + F.col("turn")) % 8).cast("int"))
    kind = F.col("kind")
    number = F.concat(F.lit("INV-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    date = F.date_add(F.lit("2026-01-01").cast("date"), F.col("turn").cast("int"))
    total = (F.char_length("text") / F.lit(4)).cast("decimal(38,10)")
    gold = F.struct(
        number.alias("invoice_number"), date.cast("string").alias("invoice_date"),
        F.concat(F.lit("Vendor "), "role", F.lit(" Ltd.")).alias("vendor_name"),
        F.lit("EUR").alias("currency"), total.alias("total_amount"), F.col("_items").alias("line_items"),
    ).cast(G.GOLD_TYPE)
    shown = F.when(kind == 5, F.slice("_items", 1, F.greatest(F.size("_items") - 1, F.lit(0)))).when(
        kind == 6, F.reverse("_items")).when(
        kind == 7, F.transform("_items", lambda i: F.struct(
            i["description"].alias("description"), (i["quantity"] + 1).alias("quantity"),
            i["unit_price"].alias("unit_price"), i["amount"].alias("amount")))).otherwise(F.col("_items"))
    submitted = F.to_json(F.struct(
        F.when(kind == 1, F.concat(number, F.lit("X"))).otherwise(F.lower(number)).alias("invoice_number"),
        F.when(kind == 2, F.lit("2026-02-30")).otherwise(F.date_format(date, "dd.MM.yyyy")).alias("invoice_date"),
        F.concat(F.lit(" vendor  "), F.upper("role"), F.lit(" LTD")).alias("vendor_name"),
        F.when(kind == 3, "$").otherwise("€").alias("currency"),
        F.when(kind == 4, F.lit("see document")).otherwise(
            F.concat(total.cast("decimal(38,2)").cast("string"), F.lit(" eur"))).alias("total_amount"),
        shown.alias("line_items"),
    ))
    return base.select("conv_id", "turn", "kind", gold.alias("gold"),
                       F.parse_json(submitted).alias("submission"))


def graded_scores(spark, sf_dir):
    scored = G.score(_graded_input(spark, sf_dir))
    fields = [F.round(F.col("per_field")[n], 9).alias(n) for n in G.WEIGHTS]
    return scored.select("conv_id", "turn", "kind", F.round("score", 9).alias("score"), *fields)


def graded_runs(spark, sf_dir):
    """Runs graded against a gold table that lacks every eleventh conversation; every fifth turn was aborted."""
    rows = _graded_input(spark, sf_dir).withColumn("doc_id", F.concat_ws("-", "conv_id", "turn"))
    outcome = F.when(F.col("turn") % 5 == 4, G.ABORTED).otherwise("submitted")
    runs = rows.select("conv_id", "turn", "doc_id", "submission", outcome.alias("outcome"))
    graded = G.grade_runs(runs, rows.where(F.col("conv_id") % 11 != 0).select("doc_id", "gold"))
    return graded.select("conv_id", "turn", "outcome", "grading", "success", F.round("score", 9).alias("score"))


def regraded_runs(spark, sf_dir):
    """Audit of graded runs: some scores were changed, some transcripts are lost or hold another record, some gold is lost."""
    rows = _graded_input(spark, sf_dir).withColumn("run_id", F.concat_ws("-", "conv_id", "turn")).withColumn("doc_id", F.col("run_id"))
    gold, turn, conv = rows.select("doc_id", "gold"), F.col("turn"), F.col("conv_id")
    runs = rows.select("conv_id", "turn", "run_id", "doc_id", "submission", F.lit("submitted").alias("outcome"))
    # an audit reads recorded grades; were they not written, its filter on them would grade every run once more
    stored = cut(G.grade_runs(runs, gold)).withColumn("score", F.col("score") + F.when(turn % 7 == 1, 0.125).otherwise(0.0))
    record = F.when(turn % 7 == 2, "{}").otherwise(F.to_json("submission"))
    call = F.array(F.struct(
        F.lit("a").alias("id"), F.lit("submit_record").alias("name"),
        F.concat(F.lit('{"record":'), record, F.lit("}")).alias("arguments_text"), F.lit(False).alias("malformed")))
    result = F.array(F.struct(
        F.lit("a").alias("call_id"), F.lit("submit_record").alias("name"), F.lit("ok").alias("content"),
        F.lit(False).alias("is_error"), F.lit(True).alias("executed"), F.lit(False).alias("model_error"),
        F.lit(None).cast(X.FAULT).alias("fault")))
    none = F.lit(None)
    messages = F.array(*[F.struct(
        F.lit(role).alias("role"), none.cast("string").alias("content"), calls.cast(f"array<{X.CALL}>").alias("tool_calls"),
        results.cast(f"array<{X.RESULT}>").alias("tool_results"), none.cast(f"array<{X.BLOCK}>").alias("raw_blocks"),
    ).cast(X.MESSAGE) for role, calls, results in (("assistant", call, none), ("tool", none, result))])
    transcripts = runs.where(conv % 6 != 1).select("run_id", messages.alias("messages"))
    kept = rows.where(conv % 11 != 0).select("doc_id", "gold")
    return G.regrade_audit(stored, transcripts, kept).withColumns(
        {c: F.round(c, 9) for c in ("recorded", "regraded")})


def transcript_features(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    return X.message_features(talk, "conv_id", "turn", "role", "text")


def _message_digest():
    return F.sha2(F.concat(F.lit("["), D.json_string("role"), F.lit(","), D.json_string("text"), F.lit("]")), 256)


def transcript_hash_groups(spark, sf_dir):
    talk = spread(table(spark, sf_dir, "conversations")).withColumn("digest", _message_digest())
    hashes = X.tree_digest(talk, ["conv_id"], "turn", "digest")
    return X.hash_groups(hashes, "conv_id")


def canonical_hashes(spark, sf_dir):
    """Canonical hash of each message held as a one-message transcript."""
    talk = spread(table(spark, sf_dir, "conversations"))
    message = F.struct(
        F.col("role"), F.col("text").alias("content"), F.lit(None).cast(f"array<{X.CALL}>").alias("tool_calls"),
        F.lit(None).cast(f"array<{X.RESULT}>").alias("tool_results"),
        F.array(F.struct(F.lit("reasoning_content").alias("type"), F.col("text").alias("text")))
        .alias("raw_blocks"))
    return talk.select("conv_id", "turn", X.canonical_hash(F.array(message)).alias("hash"))


def redacted_transcripts(spark, sf_dir):
    talk = spread(table(spark, sf_dir, "conversations"))
    keep = F.col("role").isin("system", "assistant")
    masked = T.redacted(F.col("text"))
    return talk.select(
        "conv_id", "turn", "role", F.when(keep, F.col("text")).alias("content"),
        F.when(~keep, masked["sha256"]).alias("sha256"), F.when(~keep, masked["length"]).alias("length"))


def _replayed(talk):
    """A second set of transcripts: some messages changed, some last messages lost."""
    u = D.unit("replay", D.number("conv_id"), D.number("turn"))
    kept = talk.where(~((F.col("turn") >= 2) & (u < 0.1)))
    return kept.withColumn("text", F.when(u > 0.9, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


def first_divergence(spark, sf_dir):
    talk = spread(table(spark, sf_dir, "conversations"))
    return X.message_divergence(talk, _replayed(talk), "conv_id", "turn", "text")


def _executions(spark, sf_dir):
    """Six replays of every conversation; a hashed few of them come out differently."""
    talk = spread(table(spark, sf_dir, "conversations")).withColumn("digest", _message_digest())
    hashes = X.tree_digest(talk, ["conv_id"], "turn", "digest")
    runs = hashes.withColumn("regime", F.explode(F.lit(["serial", "restart", "filler"]))).withColumn(
        "replay", F.explode(F.lit([0, 1])))
    u = D.unit("gate", D.number("conv_id"), D.token("regime"), D.number("replay"))
    drifted = F.sha2(F.concat("transcript_hash", F.lit("x")), 256)
    return runs.select(
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model_id"),
        F.col("conv_id").alias("run_id"), "regime", "replay",
        F.when(u < 0.03, drifted).otherwise(F.col("transcript_hash")).alias("transcript_hash"))


def determinism_gate(spark, sf_dir):
    return X.gate_result(_executions(spark, sf_dir))


def determinism_variants(spark, sf_dir):
    gate = X.determinism_gate(_executions(spark, sf_dir))
    places = F.array_sort(F.transform(F.map_values("where"), lambda p: F.array_join(p, ",")))
    return gate.select("run_id", "distinct_transcripts", F.array_join(places, ";").alias("places"))


def accepted_submissions(spark, sf_dir):
    """The accepted record of two-attempt transcripts: the first attempt runs for some orders only,
    and some second attempts end in a model error."""
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    call = lambda i, n: F.array(F.struct(
        F.lit(i).alias("id"), F.lit("submit_record").alias("name"),
        F.to_json(F.struct(F.struct((k + n).alias("invoice_number")).alias("record"))).alias("arguments_text"),
        F.lit(False).alias("malformed"))).cast(f"array<{X.CALL}>")
    result = lambda i, ran, err: F.array(F.struct(
        F.lit(i).alias("call_id"), F.lit("submit_record").alias("name"), F.lit("ok").alias("content"),
        F.lit(False).alias("is_error"), ran.alias("executed"), err.alias("model_error"),
        F.lit(None).cast(X.FAULT).alias("fault"))).cast(f"array<{X.RESULT}>")
    blank_c, blank_r = F.lit(None).cast(f"array<{X.CALL}>"), F.lit(None).cast(f"array<{X.RESULT}>")
    msg = lambda role, c, r: F.struct(
        F.lit(role).alias("role"), F.lit(None).cast("string").alias("content"), c.alias("tool_calls"),
        r.alias("tool_results"), F.lit(None).cast(f"array<{X.BLOCK}>").alias("raw_blocks")).cast(X.MESSAGE)
    messages = F.array(
        msg("user", blank_c, blank_r),
        msg("assistant", call("a", 0), blank_r), msg("tool", blank_c, result("a", k % 3 == 0, F.lit(False))),
        msg("assistant", call("b", 1), blank_r), msg("tool", blank_c, result("b", F.lit(True), k % 5 == 0)))
    acc = X.accepted_submission(messages)
    return o.select("o_orderkey", acc.alias("acc")).select(
        "o_orderkey", F.col("acc.found").alias("found"),
        F.get_json_object("acc.arguments_text", "$.record.invoice_number").cast("bigint").alias("invoice_number"))


def text_submissions(spark, sf_dir):
    """Messages whose text holds a JSON object with the wanted key; one object in four is broken."""
    talk = spread(table(spark, sf_dir, "conversations"))
    k = F.col("conv_id") + F.col("turn")
    tail = F.when(k % 4 == 0, '{"invoice_number": "A1"}').when(k % 4 == 1, '{"invoice_number": ').when(
        k % 4 == 2, '{"x": {"invoice_number": 1}}').otherwise("invoice_number")
    text = F.concat(F.col("text"), F.lit(" {brace "), tail, F.lit(" end"))
    return talk.groupBy("role").agg(
        F.count_if(X.holds_json_object(text, "invoice_number")).alias("submissions"),
        F.count(F.lit(1)).alias("messages"))


def call_quality(spark, sf_dir):
    """Argument texts of event calls: empty, object, cut object, list; and normalized usage."""
    e = spread(table(spark, sf_dir, "events"))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "").when(k == 1, F.col("props")).when(
        k == 2, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    usage = X.uncached_usage(F.col("user_id") * 10, F.col("event_id") % 1000, F.lit(5))
    reason = X.finish_reason(F.get(F.lit(["stop", "tool_calls", "length", "content_filter", "odd"]),
                                   (F.col("event_id") % 5).cast("int")))
    return e.groupBy("event_type", reason.alias("reason")).agg(
        F.count_if(X.malformed_call(raw)).alias("malformed"), F.count(F.lit(1)).alias("calls"),
        F.sum(usage["input_tokens"]).alias("input_tokens"),
        F.sum(usage["cache_read_tokens"]).alias("cache_read_tokens"))


ARGUMENTS = {
    "type": "object", "required": ["k"],
    "properties": {"k": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}},
}


def argument_checks(spark, sf_dir):
    """Fingerprint of every event's arguments, and their check against a schema; some are made
    wrong: a text for the number, no key, a number among the tags."""
    e = spread(table(spark, sf_dir, "events"))
    k, n = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    body = F.when(k == 0, F.concat(F.lit('{"tags": ["a"], "k": '), n, F.lit("}"))).when(
        k == 1, F.concat(F.lit('{"k": "'), n, F.lit('"}'))).when(k == 2, F.lit('{"tags": []}')).otherwise(
        F.concat(F.lit('{"k": '), n, F.lit(', "tags": [1]}')))
    t = e.select("event_id", body.alias("body"))
    return t.select("event_id", args_sha256(F.col("body")).alias("sha256"),
                    matches_schema(F.parse_json("body"), ARGUMENTS).alias("valid"))


# ---- SQL ---------------------------------------------------------------------------------------

DIGEST = f"sha256('[\"' || role || '\",\"' || {S.ascii_json('text')} || '\"]')"


def _tree() -> str:
    """Four levels of hashing 256 digests at a time."""
    q = f"select conv_id, turn as o, {DIGEST} as d from conversations"
    for _ in range(4):
        q = f"select conv_id, o // 256 as o, sha256(string_agg(d, '' order by o)) as d from ({q}) group by conv_id, o // 256"
    return f"select conv_id, d as transcript_hash from ({q}) where o = 0"


_CONV_U = S.unit("'[\"replay\",' || cast(conv_id as varchar) || ',' || cast(turn as varchar) || ']'")
_GATE_U = S.unit("'[\"gate\",' || cast(conv_id as varchar) || ',\"' || regime || '\",' || cast(replay as varchar) || ']'")
EXEC = f"""
hh as ({_tree()}),
ex as (select 'm' || cast(conv_id % 3 as varchar) as model_id, conv_id as run_id, regime, replay,
         case when {_GATE_U} < 0.03 then sha256(transcript_hash || 'x') else transcript_hash end as h
       from hh, (select unnest(['serial','restart','filler']) as regime), (select unnest([0,1]) as replay))"""

_WHOLE = "(round(o_totalprice*100)::bigint // 100)"
_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda t: trim(t, ' ')), lambda t: length(t) > 0)"

NORMAL = (
    r"trim(rtrim(trim(regexp_replace(replace(lower({}), 'ß', 'ss'), "
    r"'[\t-\r\x1c-\x1f \x{{85}}\x{{a0}}]+', ' ', 'g')), '.,;:'))"
)

QUERIES = {
    "amount_parse": amount_parse,
    "date_parse": date_parse,
    "currency_parse": currency_parse,
    "normalized_texts": normalized_texts,
    "jaccard_pairs": jaccard_pairs,
    "graded_scores": graded_scores,
    "graded_runs": graded_runs,
    "regraded_runs": regraded_runs,
    "transcript_features": transcript_features,
    "transcript_hash_groups": transcript_hash_groups,
    "canonical_hashes": canonical_hashes,
    "redacted_transcripts": redacted_transcripts,
    "first_divergence": first_divergence,
    "determinism_gate": determinism_gate,
    "determinism_variants": determinism_variants,
    "accepted_submissions": accepted_submissions,
    "text_submissions": text_submissions,
    "call_quality": call_quality,
    "argument_checks": argument_checks,
}

ORACLES = {
    "amount_parse": f"""with w as (select o_orderkey, o_orderkey % 8 as k, round(o_totalprice*100)::bigint as c, {_WHOLE} as w,
   lpad(cast(round(o_totalprice*100)::bigint % 100 as varchar), 2, '0') as p, format('{{:,}}', {_WHOLE}) as us from orders)
select o_orderkey, case k when 0 then '$' || us || '.' || p when 1 then replace(us, ',', '.') || ',' || p || ' €'
   when 2 then '(' || us || '.' || p || ')' when 3 then 'EUR ' || replace(us, ',', ' ') || ',' || p
   when 4 then cast(w as varchar) || '.' || p || ' usd' when 5 then '-£' || us || '.' || p when 6 then us
   else cast(w as varchar) || 'e3' end as printed,
  cast(case when k in (2, 5) then -c/100.0 when k = 6 then w when k = 7 then null else c/100.0 end as decimal(38,2)) as amount from w""",
    "date_parse": """select o_orderkey, case o_orderkey % 9 when 7 then null when 8 then null
   when 6 then case when day(o_orderdate) > 12 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%d-%m') end
   else strftime(o_orderdate, '%Y-%m-%d') end as parsed from orders""",
    "currency_parse": """select case k when 0 then 'usd' when 1 then ' EUR ' when 2 then '€' when 3 then '£' when 4 then '$'
   when 5 then 'Euro' when 6 then 'US$' else 'gbp.' end as printed,
  case k when 0 then 'USD' when 1 then 'EUR' when 2 then 'EUR' when 3 then 'GBP' when 4 then 'USD' when 7 then 'GBP' else '' end as code,
  count(*) as orders from (select o_orderkey % 8 as k from orders) group by all""",
    "normalized_texts": f"select doc_id, sha256({NORMAL.format('text')}) as normal_sha256 from documents",
    "jaccard_pairs": """with t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) as a from conversations),
p as (select x.conv_id, x.turn, len(list_intersect(x.a, y.a)) as shared, len(x.a) as la, len(y.a) as lb
      from t x join t y on x.conv_id = y.conv_id and y.turn = x.turn + 1)
select conv_id, turn, shared::integer as shared, (la + lb - shared)::integer as total,
       shared*5 >= (la + lb - shared)*3 and la + lb - shared > 0 as similar from p""",
    "graded_scores": f"""with m as (select conv_id, turn, ((conv_id*7 + turn) % 8)::integer as kind, {_SENT} as items from conversations),
e as (select conv_id, turn, kind, len(items) as n, unnest(range(len(items))) as i, items from m),
g as (select *, length(items[i + 1]) % 9 + 1 as q, {NORMAL.format("items[i + 1]")} as d from e),
gk as (select *, row_number() over (partition by conv_id, turn, d order by i) as k from g),
sk as (select *, row_number() over (partition by conv_id, turn, d order by case when kind = 6 then -i else i end) as k
       from g where not (kind = 5 and i = n - 1)),
c as (select gk.conv_id, gk.turn, sum((2 + (case when sk.q + (case when gk.kind = 7 then 1 else 0 end) = gk.q then 1 else 0 end)
         + (case when sk.i = gk.i then 1 else 0 end))/4.0::double) as earned
      from gk join sk on gk.conv_id = sk.conv_id and gk.turn = sk.turn and gk.d = sk.d and gk.k = sk.k and gk.d <> '' group by all),
i as (select m.*, case when len(items) = 0 then 1.0 else coalesce(earned, 0)/len(items) end as li
      from m left join c on m.conv_id = c.conv_id and m.turn = c.turn)
select conv_id, turn, kind, round(((case when kind = 1 then 0 else 2 end) + (case when kind = 2 then 0 else 1 end) + 1
         + (case when kind = 3 then 0 else 1 end) + (case when kind = 4 then 0 else 2 end) + 3*li)/10.0::double, 9) as score,
  case when kind = 1 then 0.0 else 1.0 end::double as invoice_number, case when kind = 2 then 0.0 else 1.0 end::double as invoice_date,
  1.0::double as vendor_name, case when kind = 3 then 0.0 else 1.0 end::double as currency,
  case when kind = 4 then 0.0 else 1.0 end::double as total_amount, round(li, 9) as line_items from i""",
    "transcript_features": """select conv_id, count(*) as messages, count(*) filter (where role = 'assistant') as turns,
  count(*) filter (where role = 'user') as user_messages, sum(length(text))::bigint as characters, max(turn) as last_turn
from conversations group by all""",
    "transcript_hash_groups": f"""select transcript_hash, count(*) as transcripts, min(conv_id) as first_conv_id from ({_tree()}) group by all""",
    "canonical_hashes": f"""select conv_id, turn, sha256('[["' || role || '","' || {S.ascii_json('text')} || '",[],[],["'
   || {S.ascii_json('text')} || '"]]]') as hash from conversations""",
    "redacted_transcripts": """select conv_id, turn, role, case when role in ('system','assistant') then text end as content,
  case when role not in ('system','assistant') then sha256(text) end as sha256,
  case when role not in ('system','assistant') then length(text) end as length from conversations""",
    "first_divergence": f"""with b as (select conv_id, turn, case when {_CONV_U} > 0.9 then text || '!' else text end as text
   from conversations where not (turn >= 2 and {_CONV_U} < 0.1)),
j as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, a.text as x, b.text as y,
        a.conv_id is not null as ia, b.conv_id is not null as ib
      from conversations a full join b on a.conv_id = b.conv_id and a.turn = b.turn)
select conv_id, min(turn) filter (where not (ia and ib and x = y)) as first_divergence, count(*) filter (where ia) as original_messages,
       count(*) filter (where ib) as replay_messages, count(*) filter (where not (ia and ib and x = y)) = 0 as identical
from j group by all""",
    "determinism_gate": f"""with {EXEC}, s as (select model_id, run_id, count(distinct h) as v, count(*) as n from ex group by all)
select model_id, count(*) as specs, sum(n)::bigint as executions, count(*) filter (where v > 1) as disagreeing,
  count(*) filter (where v > 1) = 0 as passed,
  case when count(*) filter (where v > 1) = 0 then 'deterministic_verified' else 'non_deterministic' end as label from s group by all""",
    "determinism_variants": f"""with {EXEC},
v as (select run_id, h, string_agg(regime || '/r' || cast(replay as varchar), ',' order by regime || '/r' || cast(replay as varchar)) as p from ex group by all)
select run_id, count(*) as distinct_transcripts, string_agg(p, ';' order by p) as places from v group by run_id having count(*) > 1""",
    "argument_checks": """select event_id, event_id % 4 = 0 as valid, sha256(case event_id % 4
   when 0 then '{"k":' || (props->>'$.k') || ',"tags":["a"]}' when 1 then '{"k":"' || (props->>'$.k') || '"}'
   when 2 then '{"tags":[]}' else '{"k":' || (props->>'$.k') || ',"tags":[1]}' end) as sha256 from events""",
    "accepted_submissions": """select o_orderkey, o_orderkey % 3 = 0 or o_orderkey % 5 <> 0 as found,
  case when o_orderkey % 3 = 0 then o_orderkey when o_orderkey % 5 <> 0 then o_orderkey + 1 end as invoice_number from orders""",
    # the nested object also counts: the scan starts again at its own brace
    "text_submissions": """select role, count(*) filter (where (conv_id + turn) % 4 in (0, 2)) as submissions, count(*) as messages
from conversations group by all""",
    "call_quality": """select event_type, case event_id % 5 when 0 then 'end' when 1 then 'tool_calls' when 2 then 'max_tokens' when 3 then 'refusal' else 'other' end as reason,
  count(*) filter (where event_id % 4 in (2, 3)) as malformed, count(*) as calls,
  sum(greatest(user_id*10 - event_id % 1000, 0))::bigint as input_tokens, sum(event_id % 1000)::bigint as cache_read_tokens
from events group by all""",
}

ORACLES["graded_runs"] = f"""select conv_id, turn, outcome, grading,
  case when grading = 'graded' then score >= 0.8 end as success, case when grading = 'graded' then score end as score
from (select *, case when turn % 5 = 4 then 'aborted_transport' else 'submitted' end as outcome,
  case when turn % 5 = 4 then 'aborted' when conv_id % 11 = 0 then 'missing_gold' else 'graded' end as grading
  from ({ORACLES['graded_scores']}))"""

ORACLES["regraded_runs"] = f"""select conv_id || '-' || turn as run_id, round(score + case when turn % 7 = 1 then 0.125 else 0 end, 9) as recorded,
  case when conv_id % 11 <> 0 then score end as regraded,
  case when conv_id % 6 = 1 then 'missing_transcript' when conv_id % 11 = 0 then 'missing_gold'
    when turn % 7 = 2 then 'submission_mismatch' when turn % 7 = 1 then 'score_mismatch' else 'ok' end as status
from ({ORACLES['graded_scores']})"""
