"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from trialstats.llm.alignment import op12_alignment
from trialstats.llm.decontamination import op1_decontamination
from trialstats.llm.extraction import op2_extraction
from trialstats.llm.language import op8_language
from trialstats.llm.licenses import op9_licenses
from trialstats.llm.manifest import op13_manifest
from trialstats.llm.mixing import op5_mixing
from trialstats.llm.neardup import op3_neardup
from trialstats.llm.personal import op10_personal
from trialstats.llm.repeats import op11_repeats
from trialstats.llm.search import op7_search
from trialstats.llm.sharding import op6_sharding
from trialstats.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_extraction": op2_extraction,
    "op3_neardup": op3_neardup,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_search": op7_search,
    "op8_language": op8_language,
    "op9_licenses": op9_licenses,
    "op10_personal": op10_personal,
    "op11_repeats": op11_repeats,
    "op12_alignment": op12_alignment,
    "op13_manifest": op13_manifest,
    "pipeline": corpus_pipeline.run,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = f"""
with recursive docs as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
items as (
  select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) m, array_to_string(w[i:i + 9], ' ') win
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from items where len(w) > 0)),
lengths as (select distinct m from windows),
places as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') win
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from docs, lengths where len(w) >= m)),
found as (select doc_id, i, p.m, item_id from places p join windows x on p.m = x.m and p.win = x.win),
hit as (select doc_id, count(distinct i + k) n from (select doc_id, i, unnest(range(m)) k from found) group by doc_id),
own as (
  select doc_id, count(distinct item_id) n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) l
  from found group by doc_id)
select d.doc_id, len(w) n_words, coalesce(hit.n, 0) n_hit, coalesce(own.n, 0) n_items,
       sha256(coalesce(own.l, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from docs d left join hit using (doc_id) left join own using (doc_id)"""

_NEARDUP = f"""
with recursive docs as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
sets as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end sh
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) n from sets group by doc_id),
pairs as (
  select a.doc_id x, b.doc_id y, count(*) c from sets a join sets b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
reach as (select doc_id x, doc_id y from docs union select r.x, l.y from reach r join links l on l.x = r.y)
select d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept
from docs d left join sizes using (doc_id) join (select x doc_id, min(y) component_id from reach group by x) using (doc_id)"""

_SEARCH = """
with v as (
  select vec_id, min(list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
scored as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
        for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32, bit by bit
_CRC = """xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
  lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"""

_MANIFEST = f"""
with recursive leaf as (
  select *, case when {_CRC} % 5 = 0 then {_leaf(_LOWER.replace("coalesce(text, '')", "text"))} else leaf end other,
         row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n
  from (select doc_id, source, lang, n_chars, text, {_leaf("text")} leaf from documents)),
nodes as (
  select source, 0 lvl, pos, n, leaf h from leaf union all
  select source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos))
  from nodes where n > 1 group by source, lvl, pos // 16, n),
subroots as (
  select source, h subroot, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from nodes where n = 1),
tops as (
  select 1000 lvl, pos, n, subroot h from subroots union all
  select lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by lvl, pos // 16, n),
runs as (
  select true own, source, lvl, pos, h from nodes where n > 1 union all
  select false, null, lvl, pos, h from tops where n > 1),
steps as (
  select a.own, a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') before,
         coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') behind
  from runs a join runs b on a.own = b.own and a.source is not distinct from b.source and a.lvl = b.lvl and a.pos // 16 = b.pos // 16
  group by all),
paths as (
  select l.source, l.pos, row_number() over (partition by l.source, l.pos order by s.lvl) k, before, behind
  from leaf l join subroots r on l.source is not distinct from r.source
  join steps s on case when s.own then s.source is not distinct from l.source and s.pos = l.pos >> (4 * s.lvl)
                  else s.pos = r.pos >> (4 * (s.lvl - 1000)) end),
folds as (
  select source, pos, 0::bigint k, other h from leaf union all
  select f.source, f.pos, p.k, sha256(before || h || behind) from folds f
  join paths p on f.source is not distinct from p.source and f.pos = p.pos and p.k = f.k + 1),
proofs as (select source, pos, max(k) k, string_agg(before || behind, '' order by k) siblings from paths group by all)
select l.doc_id, l.leaf, r.subroot, t.h root, sha256(coalesce(p.siblings, '')) proof_sha256, f.h folded_root, f.h = t.h verified
from leaf l join subroots r on l.source is not distinct from r.source join tops t on t.n = 1
left join proofs p on p.source is not distinct from l.source and p.pos = l.pos
join folds f on f.source is not distinct from l.source and f.pos = l.pos and f.k = coalesce(p.k, 0)"""

_REPEATS = """
with docs as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
parts as (  -- a substring near the start of a short string is found faster
  select r, p, substr(x, 2 * p + 1, 1798) x from (select r, x, unnest(range(0, len(x) // 2 - 399, 500)) p from docs where len(x) >= 800)),
starts as (
  select r, p + k s, hash(substr(x, 2 * k + 1, 800)) h
  from (select r, p, x, unnest(range(0, least(500, len(x) // 2 - 399))) k from parts)),
marked as (select r, s from starts join (select h from starts group by h having count(*) > 1) using (h)),
islands as (
  select r, s, sum(case when s - before <= 400 then 0 else 1 end) over (partition by r order by s) g
  from (select *, lag(s) over (partition by r order by s) before from marked)),
spans as (select r, min(s) b, max(s) + 400 e from islands group by r, g),
gaps as (
  select r, b, e, substr(x, 2 * coalesce(lag(e) over (partition by r order by b), 0) + 1,
                         2 * (b - coalesce(lag(e) over (partition by r order by b), 0))) y
  from spans join docs using (r)),
kept as (select r, string_agg(y, '' order by b) y, sum(e - b) n, count(*) spans, max(e) e from gaps group by r)
select doc_id, len(x) // 2 n_bytes, coalesce(n, 0) n_removed, coalesce(spans, 0) n_spans,
       sha256(unhex(case when n is null then x else y || substr(x, 2 * e + 1) end)) kept_sha256
from docs left join kept using (r)"""

ORACLES: dict[str, str] = {
    "op1_decontamination": _DECONTAMINATION,
    "op3_neardup": _NEARDUP,
    "op7_search": _SEARCH,
    "op11_repeats": _REPEATS,
    "op13_manifest": _MANIFEST,
}
