"""DuckDB SQL for the queries that SQL can express."""

from fleetshape.llm.licences import THRESHOLD, prepared
from fleetshape.llm.quality import UNSPACED

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_UNSPACED = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED)

ORACLES["op3_quality_rules"] = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from d, unnest(range(1, len(w) - 6)) as t(i)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
cov as (select doc_id, count(distinct i + j) as n from rep, range(0, 8) as r(j) group by doc_id),
ln as (select doc_id, l from d, unnest(string_split(text, chr(10))) as t(l) where regexp_matches(l, '[^\x20\x09-\x0D]')),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup from ln group by doc_id),
m as (
  select d.doc_id, len(w) as n_words, coalesce(len(array_to_string(w, '')), 0) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines,
    coalesce(cov.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper, len(regexp_extract_all(text, '\p{{Ll}}')) as n_lower,
    len(regexp_extract_all(text, '\p{{L}}')) as n_letters, len(regexp_extract_all(text, '[{_UNSPACED}]')) as n_unspaced
  from d left join cov using (doc_id) left join lines using (doc_id)),
f as (
  select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
    + 8 * (100 * n_dup_lines > 30 * n_lines)::bigint
    + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words and 2 * n_unspaced <= word_chars))::bigint
    + 32 * (n_upper > n_lower and 2 * (n_upper + n_lower) > n_letters)::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) != 0 as base_failed, failed = 0 as kept, failed from f
"""

ORACLES["op4_mixing"] = rf"""
with d as (
  select doc_id, source, len({_WORDS}) as size, md5(coalesce(doc_id::varchar, text, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s),
l as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (
      order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::bigint
    / sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following)::bigint
    as level from r),
t as (select source, source_size, least((3 * source_size)::double, weight * max(level) over ()) as target from l),
u as (select source, h, sum(size)::bigint as size, (sum(sum(size)) over (partition by source order by h))::bigint as upto
  from d where size > 0 group by source, h),
q as (
  select u.source, u.h, u.size, floor((u.upto + e * source_size) / target * 68719476736.0)::bigint as tick
  from u join t on u.source is not distinct from t.source, range(0, 3) as r(e)),
k as (select tick, sum(sum(size)) over (order by tick) as upto from q group by tick),
c as (select coalesce(max(tick), -1) as last from k where upto <= (select sum(size) from d)),
n as (select source, h, count(*) as times from q, c where tick <= last group by source, h)
select d.doc_id, d.size, t.source_size, t.target, (d.size * coalesce(n.times, 0))::bigint as taken
from d join t on d.source is not distinct from t.source
left join n on d.source is not distinct from n.source and d.h = n.h
"""

_ITEM_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLES["op6_decontamination"] = rf"""
with b as (select coalesce(item_id::varchar, '') as item, {_ITEM_WORDS} as w from benchmark),
bw as (
  select item, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as k
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(i) where len(w) > 0),
d as (select doc_id, {_ITEM_WORDS} as w from documents),
dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as k
  from d, (select distinct n from bw) as s, unnest(range(1, len(w) - n + 2)) as t(i)),
h as (select distinct doc_id, i, dw.n, item from dw join bw on dw.n = bw.n and dw.k = bw.k),
cov as (select doc_id, count(distinct i + j) as n_hit from h, unnest(range(0, n)) as t(j) group by doc_id),
it as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (doc_id) left join it using (doc_id)
"""

ORACLES["op5_chat"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' from range(0, 2) as t(i)),
e as (select *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') as er, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as et from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(12 + len(er) + 10 + len(et) + 10)::bigint as formatted_chars
from e group by conv_id
"""

_KNOWN = prepared()
_FACTS = ", ".join(f"({t.no}, '{t.license}', {len(t.grams)}, {t.length}, {sorted(t.needed)}, {sorted(t.barred) or '[]::varchar[]'})" for t in _KNOWN)
_GRAMS = ", ".join(f"({t.no}, '{g}', {m})" for t in _KNOWN for g, m in sorted(t.grams.items()))

# Every window of a template's length, tried one by one where a text has enough of the template at all.
ORACLES["op9_license_scan"] = rf"""
with f(no, license, n_set, length, needed, barred) as (values {_FACTS}),
tg(no, g, m) as (values {_GRAMS}),
d as (
  select row_number() over () as k, doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)) as ls from documents),
ln as (select k, i as line, list_filter(string_split_regex(ls[i], ' '), lambda x: x != '') as w from d, unnest(range(1, len(ls) + 1)) as u(i)),
wd as (select k, line, j, w[j] as w from ln, unnest(range(1, len(w) + 1)) as u(j)),
p as (
  select k, line, row_number() over (partition by k order by line, j) as pos, w, lead(w) over (partition by k order by line, j) as nw,
    lead(line) over (partition by k order by line, j) as nl from wd),
t as (select k, list(w order by pos) as ws, list(w || ' ' || nw order by pos) filter (nw is not null) as gs from p group by k),
seg as (
  select k, 0 as segment, 1 as first_word, len(ws) as last_word, ws, gs from t
  union all select k, line, min(pos), max(pos), list(w order by pos), list(w || ' ' || nw order by pos) filter (nw is not null and nl = line) from p group by k, line),
hit as (select k, no, pos, g, m from p join tg on g = w || ' ' || nw),
held as (select k, no, g, least(count(*), m) as n from hit group by k, no, g, m),
able as (select k, no from held join f using (no) group by k, no, n_set, length having sum(n) >= {THRESHOLD} * length or 2.0 * count(*) / (count(*) + n_set) >= {THRESHOLD}),
sm as (
  select s.k, f.no, license, first_word, last_word,
    2.0::double * len(list_intersect(list_distinct(gs), (select list(g) from tg where tg.no = f.no))) / (len(list_distinct(gs)) + n_set) as dice
  from seg s join able using (k) join f on f.no = able.no where gs is not null and list_has_all(ws, needed) and not list_has_any(ws, barred)),
st as (select k, no, s from able join t using (k), unnest(range(1, len(ws) + 1)) as u(s)),
wm as (
  select st.k, st.no, st.s, (select sum(least(n, m)) from (select g, m, count(*) as n from hit h where h.k = st.k and h.no = st.no and h.pos between st.s and st.s + length - 1 group by g, m) x)::double / length as dice,
    license, length, ws[st.s:st.s + length] as ws, needed, barred
  from st join f using (no) join t using (k)),
wv as (select *, s - row_number() over (partition by k, no order by s) as island from wm where dice >= {THRESHOLD} and list_has_all(ws, needed) and not list_has_any(ws, barred)),
wf as (select k, no, license, s as first_word, s + length as last_word, dice from wv qualify row_number() over (partition by k, no, island order by dice desc, s) = 1),
m as (
  select * from sm where dice >= {THRESHOLD} union all select k, no, license, first_word, last_word, dice from wf where dice >= {THRESHOLD}),
o as (
  select * from m where not exists (select 1 from m b where b.k = m.k and b.license != m.license and b.first_word <= m.first_word and b.last_word >= m.last_word
    and b.last_word - b.first_word > m.last_word - m.first_word)),
b as (
  select k, count(distinct no) as n_templates, string_agg(distinct license, ',' order by license) as licenses, arg_min(license, (-dice, license)) as license, max(dice) as dice
  from o group by k)
select doc_id, coalesce(n_templates, 0) as n_templates, coalesce(licenses, '') as licenses, license, dice from d left join b using (k)
"""

ORACLES["op12_hard_negatives"] = r"""
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id as other, a.label = c.label as alike, list_inner_product(a.v, c.v)::bigint as score
  from r as a, r as c where a.vec_id % 50 = 0 and a.vec_id != c.vec_id),
p as (
  select anchor_id, other as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank,
  other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not alike and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 3
"""
